"""Importance resampling, periodic runs and source mixing against plain versions."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import corpus, hard_rows, words
from llm_helpers import frame, rows_of  # noqa: F401
from parley.llm import periodic_runs, source_mix, target_resampling
from pyspark.sql import functions as F

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# importance resampling ------------------------------------------------------------------
def grams(text):
    w = TOKEN.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(w), [b" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    s, t = (Counter(zlib.crc32(g) % 10000 for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
    out = []
    for i, x in rows:
        n, g = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % 10000) for f in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("rows", [corpus(11, 90), hard_rows()], ids=["mixed", "hard"])
@pytest.mark.parametrize("percent,bits,block", [(5, 12, None), (60, 3, 7), (100, 16, 1)])
def test_resample(frame, spark, rows, percent, bits, block):
    target = [corpus(12, 5)[k][1] for k in range(5)] + [None, "alpha beta"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_resampling.resample(frame(rows), goal, percent=percent, digit_bits=bits, block_rows=block)
    assert rows_of(got) == plain_resample(rows, target, percent)


def test_resample_many_ties_and_wide_ids(frame, spark):
    goal = spark.createDataFrame([("b c d",)], "text string")
    text = "a b c d " * 6
    rows = [(-2**63, text), (2**63 - 1, text), (0, text), (None, text), (None, text)] + [(7, text)] * 30 + [(7, text + "z")] * 3
    got = target_resampling.resample(frame(rows), goal, percent=100, block_rows=4)
    assert rows_of(got) == plain_resample(rows, ["b c d"], 100)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert target_resampling.resample(empty, goal).count() == 0
    assert rows_of(target_resampling.resample(frame(rows), empty, 100)) == plain_resample(rows, [], 100)


def test_checksums_of_joined_words():
    rnd = random.Random(4)
    for _ in range(50):
        a, b = (bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5, 300, 70_000]))) for _ in "ab")
        got = target_resampling.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


# periodic runs ----------------------------------------------------------------------------
def plain_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q) and not any(u <= s and u + n >= i + q for u, n, _ in out):
                out.append((s, i + q - s, q))
            i += 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def plain_digest(rows, plant):
    out = []
    for doc, text in rows:
        w = words(text)
        h = zlib.crc32(str(doc).encode())
        if plant and doc is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        best = max(runs, key=lambda t: (t[1] / t[2], -t[0], -t[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        out.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def periodic_rows(seed, n=60):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        v = rnd.choice([1, 2, 3, 60])
        w = [rnd.randrange(v) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 65])
            unit = [rnd.randrange(v) for _ in range(p)] * rnd.choice([3, 4, 5, 25])
            w += unit[:max(1, len(unit) - rnd.randrange(p))] + [rnd.randrange(v) for _ in range(rnd.choice([0, 1, 30]))]
        rows.append((i * 7, " ".join(f"w{x}" for x in w[:900])))
    return rows


@pytest.mark.parametrize("rows", [periodic_rows(1), periodic_rows(2), corpus(5, 80), [r for r in hard_rows() if r[0] not in (13, 14)]],
                         ids=["periods", "more", "mixed", "hard"])
@pytest.mark.parametrize("plant", [False, True])
def test_runs(frame, rows, plant):
    assert rows_of(periodic_runs.run_digest(frame(rows), plant)) == plain_digest(rows, plant)


def test_runs_of_long_texts_and_empty_tables(frame, spark):
    rnd = random.Random(8)
    unit = " ".join(f"u{rnd.randrange(500)}" for _ in range(7001))
    text = "before " + " ".join([unit] * 3) + " after " + " ".join(["ha"] * 40_000) + " end"
    got = periodic_runs.periodic_runs(frame([(1, text), (2, hard_rows()[-5][1])])).collect()
    first = next(r for r in got if r["doc_id"] == 1)
    assert [tuple(r) for r in first["runs"]] == [(1, 21003, 7001), (21005, 40_000, 1)]
    assert first["collapsed"] == f"before {unit} after ha end"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_digest(empty).count() == 0 and periodic_runs.periodic_runs(empty).count() == 0


def test_zero_mismatch_is_exact_for_large_numbers():
    rnd = np.random.default_rng(3)
    for most in (5, 10**6, 10**8):
        window = rnd.integers(0, most + 1, (4, 50)).astype(np.uint64)
        block = window[:, 11:27].copy()
        block[2, 5] = (int(block[2, 5]) + 1) % (most + 1)
        got = periodic_runs.zero_mismatch(block, window, most)
        want = [[bool((window[i, k:k + 16] == block[i]).all()) for k in range(35)] for i in range(4)]
        assert got.tolist() == want


# source mixing ----------------------------------------------------------------------------
def plain_targets(sizes, most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in free}}
        fixed.update({s: most * sizes[s] for s in over})


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("x") for c in ("key", "pattern", "sources", "size", "rest")}).repartition(3)


def test_mix_of_single_sources(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["b", "B", "é", "日", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(2000, "tiny one", "z"), (2001, None, "nothing"), (None, "a b c", "b"), (None, "a b c", "b"), (5, "a b c", "b"), (5, "a b c", "b")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    size_of = Counter(round(want[s], 6) for s in sizes)
    for pool, bits in ((4096, 4), (5, 2)):
        got = source_mix.mix_report(mixed(spark, rows), pool=pool, bits=bits).collect()
        again = source_mix.mix_report(mixed(spark, rows[::-1]).repartition(2), pool=pool, bits=bits)
        assert sorted(map(tuple, got), key=repr) == rows_of(again)
        assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
        taken = defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
            taken[r["source_size"], round(r["target"], 6)] += r["taken"]
        assert {(sizes[s], round(want[s], 6)) for s in sizes} == set(taken)
        for (_, target), k in taken.items():
            assert abs(k - target) <= 20 or size_of[target] > 1
    other = source_mix.mix_report(mixed(spark, rows), seed=1).collect()
    assert sorted(map(tuple, got), key=repr) != sorted(map(tuple, other), key=repr)


def test_targets_share_what_exceeds_the_limit(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(10 + i, "w " * 10, s) for s in "bcd" for i in range(40)]
    got = {r["source_size"]: r["target"] for r in source_mix.mix_report(mixed(spark, rows)).collect() if r["source_size"] == 30}
    assert got == {30: 90.0}
    assert source_mix.mix_report(mixed(spark, rows[:0])).count() == 0


def unit_flow(patterns, quota, most):
    """Most words with the least cost, a word at a time: (words, cost)."""
    use = {(n, s): 0 for n, _, ss in patterns for s in ss}
    words, total, of = 0, 0, {n: w for n, w, _ in patterns}
    nodes = ["S", "T", *of, *quota]
    while True:
        arcs = []
        for n, w in of.items():
            f = sum(v for (p, _), v in use.items() if p == n)
            if f < most * w:
                arcs.append(("S", n, 2 * (f // w) + 1))
            if f:
                arcs.append((n, "S", -(2 * ((f - 1) // w) + 1)))
        arcs += [(n, s, 0) for n, s in use] + [(s, n, 0) for (n, s), v in use.items() if v]
        full = {s: sum(v for (_, t), v in use.items() if t == s) for s in quota}
        arcs += [(s, "T", 0) for s in quota if full[s] < quota[s]]
        far, by = {n: math.inf for n in nodes}, {}
        far["S"] = 0
        for _ in nodes:
            for a, b, c in arcs:
                if far[a] + c < far[b]:
                    far[b], by[b] = far[a] + c, a
        if far["T"] == math.inf:
            return words, total
        v = "T"
        while v != "S":
            u = by[v]
            if (u, v) in use:
                use[u, v] += 1
            elif (v, u) in use:
                use[v, u] -= 1
            v = u
        words, total = words + 1, total + far["T"]


def test_flow_is_of_least_cost():
    rnd = random.Random(6)
    for _ in range(40):
        quota = {s: rnd.randint(0, 25) for s in "abcd"[:rnd.randint(1, 4)]}
        patterns = [(f"p{k}", rnd.randint(1, 9), rnd.sample(sorted(quota), rnd.randint(1, len(quota)))) for k in range(rnd.randint(1, 5))]
        got = source_mix.route(patterns, quota)
        cost = 0
        for n, w, _ in patterns:
            f = sum(got[n].values())
            assert f <= 3 * w
            cost += sum(2 * (k // w) + 1 for k in range(f))
        assert all(sum(g.get(s, 0) for g in got.values()) <= quota[s] for s in quota)
        assert (sum(sum(g.values()) for g in got.values()), cost) == unit_flow(patterns, quota, 3)


def test_mix_of_overlapping_sources(spark):
    rnd = random.Random(9)
    sets = [["a"], ["a", "b"], ["b", "a", "a"], ["c"], ["d", None], [None], [], None]
    rows = [(i, rnd.choice(sets), rnd.randint(0, 30)) for i in range(1500)]
    out, goals = source_mix.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"), pool=40, bits=2)
    out, goals = out.collect(), {r["source"]: r["target"] for r in goals.collect()}
    assert len(out) == 1500 and all(r["taken"] == 0 for r in out if not r["sources"])
    by = lambda keep: sum(r["taken"] for r in out if r["sources"] and keep(set(r["sources"])))
    assert abs(by(lambda s: s <= {"a", "b"}) - goals["a"] - goals["b"]) <= 60
    assert abs(by(lambda s: s == {"c"}) - goals["c"]) <= 30
    assert abs(by(lambda s: s <= {"d", None}) - goals["d"] - goals[None]) <= 60
