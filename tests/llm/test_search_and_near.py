"""Exact top-k (MaxScore), near duplicates (circulant MinHash), line dedup, components."""
import random

import numpy as np
import pytest
from brute import corpus, hard_rows, near, top_k
from llm_helpers import frame, rows_of  # noqa: F401
from parley.llm import circulant, line_chunks, maxscore
from parley.operators.components import connected_components


def search(spark, rows, **options):
    v = maxscore.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, block string"))
    return rows_of(maxscore.top_k(v.filter("vec_id % 20 = 0"), v, **options))


def test_top_k(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.3) if rnd.random() < 0.8 else 0.0 for _ in range(16)], 1, "x") for i in range(400)]
    rows += [(1000 + i, rows[40][1], 1, "x") for i in range(30)]  # ties
    rows += [(None, [0.5] * 16, 1, "x"), (500, None, 1, "x"), (520, [None] * 16, 1, "x"), (540, [float("nan")] * 16, 1, "x"),
             (560, [float("inf")] * 16, 1, "x"), (40, rows[40][1], 1, "x"), (-20, [-0.2] * 16, 1, "x"), (580, [0.1] * 4, 1, "x")]
    flat = [r[:2] for r in rows]
    flat = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in flat]
    want = sorted(top_k([(i, v if v is None or len(v) == 16 else v + [0.0] * 12) for i, v in flat]), key=repr)
    assert search(spark, rows) == want
    assert search(spark, rows, block=17) == want


def test_top_k_few_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], 1, "x")]) == []
    assert search(spark, [(0, [1.0], 1, "x"), (1, [0.5], 1, "x")]) == [(0, 1, 1, 64 * 32)]


def test_maxscore_skips_yet_finds_all():
    rnd = np.random.default_rng(3)
    c = rnd.integers(-20, 20, (500, 32)).astype(float)
    q = rnd.integers(-20, 20, 32).astype(float)
    scores = c @ q
    limit = np.sort(scores)[-20]
    ids, got = maxscore.search_shard(q, -1, np.arange(500), np.ascontiguousarray(c.T), c.min(axis=0), c.max(axis=0), limit)
    assert set(ids) == set(np.flatnonzero(scores >= limit)) and (got == scores[ids]).all()


@pytest.mark.parametrize("rows", [corpus(7, 80, 200), corpus(8, 60), hard_rows()], ids=["many words", "few words", "hard"])
def test_near_duplicates(frame, rows):
    got = circulant.near_duplicates(frame(rows))
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == sorted(near(rows), key=repr)
    for r in got.filter("doc_id is not null").collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_links_that_miss_the_hub(frame):
    """A chain of gradual edits and a large group: components cross many hubs."""
    rnd = random.Random(9)
    w = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rnd.randrange(len(w))] = f"n{i}"
    base = [f"b{k}" for k in range(150)]
    for i in range(100, 180):
        v = list(base)
        for _ in range(rnd.randrange(4)):
            v[rnd.randrange(len(v))] = f"e{i}"
        rows.append((i, " ".join(v)))
    got = circulant.near_duplicates(frame(rows))
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == sorted(near(rows), key=repr)


def test_keep_one(frame, spark):
    rows = corpus(7, 80, 200)
    df = frame(rows)
    kept = circulant.keep_one(df)
    assert kept.columns == df.columns
    groups = {c for i, _, c in near(rows)}
    assert {r["doc_id"] for r in kept.collect()} == groups
    empty = spark.createDataFrame([], df.schema)
    assert circulant.keep_one(empty).count() == 0 and circulant.near_duplicates(empty).count() == 0


def test_pipeline_stage_joins_pairs_from_080(frame, spark):
    import corpus_pipeline
    words = [f"w{k}" for k in range(120)]
    near_080 = words[:60] + ["other", *words[61:100], "else", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(near_080))]
    assert {c for _, _, c in near(rows, 85)} == {1, 2} and {c for _, _, c in near(rows, 80)} == {1}
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(rows), "").collect()] == [1]
    rows = corpus(7, 80, 200)
    got = corpus_pipeline.near_duplicates(spark, frame(rows), "")
    assert {r["doc_id"] for r in got.collect()} == {c for _, _, c in near(rows, 80)}
    assert circulant.shape(85) == (16, 38) and circulant.shape(80)[0] > 16


def test_components_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (None, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_line_dedup(rows):
    """Occurrences by plain loops; only the boundaries come from the operator."""
    chunks = []
    for k, (i, t) in enumerate(rows):
        data = np.frombuffer((t or "").encode(), np.uint8)
        for c in zip(*line_chunks.chunks_of(data, np.array([0, len(data)]))):
            chunks.append((2**63 - 1 if i is None else i, k, int(c[1]), int(c[2]), bytes(data[c[3]:c[4]])))
    seen, gone = set(), {}
    for i, k, at, n, b in sorted(chunks, key=lambda c: (c[0], c[1], c[2])):
        if sum(1 for line in b.split(b"\n") if line.strip()) >= 2:
            if b in seen:
                gone.setdefault(k, set()).update(range(at, at + n))
            seen.add(b)
    out = []
    for k, (i, t) in enumerate(rows):
        lines = [] if t is None else t.split("\n")
        cut = gone.get(k, set()) if t is not None else set()
        out.append((i, None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in cut), len(lines), len(cut)))
    return out


def line_rows(seed):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(6))
    block = [[line() for _ in range(12)] for _ in range(3)]
    rows = []
    for i in range(50):
        t = [line() for _ in range(rnd.randint(0, 8))] + (rnd.choice(block) if rnd.random() < 0.7 else []) + [line() for _ in range(rnd.randint(0, 5))]
        rows.append((i, "\n".join(t) if i % 9 else "\n\n".join(t)))
    return rows


def test_line_dedup(frame):
    rows = line_rows(1) + [(100, None), (101, ""), (102, "\n"), (103, "\n\n\n\n"), (104, "x\n" * 500)]
    got = rows_of(line_chunks.line_dedup(frame(rows)))
    want = sorted(plain_line_dedup(rows), key=repr)
    assert got == want and sum(r[3] for r in got) > 50


def test_line_dedup_finds_every_repeated_run(frame):
    """Runs of two or more lines inside otherwise different documents, by lines alone."""
    rnd = random.Random(6)
    line = lambda: f"line {rnd.random()} of its own"
    runs = [[line() for _ in range(2 + k % 4)] for k in range(40)]
    runs[3].insert(1, "")
    rows = []
    for i in range(120):
        t = [line() for _ in range(rnd.randint(0, 4))] + runs[i % 40] + [line() for _ in range(rnd.randint(0, 4))]
        rows.append((i, "\n".join(t)))
    got = {r["doc_id"]: r for r in line_chunks.line_dedup(frame(rows)).collect()}
    for i, t in rows:
        left = [x for x in t.split("\n") if i < 40 or x not in runs[i % 40]]
        assert got[i]["text"] == "\n".join(left) and got[i]["n_removed"] == (len(runs[i % 40]) if i >= 40 else 0)


def test_line_dedup_boundaries_resist_shifts():
    rnd = random.Random(3)
    body = [f"line {rnd.random()}" for _ in range(200)]
    def chunks(lines):
        data = np.frombuffer("\n".join(lines).encode(), np.uint8)
        return {bytes(data[a:b]) for a, b in zip(*line_chunks.chunks_of(data, np.array([0, len(data)]))[3:5])}
    a, b = chunks(body), chunks(["new first line", *body])
    assert len(a & b) >= len(a) - 2


def test_line_dedup_edges(frame, spark):
    rows = hard_rows()
    got = line_chunks.line_dedup(frame(rows))
    assert got.count() == len(rows) and {r["text"] for r in got.collect()} == {t for _, t in rows}
    same = "one\ntwo two\nthree\nfour\nfive five\nsix\nseven"
    df = frame([(1, same), (2, same), (2, same), (None, same), (3, "alone")])
    out = line_chunks.dedup(df)
    assert out.columns == df.columns
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, same) in texts and (3, "alone") in texts and all(t != same for i, t in texts if i != 1)
    empty = spark.createDataFrame([], df.schema)
    assert line_chunks.dedup(empty).count() == 0
