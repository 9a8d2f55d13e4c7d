"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources form a pattern; Spark sums their words. Each source
gets a target in proportion to its weight, at most ``MOST`` times its size, what exceeds that
being shared among the others. A flow routes the patterns' words to the targets of their
sources: the r-th use of a pattern's words costs 2 r - 1, so repetition is spread evenly and
used only where needed. Patterns that share no source, even through others, are solved apart,
each group of connected ones in a task of its own, from one row per pattern and source.

A pattern that shall give f of its c words takes all its documents f // c times. The other
f % c words come from its documents in the order of a seeded key: key ranges are summed and
the range in which the words run out is split again, until it holds at most ``POOL`` rows,
whatever the size of the pattern. Ranges below it are taken whole; in that last one each
document is taken that still fits. Documents are never cut.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a null
doc_id draws like any other id, a row without sources gives nothing. Repeated rows count each;
their order among each other changes no result. Very long texts stay whole, so a target
smaller than its smallest document may get nothing. Empty tables give no row. Other columns
are not read.
"""
from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.components import connected_components
from parley.operators.ranking import dense_numbers

from .common import drop_stored, store

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 42
POOL, BIN_BITS, KEY_BITS, COPY_BITS = 4096, 4, 62, 18
#: One row per pattern is broadcast up to so many patterns, and joined by a shuffle beyond.
BROADCAST_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, sources, size) of documents with one source each."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(F.col(source).cast("string")).alias("sources"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(patterns: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, key, weight, source_size, target) from (sources, words): ``share`` of all words
    by weight, ``weights`` repeating over the sources by code point."""
    one = patterns.select(F.explode("sources").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = dense_numbers(one, "source").select(source_key(F.col("source")).alias("key"), weight.alias("weight"))
    out = store(one.withColumn("key", source_key(F.col("source"))).join(numbered, "key"), "sources")
    total = share * (patterns.agg(F.sum("words").alias("w")).first()["w"] or 0)
    full = F.col("source_size").cast("double") * F.lit(float(most))
    level = -1.0
    while True:  # every round fixes more sources at their limit, or is the last
        low = full < F.col("weight") * F.lit(level)
        s = out.agg(F.sum(F.when(low, full)).alias("fixed"), F.sum(F.when(~low, F.col("weight"))).alias("w")).first()
        new = (total - (s["fixed"] or 0.0)) / s["w"] if s["w"] else level
        if new == level:
            break
        level = new
    return out.withColumn("target", F.least(full, F.col("weight") * F.lit(level)))


class Flow:
    """Min-cost flow by shortest paths: all paths of the least cost are filled at once, then
    the distances are taken anew."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, s: int) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[s], queue, waiting = 0, deque([s]), {s}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in self.out[u]:
                v = self.to[e]
                if self.room[e] and far[u] + self.cost[e] < far[v]:
                    far[v] = far[u] + self.cost[e]
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        return far

    def run(self, s: int, t: int) -> None:
        while (far := self._distances(s))[t] < float("inf"):
            nxt, path, on = [0] * len(self.out), [], {s}
            u = s
            while True:
                if u == t:
                    k = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= k
                        self.room[e ^ 1] += k
                    u, path, on = s, [], {s}
                    continue
                while nxt[u] < len(self.out[u]):
                    e = self.out[u][nxt[u]]
                    v = self.to[e]
                    if self.room[e] and far[v] == far[u] + self.cost[e] and v not in on:
                        break
                    nxt[u] += 1
                else:
                    if u == s:
                        break
                    on.discard(u)
                    u = self.to[path.pop() ^ 1]
                    nxt[u] += 1
                    continue
                path.append(e)
                u = v
                on.add(u)


def route(patterns: list[tuple[str, int, list[str]]], quota: dict[str, int], most: int = MOST) -> dict[str, dict[str, int]]:
    """Words that each pattern (name, words, sources) gives to each of its sources."""
    patterns, names = sorted(patterns), sorted(quota)
    node = {k: 1 + len(patterns) + i for i, k in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    flow = Flow(end + 1)
    arcs = []
    for i, (name, words, sources) in enumerate(patterns):
        for r in range(most):
            flow.arc(0, 1 + i, words, 2 * r + 1)
        arcs += [(name, k, flow.arc(1 + i, node[k], most * words)) for k in sorted(set(sources))]
    for k in names:
        flow.arc(node[k], end, quota[k])
    flow.run(0, end)
    out: dict[str, dict[str, int]] = {name: {} for name, _, _ in patterns}
    for name, k, e in arcs:
        out[name][k] = flow.room[e ^ 1]
    return out


def routed(patterns: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(pattern, words, given) for patterns (pattern, sources, words): the flow, one task per
    group of patterns that are connected by sources."""
    pairs = patterns.select("pattern", "words", F.explode("sources").alias("_s")).select("pattern", "words", source_key(F.col("_s")).alias("key"))
    first = F.min("key").over(Window.partitionBy("pattern"))
    tied = pairs.withColumn("first", first)
    links = tied.filter("key <> first")
    if links.isEmpty():
        tied = tied.withColumn("part", F.col("first"))
    else:
        parts = connected_components(links, "key", "first").select(F.col("node").alias("first"), F.col("component").alias("part"))
        tied = tied.join(parts, "first", "left").withColumn("part", F.coalesce("part", "first"))
    tied = tied.join(goals.select("key", F.round("target").cast("long").alias("quota")), "key")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sources = rows.groupby("pattern")["key"].agg(list)
        words = rows.groupby("pattern")["words"].first()
        given = route([(p, int(words[p]), sources[p]) for p in words.index], dict(zip(rows["key"], map(int, rows["quota"]))), most)
        return pd.DataFrame({"pattern": list(given), "words": [int(words[p]) for p in given], "given": [sum(g.values()) for g in given.values()]})

    return tied.select("part", "pattern", "words", "key", "quota").groupBy("part").applyInPandas(solve, "pattern string, words long, given long")


def _with_state(rows: DataFrame, state: DataFrame, patterns: int) -> DataFrame:
    return rows.join(F.broadcast(state) if patterns <= BROADCAST_PATTERNS else state, "pattern")


def _narrowed(rows: DataFrame, state: DataFrame, patterns: int, pool: int, bits: int) -> DataFrame:
    """``state`` (pattern, base, rest, low, high, n) with the key range [low, high) in which the
    rest of the words runs out narrowed to at most ``pool`` rows."""
    shift = KEY_BITS
    while shift and state.filter((F.col("rest") > 0) & (F.col("n") > pool)).limit(1).count():
        shift = max(0, shift - bits)
        open_ = (F.col("rest") > 0) & (F.col("n") > pool)
        inside = _with_state(rows, state.filter(open_).select("pattern", "low", "high"), patterns) \
            .filter((F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")))
        bins = inside.groupBy("pattern", F.shiftright(F.col("key") - F.col("low"), shift).alias("bin")) \
            .agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("m"))
        w = Window.partitionBy("pattern").orderBy("bin")  # at most 2 ** bits rows
        bins = bins.withColumn("before", F.sum("s").over(w) - F.col("s"))
        cut = bins.join(state.select("pattern", "rest"), "pattern") \
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s"))).drop("rest", "s")
        step = F.lit(1 << shift)
        low = F.col("low") + F.col("bin") * step
        last, state = state, store(state.join(cut, "pattern", "left").select(
            "pattern", "base", F.when(F.col("bin").isNotNull(), F.col("rest") - F.col("before")).otherwise(F.col("rest")).alias("rest"),
            F.coalesce(low, "low").alias("low"), F.coalesce(low + step, "high").alias("high"), F.coalesce("m", "n").alias("n")), "mix")
        drop_stored(last)
    return state


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take documents by key while they fit; at the end one more if that comes nearer."""
    rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
    rest, took = int(rows["rest"][0]), [False] * len(rows)
    for i, size in enumerate(rows["size"]):
        if size <= rest:
            took[i], rest = True, rest - int(size)
    left = [(int(size), i) for i, size in enumerate(rows["size"]) if not took[i]]
    if left and abs(rest - min(left)[0]) < rest:
        took[min(left)[1]] = True
    return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "pattern": rows["pattern"], "size": rows["size"],
                         "taken": rows["size"] * (rows["base"] + took)})


def mix(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = SEED,
        pool: int = POOL, bits: int = BIN_BITS) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, sources, size): (doc_id, sources, size, taken) per row, and the sources'
    targets as ``targets`` gives them. taken is a multiple of size, at most ``most`` times it."""
    names = F.array_sort(F.array_distinct("sources"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 64 - KEY_BITS + COPY_BITS)
    copy = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - COPY_BITS)
    rows = store(rows.select("doc_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.to_json(names), F.lit("[]")).alias("pattern"),
                             names.alias("sources"), F.shiftleft(draw, COPY_BITS).bitwiseOR(copy).alias("key")), "mix-rows")
    patterns = store(rows.groupBy("pattern").agg(
        F.first("sources").alias("sources"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "patterns")
    goals = targets(patterns, weights, most, share)
    flows = routed(patterns, goals, most)
    some = F.col("words") > 0
    given = F.coalesce("given", F.lit(0))
    state = store(patterns.select("pattern", "n").join(flows, "pattern", "left").select(
        "pattern", F.when(some, F.floor(given / F.col("words"))).otherwise(0).cast("long").alias("base"),
        F.when(some, given % F.col("words")).otherwise(0).cast("long").alias("rest"),
        F.lit(0).cast("long").alias("low"), F.lit(1 << KEY_BITS).alias("high"), "n"), "mix")
    count = state.count()
    state = _narrowed(rows, state, count, pool, bits)
    state = state.withColumn("high", F.when(F.col("rest") > 0, F.col("high")).otherwise(F.col("low")))
    all_ = _with_state(rows.drop("sources"), state.drop("n"), count)
    last = (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))
    taken = F.col("size") * (F.col("base") + (F.col("key") < F.col("low")).cast("long"))
    whole = all_.filter(~last).select("doc_id", "pattern", "size", taken.alias("taken"))
    edge = all_.filter(last).select("doc_id", "pattern", "size", "key", "base", "rest").groupBy("pattern") \
        .applyInPandas(_fill, "doc_id long, pattern string, size long, taken long")
    out = whole.unionByName(edge).select(
        "doc_id", F.from_json("pattern", "array<string>").alias("sources"), "size", "taken")
    return out, goals


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for documents with one source each."""
    out, goals = mix(sized(docs), **options)
    goals = goals.select("key", "source_size", "target")
    few = goals.count() <= BROADCAST_PATTERNS
    return out.withColumn("key", source_key(F.col("sources")[0])).join(F.broadcast(goals) if few else goals, "key") \
        .select("doc_id", "size", "source_size", "target", "taken")
