"""Exact top-k by inner product with MaxScore over sharded postings.

Each vector component is a term with an integer weight; a shard (block of candidates) keeps
one posting column per term and the term's least and greatest weight, which bound what the
term can add to any score of the shard. For a query, terms are ordered by bound. With the
k-th best score so far as threshold, the trailing terms whose bounds together cannot lift a
candidate over it, given what the leading ones gave, are non-essential: the essential
postings are traversed for the whole shard, and the others are probed a few at a time for
the candidates whose partial score plus remaining bound still reaches the threshold
(reaching it counts, for ties go to smaller ids). Shards of one task share the threshold;
the results of all tasks merge by rank.

Queries and candidates meet as blocks on a grid, so a task holds one query block and one
group of candidate blocks, whatever the table's size.

Rows with a null id, a null vector, or a null or non-finite component take no part. Rows
that repeat an id collapse to the least vector. Shorter vectors are padded with zeros. Other
columns are not read. An empty table gives no row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK, GROUP, QUERY_BLOCK, PROBE = 8192, 8, 1024, 8
EXACT = 2.0 ** 53
HITS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) per component."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _blocks(rows: DataFrame, blocks: int, dims: int) -> DataFrame:
    """(block, ids binary, data binary): ids ascending, int32 or int64 rows of ``dims``."""

    def pack(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        m = np.zeros((len(ids), dims), np.int64)
        v = t.column("v").combine_chunks()
        size = v.value_lengths().to_numpy()
        r = np.repeat(np.arange(len(ids)), size)
        m[r, np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
        o = np.lexsort((*m.T[::-1], ids))
        ids, m = ids[o], m[o]
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        return pa.table({"block": t.column("block")[:1], "ids": pa.array([ids[first].tobytes()], pa.binary()),
                         "data": pa.array([m[first].tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(lambda t: pack(t), "block int, ids binary, data binary")


def _unpack(t: pa.Table, dims: int):
    for ids, data in zip(t.column("ids").to_pylist(), t.column("data").to_pylist()):
        yield np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dims)


def _best(score, ids, k):
    """Positions of the k best by (score descending, id)."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        pick = np.flatnonzero(score >= cut)
    else:
        pick = np.arange(len(score))
    return pick[np.lexsort((ids[pick], -score[pick]))][:k]


def search_shard(q: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, low, high, threshold: float):
    """Candidates of one shard that may reach ``threshold``, with their exact scores.
    ``postings``: one row per term; ``low``, ``high``: least and greatest weight of each."""
    bound = np.where(q > 0, q * high, q * low)
    order = np.argsort(-(bound - np.where(q > 0, q * low, q * high)), kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
    total = rest[0]
    if total < threshold:
        return ids[:0], np.zeros(0, postings.dtype)
    # essential: the leading terms holding half of what separates the best bound from the threshold
    floor = np.cumsum((bound - np.where(q > 0, q * low, q * high))[order])
    essential = len(order) if threshold == -np.inf else min(len(order), int(np.searchsorted(floor, total - threshold)) + PROBE)
    lead = order[:essential]
    partial = q[lead] @ postings[lead]
    alive = np.flatnonzero((partial + rest[essential] >= threshold) & (ids != own))
    partial = partial[alive]
    at = essential
    while at < len(order) and len(alive):
        step = order[at:at + PROBE]
        partial = partial + q[step] @ postings[np.ix_(step, alive)]
        at += len(step)
        stay = partial + rest[min(at, len(order))] >= threshold
        alive, partial = alive[stay], partial[stay]
    return ids[alive], partial


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product per
    query, ties to smaller ids, the query's own id left out. Inputs: (vec_id, v)."""
    spark = candidates.sparkSession
    size = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m")).first()
    cs, qs = size(candidates), size(queries)
    dims = max(cs["d"] or 0, qs["d"] or 0, 1)
    kind = np.float64 if float(cs["m"] or 0) * float(qs["m"] or 0) * dims < EXACT else np.int64
    blocks, qblocks = max(1, -(-cs["n"] // block)), max(1, -(-qs["n"] // QUERY_BLOCK))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-blocks // GROUP), min(blocks, -(-parts // qblocks)))
    q = _blocks(queries, qblocks, dims).withColumnRenamed("block", "qb").withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = _blocks(candidates, blocks, dims).withColumn("cg", F.pmod("block", F.lit(groups))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))

    def search(qt: pa.Table, ct: pa.Table) -> pa.Table:
        hits = ([], [], [])
        shards = []
        for ids, m in sorted(_unpack(ct, dims), key=lambda x: -len(x[0])):
            shards.append((ids, np.ascontiguousarray(m.T.astype(kind)), m.min(axis=0).astype(kind), m.max(axis=0).astype(kind)))
        for qids, qm in _unpack(qt, dims):
            for own, vec in zip(qids.tolist(), qm.astype(kind)):
                best_ids, best, threshold = np.zeros(0, np.int64), np.zeros(0, kind), -np.inf
                for ids, postings, low, high in shards:
                    got, score = search_shard(vec, own, ids, postings, low, high, threshold)
                    if len(got):
                        best_ids, best = np.concatenate([best_ids, got]), np.concatenate([best, score])
                        pick = _best(best, best_ids, k)
                        best_ids, best = best_ids[pick], best[pick]
                        threshold = best[-1] if len(best) == k else -np.inf
                hits[0].append(np.full(len(best), own)), hits[1].append(best_ids), hits[2].append(best.astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(h) if h else [], pa.int64()) for n, h in zip(("query_id", "vec_id", "score"), hits)})

    grid = max(parts, 1)
    found = q.repartition(grid, "qb", "cg").groupBy("qb", "cg").cogroup(
        c.repartition(grid, "qb", "cg").groupBy("qb", "cg")).applyInArrow(lambda a, b: search(a, b), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
