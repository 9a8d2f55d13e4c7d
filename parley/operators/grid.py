"""Queries against a pool, block by block: both sides are dealt to the cells of a grid, so a
task holds one block of each whatever the tables' size, and nothing passes the driver."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

#: Pool blocks get smaller, down to this many rows, while there are idle partitions.
LEAST_ROWS = 256
#: Keys whose plan, one row each, is broadcast; beyond, it is joined by a shuffle.
SMALL_PLAN = 50_000


def cells(queries: DataFrame, pool: DataFrame, q_id: str, p_id: str, keys: list[str], q_rows: int, p_rows: int):
    """(grouped queries, grouped pool) for ``cogroup``: every pair of a query block of about
    ``q_rows`` and a pool block of about ``p_rows`` rows meets in one cell. With ``keys`` only
    blocks of one key do, and each key is cut by its own size: a row is copied as often as the
    other side of its own key has blocks, whatever other keys hold. Keys that one side lacks
    have no cell; null keys meet null keys."""
    return waves(queries, pool, q_id, p_id, keys, q_rows, p_rows)[0]


def waves(queries: DataFrame, pool: DataFrame, q_id: str, p_id: str, keys: list[str], q_rows: int, p_rows: int,
          size=None, most: int | None = None) -> list:
    """``cells`` dealt to waves by query block: what one wave sends, in the unit of ``size`` (a
    column expression, rows if none), stays near ``most`` or near what both sides hold, if that
    is more. A query's cells are all in one wave. One wave without ``most``."""
    # both sides may be one table: a column of its own each, or cogroup cannot tell them apart
    pool = pool.select(*[F.col(c).alias(c) for c in pool.columns])
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.lit(1) if size is None else size
    if keys:
        q, p, total, sent, blocks = _planned(queries, pool, keys, q_rows, p_rows, parts, size)
        qb, pb = F.col("_qn"), F.col("_pn")
    else:
        (nq, sq), (np_, sp) = (tuple(x.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()) for x in (queries, pool))
        blocks = max(1, -(-nq // q_rows))
        n = max(1, -(-np_ // p_rows), min(parts // blocks, np_ // LEAST_ROWS))
        q, p, qb, pb = queries, pool, F.lit(blocks), F.lit(n)
        total, sent = sq + sp, n * sq + blocks * sp
    count = 1 if most is None else min(blocks, max(1, -(-sent // max(1, total, most))))
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n, start=0, step=1: F.explode(F.sequence(F.lit(start), n - 1, F.lit(step)))
    q = q.withColumn("_qb", own(q_id, qb)).withColumn("_pb", each(pb))
    p = p.withColumn("_pb", own(p_id, pb))
    cell = [*keys, "_qb", "_pb"]
    out = []
    for wave in range(count):
        # blocks wave, wave + count, ... of each key
        qs = q if count == 1 else q.filter(F.pmod("_qb", F.lit(count)) == wave)
        ps = (p if count == 1 else p.filter(qb > wave)).withColumn("_qb", each(qb, wave, count))
        out.append(tuple(x.drop("_qn", "_pn").repartition(max(parts, 1), *cell).groupBy(*cell) for x in (qs, ps)))
    return out


def _planned(queries: DataFrame, pool: DataFrame, keys: list[str], q_rows: int, p_rows: int, parts: int, size):
    """Both sides with the numbers of blocks of their key, ``_qn`` and ``_pn``; then what they
    hold and what all their cells are sent, in the unit of ``size``, and the most query blocks."""
    names = [f"_key{i}" for i in range(len(keys))]

    def sizes(df, name):
        return df.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, names)]).agg(F.count(F.lit(1)).alias(name), F.sum(size).alias(name + "s"))

    a, b = sizes(queries, "_q"), sizes(pool, "_p")
    b = b.select(*[F.col(x).alias(x + "p") for x in names], "_p", "_ps")
    plan = keep(a.join(b, [F.col(x).eqNullSafe(F.col(x + "p")) for x in names]).select(
        *names, F.ceil(F.col("_q") / q_rows).cast("int").alias("_qn"), "_p", "_qs", "_ps"))
    m, all_blocks, blocks, total = plan.agg(F.count(F.lit(1)), F.sum("_qn"), F.max("_qn"), F.sum(F.col("_qs") + F.col("_ps"))).first()
    spread = parts // max(1, all_blocks or 1)  # idle partitions get smaller pool blocks
    plan = plan.withColumn("_pn", F.greatest(F.ceil(F.col("_p") / p_rows), F.least(F.lit(spread), F.floor(F.col("_p") / LEAST_ROWS)), F.lit(1)).cast("int"))

    def with_plan(df):
        one = plan.select(*[F.col(x).alias(x) for x in names], "_qn", "_pn")
        one = F.broadcast(one) if m <= SMALL_PLAN else one
        return df.join(one, [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, names)]).drop(*names)

    sent = plan.agg(F.sum(F.col("_pn") * F.col("_qs") + F.col("_qn") * F.col("_ps"))).first()[0]
    return with_plan(queries), with_plan(pool), total or 0, sent or 0, blocks or 1


def best_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of exactly the k best finite scores per row, ties at nine digits to the
    smaller id, so the cut does not depend on how the pool was dealt."""
    order = np.argsort(ids, kind="stable")
    s = np.round(scores[:, order], 9)
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if k < s.shape[1] else np.full((len(s), 1), -np.inf)
    rows, cols = np.nonzero((s >= kth) & np.isfinite(s))
    o = np.lexsort((cols, -s[rows, cols], rows))
    rows, cols = rows[o], cols[o]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], order[cols[place < k]]
