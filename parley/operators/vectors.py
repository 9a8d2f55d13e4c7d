"""Dense vectors: dot/cosine expressions, exact top-k similarity join, random-pair
threshold calibration, centroids (X20, V3, V4, V5, V8, T5).

The exact top-k deals queries and pool to the cells of a grid (``grid.cells``); each cell
multiplies one query block with one pool block and keeps exactly k rows per query, and a
bounded ``row_number() <= k`` per query merges the cells (WindowGroupLimit keeps at most k
rows per query and partition before the shuffle).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import grid
from .grid import best_k, cells

Q_ROWS, P_ROWS = 4096, 8192  # rows of a query block and of a pool block
STEP = 128                   # queries scored at once inside a cell: a few copies of STEP x P_ROWS scores

# Functions shipped to Python workers (cell functions) are pickled by value,
# so executors need numpy/pandas but not this package on their path.
import sys as _sys
from pyspark import cloudpickle as _cloudpickle
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
_cloudpickle.register_pickle_by_value(grid)



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# X20 --------------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


# V3 ---------------------------------------------------------------------------
def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    m = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def topk_dense(queries: DataFrame, pool: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
               key_col: str | None = None, exclude_self: bool = True, q_rows: int = Q_ROWS, p_rows: int = P_ROWS) -> DataFrame:
    """Exact top-k cosine neighbours of every query in ``pool``; ``rank`` is 0-based,
    ties (scores equal at nine digits) go to the smaller pool id. With ``key_col`` a query
    only meets pool rows with the same key (per-class pools, V4). Vectors of one table have
    one length."""
    keys = [key_col] if key_col else []
    q, p = cells(queries.select(id_col, vec_col, *keys), pool.select(id_col, vec_col, *keys), id_col, id_col, keys, q_rows, p_rows)

    def score(qt: pa.Table, pt: pa.Table) -> pa.Table:
        out = []
        if len(qt) and len(pt):
            q_ids, p_ids = (t.column(id_col).to_numpy() for t in (qt, pt))
            q_mat, p_mat = _matrix(qt.column(vec_col)), _matrix(pt.column(vec_col))
            for a in range(0, len(q_ids), STEP):  # bounds the score block
                sims = q_mat[a:a + STEP] @ p_mat.T
                if exclude_self:
                    sims[q_ids[a:a + STEP, None] == p_ids[None, :]] = -np.inf
                rows, cols = best_k(sims, p_ids, k)
                out.append((q_ids[a + rows], p_ids[cols], sims[rows, cols]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q_id", "n_id", "cos"), cols, (kind, kind, pa.float64()))})

    id_type = dict(pool.dtypes)[id_col]
    kind = to_arrow_type(pool.schema[id_col].dataType)
    cand = q.cogroup(p).applyInArrow(lambda a, b: score(a, b), f"q_id {id_type}, n_id {id_type}, cos double")
    w = Window.partitionBy("q_id").orderBy(F.round("cos", 9).desc(), F.asc("n_id"))
    # the filter must name row_number itself for Spark to cut each partition before the shuffle
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


# V5 ---------------------------------------------------------------------------
def calibrate(pool: DataFrame, id_col: str, vec_col: str, n_pairs: int = 20000, pctile: float = 0.95,
              seed: int = 0, key_col: str | None = None) -> DataFrame:
    """Threshold = exact ``pctile`` (linear interpolation) and mean of random-pair
    cosine within the pool, or within each pool of ``key_col``. Pair i joins the i-th row of
    two independent md5 orders; self pairs are dropped. Both sides are top-n draws of at most
    ``n_pairs`` rows a pool."""
    keys = [F.col(key_col).alias("_key")] if key_col else [F.lit(0).alias("_key")]

    def side(tag):
        o = pool.select(*keys, F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"),
                        F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col(id_col).cast("string"))).alias("_o"))
        i = F.row_number().over(Window.partitionBy("_key").orderBy("_o", "_id"))
        return o.withColumn("_i", i).filter(F.col("_i") <= n_pairs)
    a = side("a").select("_key", F.col("_i"), F.col("_id").alias("a_id"), F.col("_v").alias("a_v"))
    b = side("b").select("_key", F.col("_i"), F.col("_id").alias("b_id"), F.col("_v").alias("b_v"))
    pairs = a.join(b, ["_key", "_i"]).filter(F.col("a_id") != F.col("b_id"))
    s = pairs.select("_key", cosine("a_v", "b_v").alias("s"))
    g = s.groupBy("_key") if key_col else s
    out = g.agg(F.percentile("s", pctile).alias("tau"), F.avg("s").alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))
    return out.withColumnRenamed("_key", key_col) if key_col else out


# V8 ---------------------------------------------------------------------------
def centroids(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """Mean vector per key: one posexplode + grouped average per dimension, then the
    dimensions are reassembled in order."""
    ex = df.select(key, F.posexplode(vec_col).alias("_pos", "_x"))
    g = ex.groupBy(key, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_s"),
                              F.count(F.lit(1)).alias("_dims")) \
        .select(key, F.transform("_s", lambda s: s["_m"]).alias("centroid"))


def describe_clusters(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """Centroid, size and share of all rows per cluster."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    total = n.agg(F.sum("size")).scalar()
    return centroids(df, key, vec_col).join(n, key).withColumn("share", F.round(F.col("size") / total, 6))


def nearest_to_centroid(df: DataFrame, key: str, id_col: str, vec_col: str, n: int = 10) -> DataFrame:
    """Members closest to their key's centroid by true cosine (T5)."""
    c = centroids(df, key, vec_col)
    j = df.select(key, id_col, vec_col).join(c, key)
    j = j.withColumn("cos_centroid", cosine(vec_col, "centroid"))
    w = Window.partitionBy(key).orderBy(F.desc("cos_centroid"), id_col)
    return j.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < n) \
        .select(key, id_col, "cos_centroid", "rank")
