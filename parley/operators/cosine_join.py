"""Exact self-join of vectors by a cosine threshold (J11 on embeddings).

Equal vectors form a class first and meet others once. Pivots, chosen further apart than twice
the threshold's angle from the classes with the least hashes of their ids, cut the sphere into
cells: a vector's home is the cell of its nearest pivot. Two vectors within the threshold's angle either share their home, or both lie within
that angle of the great circle that parts their homes' pivots, by the triangle inequality. So
a vector goes as a guest to those cells of a smaller number whose border is that near, and
every pair meets once, in the smaller home. Cells are cut into blocks, and each task compares
one block of homes with one block of homes and guests. How far rows are replicated depends on
the data: tight groups go to about one cell, vectors without structure to many. So as many
pivots are taken as copy the fewest rows by a drawn sample; where cells part nothing, few cells
in large blocks remain, and the blocks bound a task all the same.

Similarities are compared at nine digits. Vectors that are null, hold null or non-finite
components or have no direction take no part.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

THRESHOLD = 0.95
#: Pivots at most, rows per pivot below that, rows of a block, and vectors per pivot that are
#: drawn to choose from: at most SAMPLE * PIVOTS vectors pass the driver.
PIVOTS, CELL_ROWS, BLOCK_ROWS, SAMPLE = 1024, 512, 1 << 14, 4
#: Bytes of a block's vectors, and rows of it that are compared at once.
BLOCK_BYTES, STEP = 1 << 25, 256
#: More pivots are taken as long as they copy at most this many times the fewest rows.
NEAR_FEWEST = 1.25


def vector_classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, size, vec): one row per distinct usable vector, named by its least id."""
    v = F.col(vec_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(v.isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")) \
        .groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).select("id", "size", "vec")


def _unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _apart(vectors: list[np.ndarray], cosine: float, most: int) -> np.ndarray:
    """Unit vectors of which no two have that cosine or more, in the given order."""
    out = np.zeros((0, len(vectors[0])))
    for v in vectors:
        v = v / np.linalg.norm(v)
        if len(out) < most and (not len(out) or (out @ v).max() < cosine):
            out = np.vstack([out, v])
    return out


def _visits(m: np.ndarray, p: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home of each unit vector, whether it visits each cell), its home included."""
    near = m @ p.T
    home = near.argmax(1)
    at = near[np.arange(len(m)), home]
    visits = (at[:, None] - near <= border[home]) & (np.arange(len(p)) < home[:, None])
    visits[np.arange(len(m)), home] = True
    return home, visits


def _borders(p: np.ndarray, threshold: float) -> np.ndarray:
    apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))  # lengths of p_h - p_q
    return np.sqrt(1 - threshold * threshold) * apart + 1e-9


def _pivots(drawn: list[np.ndarray], n: int, threshold: float, most: int, block_rows: int) -> np.ndarray:
    """The pivots by which ``n`` vectors like the drawn ones are copied least."""
    p = _apart(drawn, 2 * threshold * threshold - 1, most)
    sample = np.array([v / np.linalg.norm(v) for v in drawn])
    copies = {}
    for m in {1 << k for k in range(len(p).bit_length())} | {len(p)}:
        rows = n * _visits(sample, p[:m], _borders(p[:m], threshold))[1].sum(1).mean()
        copies[m] = rows + n * np.ceil(rows / m / block_rows) + rows * np.ceil(n / m / block_rows)
    return p[:max(m for m, c in copies.items() if c <= NEAR_FEWEST * min(copies.values()))]


def _block_rows(vector: np.ndarray, block_rows: int) -> int:
    return max(1, min(block_rows, BLOCK_BYTES // (8 * len(vector))))


def dealt(classes: DataFrame, threshold: float, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cell, home, id, size, vec): every class once at home and once in each cell it visits;
    ``vec`` holds the unit vector's bytes."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    n = classes.count()
    most = max(1, min(pivots, n // cell_rows))
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("vec").collect()
    if not drawn:
        return classes.select(F.lit(0).alias("cell"), F.lit(True).alias("home"), "id", "size", F.lit(b"").alias("vec")).limit(0)
    drawn = [np.array(r["vec"], np.float64) for r in drawn]
    p = _pivots(drawn, n, threshold, most, _block_rows(drawn[0], block_rows))
    border = _borders(p, threshold)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _unit(batch.column("vec"))
            home, visits = _visits(m, p, border)
            row, cell = np.nonzero(visits)
            raw = [x.tobytes() for x in m]
            ids, sizes = batch.column("id").to_numpy(), batch.column("size").to_numpy()
            for a in range(0, len(row), 1 << 14):
                r, c = row[a:a + (1 << 14)], cell[a:a + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(c == home[r]), pa.array(ids[r]), pa.array(sizes[r]), pa.array([raw[i] for i in r], pa.binary())],
                    names=["cell", "home", "id", "size", "vec"])

    return classes.mapInArrow(deal, "cell int, home boolean, id long, size long, vec binary")


def _compared(classes: DataFrame, threshold: float, each, schema: str, pivots: int, cell_rows: int, block_rows: int) -> DataFrame:
    """``each(left, right, x, y)`` over the linked rows (x, y) of every two blocks that meet."""
    rows = keep(dealt(classes, threshold, pivots, cell_rows, block_rows))
    one = rows.select("vec").first()
    block_rows = _block_rows(np.frombuffer(one["vec"]), block_rows) if one else block_rows
    blocks = lambda c: F.greatest(F.ceil(c / F.lit(block_rows)), F.lit(1)).cast("int")
    plan = rows.groupBy("cell").agg(blocks(F.count_if("home")).alias("l"), blocks(F.count(F.lit(1))).alias("r"))
    rows = rows.join(F.broadcast(plan), "cell")  # one row per pivot
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "i", "j", "home", "id", "size", "vec"]
    left = rows.filter("home").withColumn("i", own("l")).withColumn("j", every("r")).select(*columns)
    right = rows.withColumn("j", own("r")).withColumn("i", every("l")).select(*[F.col(c).alias(c) for c in columns])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        la, lb = ({c: t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "id", "size")} for t in (a, b))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if a.num_rows and b.num_rows:
            va, vb = (np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(t.num_rows, -1) for t in (a, b))
            for k in range(0, len(va), STEP):
                cosine = va[k:k + STEP] @ vb.T
                x, y = np.nonzero(cosine >= threshold - 1e-8)
                linked = (np.round(cosine[x, y], 9) >= threshold) & (la["id"][x + k] != lb["id"][y])
                xs.append(x[linked] + k)
                ys.append(y[linked])
        return each(la, lb, np.concatenate(xs), np.concatenate(ys))

    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(lambda a, b: run(a, b), schema)


def cosine_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float = THRESHOLD,
                 pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b), a < b: the classes of equal vectors, by their least ids, whose cosine reaches the
    threshold."""

    def each(left, right, x, y):
        once = ~right["home"][y] | (left["id"][x] < right["id"][y])
        one, two = left["id"][x[once]], right["id"][y[once]]
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    return _compared(vector_classes(df, id_col, vec_col), threshold, each, "a long, b long", pivots, cell_rows, block_rows)


def cosine_links(df: DataFrame, id_col: str, vec_col: str, threshold: float = THRESHOLD,
                 pivots: int = PIVOTS, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, class_id, n_links) of every row: the least id with the same vector, and the number of
    other rows whose cosine with it reaches the threshold. Links are counted where they are
    found, so a group of copies makes no row per pair. Rows that take no part are their own
    class without links."""

    def each(left, right, x, y):
        guest = ~right["home"][y]
        ids = np.concatenate([left["id"][x], right["id"][y[guest]]])
        more = np.concatenate([right["size"][y], left["size"][x[guest]]])
        one, at = np.unique(ids, return_inverse=True)
        return pa.table({"id": pa.array(one, pa.int64()), "n": pa.array(np.bincount(at, weights=more, minlength=len(one)).astype(np.int64))})

    classes = keep(vector_classes(df, id_col, vec_col))
    found = _compared(classes, threshold, each, "id long, n long", pivots, cell_rows, block_rows)
    total = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(total, "id", "left").select(F.col("vec").alias("_vec"), F.col("id").alias("class_id"),
                                                     (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("_v"))
    return rows.join(named, F.col("_v") == F.col("_vec"), "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
