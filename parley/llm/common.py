"""Helpers shared by the operators of this subpackage: tables kept in the shared folder,
chunk assignment, and vectorised hashing of text that arrives in Arrow batches.

Hash names are 64-bit values computed from content alone, so every task on every executor
gives the same name to the same content without exchanging a dictionary.
"""
from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import checkpoint_dir, few_files

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
NULL_ID = np.iinfo(np.int64).max  # a null doc_id ranks after every other id
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only where a session on
    one machine names none (tests). A cluster that names none is an error."""
    return checkpoint_dir(spark)


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few MB at a time: a batch of Spark's 10,000 rows is held by
    the JVM and by the worker, in both directions and for each task. A number that the session
    chose itself stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def store(df: DataFrame, name: str, rows: int | None = None, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage, survives
    lost executors, and lets Spark drop the shuffle files of the job that made it. ``rows``,
    where the caller can tell about how many there are, bounds the number of files: the last
    stage runs in as many tasks or, if it is ``heavy``, hands its rows to them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    bound_batches(spark)
    files = None if rows is None else few_files(df, rows)
    if files is not None:
        df = df.repartition(files) if heavy else df.coalesce(files)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by ``store`` once no later job reads it."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left behind: Spark removes shuffle files and
    broadcasts once the driver has collected the plans that named them, and the collected
    heap goes back to the machine. For the end of a stage or round; the next one reads tables."""
    gc.collect()
    spark._jvm.System.gc()


def chunk_count(docs: DataFrame, chunk_bytes: int) -> int:
    """Number of chunks: one holds ``chunk_bytes`` of text at most on average, and less, to
    1 MB, where that keeps all shuffle partitions at work."""
    total = docs.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-int(total) // chunk_bytes), min(parts, int(total) >> 20))


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, text). The chunk depends on the row's content only, so every pass
    deals the rows alike; ids that many rows share still spread by their text."""
    return docs.select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the offsets of its rows; null
    counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off if len(off) else np.zeros(1, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values; a new array."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE_NAME = mix64(np.arange(1, 257, dtype=U))
#: Bytes that end a word: space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def split_spans(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one nonzero kind that do not cross a row's end: (start, end, row
    offsets of the runs). ``off`` are the rows' byte offsets, beginning at 0."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[0] = edge[n] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    inside = kind.astype(bool)
    start = np.flatnonzero(inside & edge[:-1])
    return start, np.flatnonzero(inside & edge[1:]) + 1, np.searchsorted(start, off)


def batches_of_rows(off: np.ndarray, size: int):
    """(first row, last row + 1) of groups of rows of about ``size`` bytes."""
    d = 0
    while d < len(off) - 1:
        e = max(d + 1, int(np.searchsorted(off, off[d] + size, side="right")) - 1)
        yield d, e
        d = e


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name per word data[start:end]: a multilinear hash of its bytes."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    coef = mix64(np.arange(1, int(length.max()) + 1, dtype=U) * GOLD + U(seed))
    at = np.zeros(len(data), U)
    base = np.zeros(len(data), np.int32 if len(data) < 2**31 else np.int64)
    # position inside the word, only meaningful inside words
    base[start] = start
    np.maximum.accumulate(base, out=base)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    where = np.flatnonzero(inside)
    at[where] = BYTE_NAME[data[where]] * coef[where - base[where]]
    return mix64(np.add.reduceat(at, start) + length.astype(U))


class Rolling:
    """Names of all substrings of a unit sequence whose length is a power of two, doubled
    from the names of half that length; any other length is read off by its binary digits."""

    def __init__(self, units: np.ndarray, longest: int):
        self.n, self.level, self.power = len(units), {1: units}, {1: GOLD}
        power = int(GOLD)
        p = 1
        while 2 * p <= longest:
            h = self.level[p]
            twice = h * self.power[p]
            twice[:max(0, self.n - p)] += h[p:]
            power = power * power % 2**64
            p *= 2
            self.level[p], self.power[p] = twice, U(power)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        """Names of units[start:start + length]; only valid where that lies inside."""
        out, skip = None, 0
        for p in sorted(self.level, reverse=True):
            while length - skip >= p:
                part = self.level[p][start + skip if skip else start]
                out = part if out is None else out * self.power[p] + part
                skip += p
        return mix64(out)

    def everywhere(self, length: int) -> np.ndarray:
        out, skip = None, 0
        for p in sorted(self.level, reverse=True):
            while length - skip >= p:
                if out is None:
                    out = self.level[p].copy()
                else:
                    out *= self.power[p]
                    out[:max(0, self.n - skip)] += self.level[p][skip:]
                skip += p
        return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) at i, by doubling; entries whose window leaves x are not valid."""
    m, p = x, 1
    while 2 * p <= width:
        m2 = m.copy()
        np.minimum(m[:len(m) - p], m[p:], out=m2[:len(m) - p])
        m, p = m2, 2 * p
    if p < width:
        q = width - p
        m2 = m.copy()
        np.minimum(m[:len(m) - q], m[q:], out=m2[:len(m) - q])
        m = m2
    return m
