"""Sources and sinks."""
from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import latest_per_key

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

MESSAGE_COLUMNS = ["tweet_id", "author_id", "inbound", "response_tweet_id", "in_response_to_tweet_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; parquet, so projections and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# S1 / S2 -------------------------------------------------------------------------
def read_messages_csv(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """Raw message CSV, every column a string (ids must never become numbers), pruned
    to the fixed columns plus ``extra``; ``inbound`` normalized to boolean. Columns are found
    by the header's names, in any order and among any others; a missing one fails.
    Quoted line breaks make a file one task: give many files, or convert once."""
    cols = MESSAGE_COLUMNS + list(extra)
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True) \
        .option("escape", '"').csv(path)
    from ..functions.text import text_flag
    return df.select(*cols).withColumn("inbound", text_flag("inbound"))


def read_typed_csv(spark: SparkSession, path: str, string_cols: Sequence[str],
                   fill_blank: Sequence[str] = ()) -> DataFrame:
    """CSV with the named columns forced to string and blanks in ``fill_blank`` as ''."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in string_cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df.na.fill({c: "" for c in fill_blank})


# S3 ---------------------------------------------------------------------------
def lenient_numeric(df: DataFrame, cols: Sequence[str], to: str = "int") -> DataFrame:
    """Dirty score columns: values that do not parse become NULL."""
    for c in cols:
        df = df.withColumn(c, F.col(c).try_cast(to))
    return df


# S4 / S5 -------------------------------------------------------------------------
def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Deliverable CSV; array columns are serialized as JSON text first."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# S6 / S7 -------------------------------------------------------------------------
def read_label_log(spark: SparkSession, path: str, key: str, schema: T.StructType | None = None,
                   model: str | None = None) -> DataFrame:
    """Append-only JSON-lines label log; the latest ``(batch, seq)`` per key wins. Blank lines
    are skipped by the reader. With ``model`` set, only that model's partition is read
    (``partitionBy('model')``), so labels from different models never mix."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    if model is not None:
        df = df.filter(F.col("model") == model)
    df = df.filter(F.col(key).isNotNull())
    batch = [F.col("batch").desc_nulls_last()] if "batch" in df.columns else []
    return latest_per_key(df, key, [*batch, F.col("seq").desc()])


def append_label_log(df: DataFrame, path: str, batch: int | None = None, position: str | None = None) -> None:
    """Append records so that later ones win: ``batch`` (by default the time in ms) orders
    appends, ``seq`` the records of one append. File order is not defined on a distributed
    file set, so ``seq`` is the caller's ``position`` column; without one it follows the
    frame's partitions and is unique, which orders records only if partitions are."""
    import time
    out = df.withColumn("seq", F.col(position).cast("bigint") if position else F.monotonically_increasing_id()) \
        .withColumn("batch", F.lit(int(time.time() * 1000) if batch is None else batch))
    w = out.write.mode("append")
    if "model" in out.columns:
        w = w.partitionBy("model")
    w.json(path)


# S8 ---------------------------------------------------------------------------
def config_key(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def rules_hash(*rules) -> str:
    """Fingerprint of rules given as plain data or objects of plain data, by value: the same for
    equal content in any process. Sets and mappings count without order, sequences with it."""
    def plain(x):
        if isinstance(x, dict):
            return ["map", *sorted(([plain(k), plain(v)] for k, v in x.items()), key=repr)]
        if isinstance(x, (set, frozenset)):
            return ["set", *sorted(map(plain, x), key=repr)]
        if isinstance(x, (list, tuple)):
            return ["list", *map(plain, x)]
        if isinstance(x, (str, bytes, int, float, bool)) or x is None:
            return [type(x).__name__, repr(x)]
        if hasattr(x, "pattern") and hasattr(x, "flags"):
            return ["re", x.pattern, int(x.flags)]
        if hasattr(x, "__dict__"):
            return [type(x).__name__, plain(vars(x))]
        raise TypeError(f"no fingerprint by value for {type(x).__name__}")

    return hashlib.sha256(repr(plain(rules)).encode()).hexdigest()[:16]


def files_hash(spark: SparkSession, *paths: str) -> str:
    """Fingerprint of the files under ``paths``: path, length and time of change of each, listed by
    Spark's file layer and combined in one aggregation; no content is read. A missing path fails."""
    from pyspark.errors import AnalysisException
    h = F.xxhash64("path", "length", "time")
    other = F.xxhash64("time", "length", "path").cast("decimal(38,0)")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)) \
            .select("path", "length", F.unix_micros("modificationTime").alias("time"))
    except AnalysisException as e:
        raise FileNotFoundError(f"no input under {paths}") from e
    n, x, y = files.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(other)).first()
    return hashlib.sha256(f"{n},{x},{y}".encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, name: str, rules, inputs: Sequence[str], build) -> DataFrame:
    """``build()`` kept under ``root`` for as long as ``rules`` and the files under ``inputs`` stay
    as they are: a changed rule, or an added, changed or removed file, builds anew. Results for
    earlier keys stay in their own folders."""
    return read_through(spark, root, f"{name}-{config_key(rules_hash(rules), files_hash(spark, *inputs))}", build)


def read_through(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """Materialize ``build()`` under ``root/key`` once and reuse it while the key (a
    hash of rules and input version) is unchanged. A ``_SUCCESS`` marker makes a
    half-written directory count as absent. The check goes through Spark's file
    system layer, so ``root`` may be any shared store the cluster can read."""
    from pyspark.errors import AnalysisException
    path = root.rstrip("/") + "/" + key
    try:
        spark.read.text(path + "/_SUCCESS").collect()
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
