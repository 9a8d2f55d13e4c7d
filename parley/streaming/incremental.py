"""Incremental labelling (ST1) and the same contract as a stream (ST2).

ST1: each run scores only keys absent from the label log, and rows that are too thin to
classify are excluded without being scored.

ST2: a Structured Streaming query over the input files applies the stateless label
expressions (R1, R3, R8, G9 inputs) to new rows only. ``trigger(availableNow=True)``
processes whatever is new and stops; the checkpoint makes a restart resume where it
left off. ``foreachBatch`` merges each micro-batch into a keyed sink (``MergeSink``): a key
that comes again replaces its row, and a replayed epoch writes what it wrote before.
Sink and checkpoint live under the session's ``spark.checkpoint.dir`` (shared storage).
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators.sampling import latest_per_key
from ..session import checkpoint_dir


# ST1 ---------------------------------------------------------------------------
def pending(inputs: DataFrame, log: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows still to be scored: not in the log (null-safe anti-join) and not thin."""
    return inputs.join(log.select(key), key, "left_anti").filter(~T.is_thin(F.col(text_col)))


# ST2 ---------------------------------------------------------------------------
def label_columns(df: DataFrame) -> DataFrame:
    """The stateless per-row labels shared by the batch and the streaming path."""
    intent = R.label_intent("text")
    return df.select("conv_id", "turn", "role",
                     F.when(F.col("role") == "assistant", R.resolution_type("text")).alias("rtype"),
                     intent.alias("intent"),
                     F.array_join(R.check_overrides("text", intent), ",").alias("overrides"),
                     T.is_thin("text").alias("thin"))


class MergeSink:
    """A table with one row per key, kept by epochs.

    Keys are dealt to ``buckets`` by hash. Merging epoch n reads the current rows of the
    buckets that its rows fall into, lets the newer row of a key replace the older one, and
    writes those buckets to ``data/epoch=n/bucket=k``; then ``commits/epoch=n`` names them.
    Other buckets are not read or written. A bucket's current rows are those of the last
    committed epoch that names it, so a half-written epoch is not seen, and a replayed epoch
    is merged against the epochs before it and replaces both of its folders whole. Within an
    epoch the greatest ``order`` columns win, then the greatest row. Columns keep their types;
    all epochs must have the same ones. A key column may be null and is then a key like others."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 16):
        self.spark, self.root, self.keys, self.order, self.buckets = spark, root.rstrip("/"), list(keys), list(order), buckets

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, epoch long").parquet(f"{self.root}/commits")
        except AnalysisException:  # nothing committed yet
            return None

    def _current(self, before: int | None = None) -> DataFrame | None:
        """(bucket, epoch) whose folders hold the current rows, at most one row per bucket."""
        c = self._commits()
        if c is None:
            return None
        c = c if before is None else c.filter(F.col("epoch") < before)
        return c.groupBy("bucket").agg(F.max("epoch").alias("epoch"))

    def _rows(self, current: DataFrame) -> DataFrame | None:
        """Rows of the given (bucket, epoch), with both columns; folders of others are pruned."""
        folders = [f"{self.root}/data/epoch={r['epoch']}/bucket={r['bucket']}" for r in current.collect()]
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*folders)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        columns = batch.columns
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.withColumn("_new", F.lit(1)).withColumn("bucket", place)
        new = new.persist()
        try:
            touched = new.select("bucket").distinct()
            before = self._current(before=epoch)
            old = self._rows(before.join(touched, "bucket")) if before is not None else None
            both = new if old is None else new.unionByName(old.withColumn("_new", F.lit(0)).select(*columns, "_new", "bucket"))
            row = F.xxhash64(*columns)
            last = latest_per_key(both, [*self.keys, "bucket"], [F.col("_new").desc(), *[F.col(c).desc() for c in self.order], row.desc()])
            last.drop("_new").repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket") \
                .parquet(f"{self.root}/data/epoch={epoch}")
            touched.write.mode("overwrite").parquet(f"{self.root}/commits/epoch={epoch}")
        finally:
            new.unpersist()

    def read(self) -> DataFrame | None:
        """One row per key, or None before the first commit that holds rows."""
        current = self._current()
        rows = None if current is None else self._rows(current)
        return None if rows is None else rows.drop("bucket", "epoch")

    def vacuum(self) -> int:
        """Delete the folders of buckets that a later committed epoch replaced; their number. Not
        while an epoch is being merged or replayed."""
        current = self._current()
        if current is None:
            return 0
        stale = self._commits().join(current.withColumnRenamed("epoch", "last"), "bucket").filter("epoch < last").select("bucket", "epoch")
        jvm, gone = self.spark._jvm, 0
        for r in stale.collect():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/epoch={r['epoch']}/bucket={r['bucket']}")
            gone += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone


def label_sink(spark: SparkSession, root: str) -> MergeSink:
    return MergeSink(spark, root, ["conv_id", "turn"])


def run_stream(spark: SparkSession, source_glob: str, schema, sink: str, ckpt: str, files_per_trigger: int = 64) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_glob)
    into = label_sink(spark, sink)
    q = (label_columns(stream).writeStream.foreachBatch(lambda batch, epoch: into.merge(batch, epoch))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def read_latest(spark: SparkSession, sink: str) -> DataFrame:
    return label_sink(spark, sink).read()


def stream_labels(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Run ST2 over ``conversations`` to completion and return the merged labels."""
    root = root or os.path.join(checkpoint_dir(spark), "st2", uuid.uuid4().hex)
    src = os.path.join(sf_dir, "conversations*.parquet")
    schema = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")).schema
    run_stream(spark, src, schema, os.path.join(root, "sink"), os.path.join(root, "ckpt"))
    return read_latest(spark, os.path.join(root, "sink"))
