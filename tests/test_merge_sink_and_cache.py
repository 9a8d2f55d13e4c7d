"""ST2 merge on key and S8 fingerprints."""
import os
import time

import pytest
from pyspark.sql import functions as F

from parley.sources import io as IO
from parley.streaming import incremental as ST


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, part string, v string, at long")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def test_changed_rows_replace_their_predecessors(spark, scratch):
    sink = ST.MergeSink(spark, scratch, ["k", "part"], order=["at"], buckets=4)
    assert sink.read() is None
    sink.merge(batch(spark, [(1, "a", "old", 1), (2, "a", "two", 1), (None, None, "null key", 1), (1, "b", "other part", 1)]), 0)
    sink.merge(batch(spark, [(1, "a", "new", 5), (1, "a", "newest", 7), (1, "a", "late", 6), (3, "a", None, 0)]), 1)
    sink.merge(batch(spark, []), 2)
    sink.merge(batch(spark, [(None, None, "again", 0)]), 3)  # an older time, but a newer epoch
    want = sorted([(1, "a", "newest", 7), (2, "a", "two", 1), (None, None, "again", 0), (1, "b", "other part", 1), (3, "a", None, 0)], key=repr)
    assert content(sink.read()) == want
    assert sink.vacuum() > 0 and content(sink.read()) == want and sink.vacuum() == 0


def test_replayed_epoch_changes_nothing(spark, scratch):
    sink = ST.MergeSink(spark, scratch, ["k"], buckets=8)
    rows = lambda lo, hi, v: batch(spark, [(k, "p", v, k) for k in range(lo, hi)])
    sink.merge(rows(0, 50, "first"), 0)
    sink.merge(rows(40, 60, "second"), 1)
    before, held = content(sink.read()), [f.rsplit("/", 1)[0] for f in files(scratch)]
    sink.merge(rows(40, 60, "second"), 1)
    assert content(sink.read()) == before and len(before) == 60
    assert [f.rsplit("/", 1)[0] for f in files(scratch)] == held  # same folders, no file more
    assert {v for k, _, v, _ in before if k >= 40} == {"second"}


def test_half_written_epoch_is_not_seen(spark, scratch):
    sink = ST.MergeSink(spark, scratch, ["k"], buckets=2)
    sink.merge(batch(spark, [(1, "p", "kept", 0)]), 0)
    batch(spark, [(1, "p", "lost", 0)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{scratch}/data/epoch=1")
    assert [r["v"] for r in sink.read().collect()] == ["kept"]
    sink.merge(batch(spark, [(1, "p", "written", 0)]), 1)
    assert [r["v"] for r in sink.read().collect()] == ["written"]


def test_only_touched_buckets_are_written(spark, scratch):
    sink = ST.MergeSink(spark, scratch, ["k"], buckets=8)
    sink.merge(batch(spark, [(k, "p", "x", 0) for k in range(100)]), 0)
    sink.merge(batch(spark, [(5, "p", "y", 0)]), 1)
    assert len({f.rsplit("/", 1)[0] for f in files(f"{scratch}/data/epoch=1")}) == 1
    got = {r["k"]: r["v"] for r in sink.read().collect()}
    assert len(got) == 100 and got[5] == "y" and got[6] == "x"


def test_stream_in_many_epochs_equals_batch(spark, scratch):
    """A source of several files, one per micro-batch, whose last file changes earlier rows."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    src = os.path.join(scratch, "in")
    turns.repartition(3).write.parquet(src)
    ST.run_stream(spark, src, turns.schema, f"{scratch}/sink", f"{scratch}/ckpt", files_per_trigger=1)
    batch_ = ST.label_columns(turns)
    got = ST.read_latest(spark, f"{scratch}/sink")
    assert got.count() == batch_.count() and got.exceptAll(batch_).count() == 0
    changed = turns.filter("conv_id % 3 = 0").withColumn("text", F.lit("thank you so much, it works now"))
    changed.coalesce(1).write.mode("append").parquet(src)
    ST.run_stream(spark, src, turns.schema, f"{scratch}/sink", f"{scratch}/ckpt", files_per_trigger=1)
    both = ST.label_columns(turns.filter("conv_id % 3 <> 0").unionByName(changed))
    got = ST.read_latest(spark, f"{scratch}/sink")
    assert got.count() == both.count() and got.exceptAll(both).count() == 0


def test_cache_follows_rules_and_files(spark, scratch):
    src, built = os.path.join(scratch, "in"), []
    spark.range(10).write.parquet(src)

    def get(rules):
        def build():
            built.append(rules)
            return spark.read.parquet(src).agg(F.count(F.lit(1)).alias("n"))
        return IO.cached(spark, f"{scratch}/cache", "count", rules, [src], build).first()["n"]

    assert [get({"r": ["a", "b"]}), get({"r": ["a", "b"]})] == [10, 10] and len(built) == 1
    assert get({"r": ["b", "a"]}) == 10 and len(built) == 2       # rules in another order
    spark.range(5).write.mode("append").parquet(src)
    assert get({"r": ["a", "b"]}) == 15 and len(built) == 3       # a file more
    time.sleep(1.1)
    spark.range(15).coalesce(1).write.mode("overwrite").parquet(src)
    assert get({"r": ["a", "b"]}) == 15 and len(built) == 4       # other files, same rows
    assert get({"r": ["a", "b"]}) == 15 and len(built) == 4
    with pytest.raises(FileNotFoundError):
        IO.files_hash(spark, f"{scratch}/nothing")


def test_rules_hash_is_by_value():
    from parley.functions import rules as R
    assert IO.rules_hash({"a": {1, 2}, "b": 1}) == IO.rules_hash({"b": 1, "a": {2, 1}})
    assert IO.rules_hash("1") != IO.rules_hash(1) and IO.rules_hash(["x", "y"]) != IO.rules_hash(["y", "x"])
    tables = [v for v in vars(R).values() if isinstance(v, R.RuleTable)]
    assert len({IO.rules_hash(t) for t in tables}) == len(tables) == len({t.version() for t in tables})
    with pytest.raises(TypeError):
        IO.rules_hash(object())
