"""Sources and sinks: given tables written to the shared folder and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import io as IO
from .catalog import SQL_MSGS, msgs, register, tb


def _fresh(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("s1_messages_round_trip", f"""
select tweet_id, author_id, inbound, response_tweet_id, in_response_to_tweet_id, md5(text) as text_md5 from {SQL_MSGS} m""")
def s1_messages_round_trip(spark, d):
    """Raw message CSV in another column order and with a column nobody asked for."""
    path = _fresh(spark, "messages-csv")
    m = msgs(spark, d).select("text", "in_response_to_tweet_id", F.lit("x").alias("place"), "tweet_id",
                              F.initcap(F.col("inbound").cast("string")).alias("inbound"), "author_id", "response_tweet_id")
    m.write.option("header", True).option("escape", '"').csv(path)
    r = IO.read_messages_csv(spark, path, "text")
    return r.select(*[c for c in IO.MESSAGE_COLUMNS], F.md5("text").alias("text_md5"))


@register("s2_typed_csv_round_trip", "select c_custkey::varchar as c_custkey, coalesce(c_mktsegment, '') as c_mktsegment from customer")
def s2_typed_csv_round_trip(spark, d):
    path = _fresh(spark, "customer-csv")
    tb(spark, d, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).csv(path)
    return IO.read_typed_csv(spark, path, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@register("s4_snapshot_round_trip", "select doc_id, lang, n_chars from documents")
def s4_snapshot_round_trip(spark, d):
    path = _fresh(spark, "snapshot")
    IO.write_snapshot(tb(spark, d, "documents").select("doc_id", "lang", "n_chars"), path, ["lang"])
    return spark.read.parquet(path).select("doc_id", "lang", "n_chars")


@register("s5_csv_sink", "select vec_id::varchar as vec_id, len(embedding)::bigint as n from embeddings")
def s5_csv_sink(spark, d):
    path = _fresh(spark, "vectors-csv")
    IO.write_csv(tb(spark, d, "embeddings").select("vec_id", "embedding"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("vec_id", F.size(F.from_json("embedding", "array<double>")).cast("bigint").alias("n"))


@register("s6_s7_label_log", """
select doc_id, case when quality = 1 then 'final-good' else 'final-bad' end as label from labels""")
def s6_s7_label_log(spark, d):
    """Two appends and two models: the later batch wins, the other model stays apart."""
    path = _fresh(spark, "label-log")
    l = tb(spark, d, "labels").repartition(4, "doc_id").select("doc_id", "quality", F.monotonically_increasing_id().alias("pos"))
    put = lambda model, label, batch: IO.append_label_log(
        l.select("doc_id", "pos", F.lit(model).alias("model"), label.alias("label")), path, batch, "pos")
    good = F.when(F.col("quality") == 1, "good").otherwise("bad")
    put("a", F.lit("draft"), 1), put("a", F.concat(F.lit("final-"), good), 2), put("b", F.lit("other"), 3)
    return IO.read_label_log(spark, path, "doc_id", model="a").select("doc_id", "label")


@register("s8_read_through", "select lang, count(*)::bigint as n from documents group by lang")
def s8_read_through(spark, d):
    """Built once per key; the second call must read what the first one wrote."""
    root, key = _fresh(spark, "read-through"), IO.config_key("lang-counts", d)
    build = lambda: tb(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    IO.read_through(spark, root, key, build)

    def again():
        raise AssertionError("built twice")

    return IO.read_through(spark, root, key, again)


@register("s8_cached_by_rules_and_files", """
select case when n_chars < 500 then 'short' else 'long' end as kind, count(*)::bigint as n from documents group by 1""")
def s8_cached_by_rules_and_files(spark, d):
    """A cached table whose key holds its rule and the files of its input: once a copy of the
    input grows and once its rule changes, the next read is built anew."""
    root = _fresh(spark, "cached")
    copy = f"{root}/input"
    docs = tb(spark, d, "documents")
    docs.filter("doc_id % 2 = 0").write.parquet(copy)

    def kinds(limit):
        kind = F.when(F.col("n_chars") < limit, "short").otherwise("long").alias("kind")
        return IO.cached(spark, f"{root}/cache", "kinds", {"short": limit}, [copy], lambda: spark.read.parquet(copy)
                         .groupBy(kind).agg(F.count(F.lit(1)).alias("n")))

    kinds(500)
    docs.filter("doc_id % 2 <> 0").write.mode("append").parquet(copy)
    kinds(100)
    return kinds(500)
