"""Thread reconstruction cases, sources and sinks (S1-S8), on own fixtures."""
import json
import os

import pytest

from pyspark.sql import functions as F

from parley.operators import threads as TH
from parley.sources import io as IO

MSG_CSV = """tweet_id,author_id,inbound,response_tweet_id,in_response_to_tweet_id,text,created_at
1,555,True,2,,"my screen flickers, help",Tue Oct 31 22:10:47 +0000 2017
2,Acme,False,,1,"Try restarting it",Tue Oct 31 22:20:47 +0000 2017
3,556, true ,"4,5",,two replies here,Tue Oct 31 22:10:47 +0000 2017
4,Acme,False,,3,first,Tue Oct 31 22:10:47 +0000 2017
5,Acme,False,,3,second,Tue Oct 31 22:10:47 +0000 2017
6,557,True,7,,answered again,Tue Oct 31 22:10:47 +0000 2017
7,Acme,False,8,6,reply,Tue Oct 31 22:10:47 +0000 2017
8,557,True,,7,follow-up,Tue Oct 31 22:10:47 +0000 2017
9,558,True,10,99,opener with a parent,Tue Oct 31 22:10:47 +0000 2017
10,Acme,False,,9,reply,Tue Oct 31 22:10:47 +0000 2017
11,559,True,12,,other brand,Tue Oct 31 22:10:47 +0000 2017
12,Other,False,,11,"reply, with ""quotes""
and a newline",Tue Oct 31 22:10:47 +0000 2017
13,560,True,14,,pointer mismatch,Tue Oct 31 22:10:47 +0000 2017
15,Acme,False,,13,reply not named by the opener,Tue Oct 31 22:10:47 +0000 2017
16,Acme,False,,404,parent missing,Tue Oct 31 22:10:47 +0000 2017
"""


def _msgs(spark, scratch):
    p = os.path.join(scratch, "twcs.csv")
    with open(p, "w") as f:
        f.write(MSG_CSV)
    return IO.read_messages_csv(spark, p, "text", "created_at")


def test_csv_scan_keeps_ids_as_strings_and_normalizes_flag(spark, scratch):
    m = _msgs(spark, scratch)
    assert dict(m.dtypes)["tweet_id"] == "string"
    assert dict(m.dtypes)["inbound"] == "boolean"
    row = m.filter("tweet_id = '3'").first()
    assert row.inbound is True
    assert m.filter("tweet_id = '12'").first().text == 'reply, with "quotes"\nand a newline'


def test_strict_pairs_keep_only_the_clean_thread(spark, scratch):
    m = _msgs(spark, scratch)
    got = sorted(r.tweet_id for r in TH.strict_pairs(m, "Acme").collect())
    assert got == ["2"]
    # any brand: the other brand's clean thread appears too
    got_all = sorted(r.tweet_id for r in TH.strict_pairs(m).collect())
    assert got_all == ["12", "2"]


def test_author_profile_single_pass(spark, scratch):
    m = _msgs(spark, scratch)
    rows = {r.author_id: (r.replies, r.clean_threads) for r in TH.author_profile(m, 5).collect()}
    assert rows["Acme"] == (7, 1) and rows["Other"] == (1, 1)


def test_label_log_latest_wins_and_model_partition(spark, scratch):
    path = os.path.join(scratch, "log")
    os.makedirs(os.path.join(path, "model=a"))
    os.makedirs(os.path.join(path, "model=b"))
    with open(os.path.join(path, "model=a", "part-0.json"), "w") as f:
        f.write(json.dumps({"tweet_id": "1", "intent_llm": "x", "seq": 1}) + "\n\n")
        f.write(json.dumps({"tweet_id": "1", "intent_llm": "y", "seq": 2}) + "\n")
        f.write(json.dumps({"tweet_id": "2", "intent_llm": "z", "seq": 1}) + "\n")
    with open(os.path.join(path, "model=b", "part-0.json"), "w") as f:
        f.write(json.dumps({"tweet_id": "1", "intent_llm": "other-model", "seq": 9}) + "\n")
    got = {r.tweet_id: r.intent_llm for r in IO.read_label_log(spark, path, "tweet_id", model="a").collect()}
    assert got == {"1": "y", "2": "z"}


def test_append_label_log_orders_later_batches_after(spark, scratch):
    path = os.path.join(scratch, "log2")
    a = spark.createDataFrame([("1", "old", "m")], "tweet_id string, intent string, model string")
    b = spark.createDataFrame([("1", "new", "m")], "tweet_id string, intent string, model string")
    IO.append_label_log(a, path, batch=1)
    IO.append_label_log(b, path, batch=2)
    got = IO.read_label_log(spark, path, "tweet_id", model="m").first().intent
    assert got == "new"


def test_csv_sink_serializes_arrays_and_snapshot_round_trip(spark, scratch):
    df = spark.createDataFrame([("1", ["a", "b"])], "id string, flags array<string>")
    IO.write_csv(df, os.path.join(scratch, "out_csv"))
    back = spark.read.option("header", True).option("escape", "\"").csv(os.path.join(scratch, "out_csv")).first()
    assert json.loads(back.flags) == ["a", "b"]
    IO.write_snapshot(df, os.path.join(scratch, "snap"), partition_by=["id"])
    assert spark.read.parquet(os.path.join(scratch, "snap")).count() == 1


def test_read_through_builds_once(spark, scratch):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    key = IO.config_key("rules-v1", "input-v1")
    a = IO.read_through(spark, scratch, key, build)
    b = IO.read_through(spark, scratch, key, build)
    assert a.count() == b.count() == 3 and len(calls) == 1


def test_lenient_numeric(spark):
    df = spark.createDataFrame([("4",), ("X",), (None,)], "h string")
    assert [r.h for r in IO.lenient_numeric(df, ["h"]).collect()] == [4, None, None]


def test_messages_found_by_name_in_any_order(spark, scratch):
    path = os.path.join(scratch, "real.csv")
    with open(path, "w") as f:
        f.write("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n")
        f.write('007,u,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, quoted ""q""",8,\n')
    r = IO.read_messages_csv(spark, path, "text", "created_at").first()
    assert (r.tweet_id, r.inbound, r.response_tweet_id, r.in_response_to_tweet_id) == ("007", True, "8", None)
    assert r.text == 'two\nlines, quoted "q"' and r.created_at.endswith("2017")
    with pytest.raises(Exception):
        IO.read_messages_csv(spark, path, "no_such_column").collect()


def test_label_log_over_partitions(spark, scratch):
    path = os.path.join(scratch, "log3")
    rows = [(str(i % 7), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "tweet_id string, pos long").repartition(4)
    IO.append_label_log(df, path, batch=5, position="pos")
    IO.append_label_log(df.filter("pos < 7").withColumn("pos", F.lit(-1).cast("long")).limit(1), path, batch=4, position="pos")
    got = {r.tweet_id: r.pos for r in IO.read_label_log(spark, path, "tweet_id").collect()}
    assert got == {str(k): max(i for i in range(4000) if i % 7 == k) for k in range(7)}
    IO.append_label_log(df, os.path.join(scratch, "log4"), batch=1)
    log = spark.read.json(os.path.join(scratch, "log4"))
    assert log.select("seq").distinct().count() == 4000


def test_clean_corpus_from_raw_messages(spark, scratch):
    from parley.plans.jobs import corpus_job
    path = os.path.join(scratch, "raw.csv")
    with open(path, "w") as f:
        f.write("text,tweet_id,author_id,inbound,created_at,response_tweet_id,in_response_to_tweet_id\n")
        f.write('"@115858  my keyboard, @Someone and @Acme",1,u1,True,2017-11-05 10:00:00,2,\n')
        f.write('"@u1 send us a DM, @AcmeHelp",2,Acme,False,2017-11-05 10:05:00,,1\n')
        f.write('"@115858 hello",3,u2,True,2017-10-01 10:00:00,4,\n')
        f.write('"Thanks for reaching out.",4,Acme,False,2017-10-01 10:05:00,,3\n')
        f.write('"two replies",5,u3,True,2017-10-01 10:00:00,"6,7",\n')
        f.write('"a",6,Acme,False,2017-10-01 10:00:00,,5\n')
    m = IO.read_messages_csv(spark, path, "text", "created_at").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.tweet_id: r for r in corpus_job(spark, m, "Acme", os.path.join(scratch, "corpus"), ["AcmeHelp"]).collect()}
    assert set(got) == {"2", "4"}
    assert got["2"].customer_text == "@BRAND my keyboard, @USER and @BRAND" and got["2"].brand_text == "@USER send us a DM, @BRAND"
    assert got["2"].res_type == "dm_handoff" and got["2"].bug_kw and got["2"].in_window and got["2"].incident_window
    assert got["4"].res_type == "other" and got["4"].incident_window is None


def test_pluggable_labeler(spark):
    from parley.operators.retrieval import label_neighbours
    c = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "q_id long, n_id long")
    asked = []

    def labeler(rows):
        asked.append(rows.count())
        return rows.filter("n_id = 10").withColumn("label", F.lit("x"))
    got = {(r.q_id, r.n_id): r.label for r in label_neighbours(c, labeler).collect()}
    assert got == {(1, 10): "x", (1, 11): None, (2, 10): "x"} and asked == [2]
    log = spark.createDataFrame([(11, "y")], "n_id long, label string")
    assert {r.label for r in label_neighbours(c, log=log).collect()} == {"y", None}
