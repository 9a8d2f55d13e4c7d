"""Exact dual cap against the walk, term table against plain containment."""
import hashlib
import random

import pytest

from pyspark.sql import functions as F

from parley.operators import sampling as W
from parley.operators import term_table as TT


def walk(rows, n, share, seed=0):
    cap, out, tags, per = int(n * share), [], 0, {}
    for i, c, t in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])):
        if len(out) >= n:
            break
        if (t and tags >= cap) or per.get(c, 0) >= cap:
            continue
        out.append(i)
        tags += bool(t)
        per[c] = per.get(c, 0) + 1
    return out


@pytest.mark.parametrize("n,share,tagged", [(20, 0.2, 0.6), (50, 0.1, 0.3), (10, 0.05, 0.5), (400, 0.3, 0.9), (30, 0.5, 0.0)])
def test_dual_cap_exact_is_the_walk(spark, n, share, tagged):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None, f"x{i % 7}"]), rnd.choice([None, False]) if rnd.random() > tagged else True)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, t boolean")
    for parts in (1, 7):
        got = W.dual_cap_exact(df.repartition(parts), "id", "c", F.col("t"), n, share)
        assert sorted(r["id"] for r in got.collect()) == sorted(walk(rows, n, share))
    assert got.columns == df.columns
    assert W.dual_cap_exact(df.limit(0), "id", "c", F.col("t"), n, share).count() == 0


def test_dual_cap_exact_gives_slots_of_dropped_rows_to_others(spark):
    ids = sorted(range(40), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
    # in hash order: one cluster of tagged rows with untagged ones behind them
    rows = [(i, "one" if k < 20 else f"z{k}", k < 10) for k, i in enumerate(ids)]
    rows = [(i, c if k >= 2 else "two", t) for k, (i, c, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, c string, t boolean")
    exact = {r["id"] for r in W.dual_cap_exact(df, "id", "c", F.col("t"), 20, 0.2).collect()}
    cascade = {r["id"] for r in W.dual_cap(df, "id", "c", F.col("t"), 20, 0.2).collect()}
    assert exact == set(walk(rows, 20, 0.2))
    of_one = {i for i, c, _ in rows if c == "one"}
    assert len(cascade & of_one) < len(exact & of_one)


def test_dual_cap_exact_bounds_its_ranks(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 2 == 0).alias("t"))
    plan = W.dual_cap_exact(df, "id", "c", F.col("t"), 20, 0.2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_term_table_is_containment(spark):
    rnd = random.Random(4)
    words = ["Apple", "pay", "apples", "the", "é", "STRASSE", "a", "ab", "x-y", "long" * 30]
    texts = [(i, rnd.choice([" ", "\n", "  "]).join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "   "), (203, "w" * 100_000 + " end"), (None, "apple pay"), (204, "apple"), (204, "pay the")]
    terms = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    terms += ["pple", "e P", "a", "ab", "LONGLONG", "", "  ", None, "pay", "pay", "wwww", "w end", " pay ", "le pay th"]
    t = spark.createDataFrame(texts, "id long, body string").withColumn("term", F.lit(1)).withColumn("anchor", F.lit(2))
    n = spark.createDataFrame(list(enumerate(terms)), "no long, term string").withColumn("word", F.lit("x"))
    got = {r["id"]: r["hits"] for r in TT.term_hits(t, n, "id", "body", "no", "term").collect()}
    want = {}
    for k, term in enumerate(terms):
        for i, text in texts:
            if i is not None and text is not None and term and term.strip() and term.lower() in text.lower():
                want.setdefault(i, {})[k] = term
    assert got == {i: [h[k] for k in sorted(h)] for i, h in want.items()}
    assert TT.term_hits(t.limit(0), n, "id", "body", "no", "term").count() == 0
    assert TT.term_hits(t, n.limit(0), "id", "body", "no", "term").count() == 0


def test_term_table_joins_by_key(spark):
    t = spark.createDataFrame([(1, "one two three four")], "id long, body string")
    n = spark.createDataFrame([(1, "one two three"), (2, "wo")], "no long, term string")
    plan = TT.term_hits(t, n, "id", "body", "no", "term")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
