"""Top-k join vs brute force, near-duplicate pairs vs brute force, stream vs batch."""
import itertools
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from parley.operators import dedup as D
from parley.operators import sparse as SP
from parley.operators import vectors as V
from parley.streaming import incremental as ST


def join_topk(q, p, k, score, on=None):
    """The oracle's shape of a top-k: every pair of one key as a row (tests only)."""
    q, p = (d.withColumn("_k", F.lit(1) if on is None else F.col(on)) for d in (q, p))
    j = q.join(p, "_k").filter(F.col("q_id") != F.col("n_id")).withColumn("cos", score)
    w = Window.partitionBy("q_id").orderBy(F.round("cos", 9).desc(), F.asc("n_id"))
    return j.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def embeddings(spark):
    return spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def test_dense_topk_any_block_size(spark):
    e = embeddings(spark).filter("id % 4 = 0")
    # equal scores: copies under other ids, one of them a hair apart in the last bits
    copies = e.limit(3).select((F.col("id") + 100_000).alias("id"), F.transform("vec", lambda x: x * 2).alias("vec"), "label")
    e = e.unionByName(copies).cache()
    want = {(r.q_id, r["rank"]): r.n_id for r in join_topk(
        e.select(F.col("id").alias("q_id"), F.col("vec").alias("qv")), e.select(F.col("id").alias("n_id"), F.col("vec").alias("pv")),
        3, V.cosine("qv", "pv")).collect()}
    for rows in (1 << 3, 17, 10_000):
        got = {(r.q_id, r["rank"]): r.n_id for r in V.topk_dense(e, e, 3, q_rows=rows, p_rows=rows).collect()}
        assert got == want


def test_dense_topk_keyed(spark):
    e = embeddings(spark).cache()
    want = {(r.q_id, r["rank"]): r.n_id for r in join_topk(
        e.select(F.col("id").alias("q_id"), F.col("vec").alias("qv"), "label"),
        e.select(F.col("id").alias("n_id"), F.col("vec").alias("pv"), "label"), 2, V.cosine("qv", "pv"), "label").collect()}
    got = {(r.q_id, r["rank"]): r.n_id for r in V.topk_dense(e, e, 2, key_col="label", p_rows=64).collect()}
    assert got == want and len(want) > 100


def test_topk_without_rows(spark):
    e = embeddings(spark)
    assert V.topk_dense(e.limit(0), e, 3).count() == 0 and V.topk_dense(e, e.limit(0), 3).count() == 0


def test_near_dup_pairs_match_brute_force(spark):
    texts = ["the quick brown fox jumps over the lazy dog today",
             "the quick brown fox jumps over the lazy dog now",
             "completely different words in this one sentence here",
             "the quick brown fox jumps over the lazy dog today",
             "a b", "alpha beta gamma delta epsilon zeta eta theta",
             "alpha beta gamma delta epsilon zeta eta iota"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = D.with_norm(df, "text")
    reps = D.representatives(n, "id")
    sets = D.shingles(reps, "rep_id")
    for t in (0.5, 0.7):
        got = {(r.a, r.b) for r in D.similar_pairs(sets, t).collect()}
        sh = {r.id: set(r.sh) for r in sets.collect()}
        want = set()
        for a, b in itertools.combinations(sorted(sh), 2):
            if sh[a] and sh[b] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= t:
                want.add((a, b))
        assert got == want
    cl = {r.id: r.cluster for r in D.near_dup_clusters(df, "id", "text", 0.5).collect()}
    assert cl[0] == cl[1] == cl[3] == 0
    assert cl[5] == cl[6] == 5 and cl[2] == 2


def test_tfidf_weights_are_unit_norm(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    pw, qw = SP.tfidf(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "doc_id", "text")
    norms = pw.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert norms.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_stream_equals_batch_and_restart_is_idempotent(spark, scratch):
    sf = SF001
    root = os.path.join(scratch, "st2")
    got = ST.stream_labels(spark, sf, root)
    batch = ST.label_columns(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0
    # a restart over the same input processes nothing new and keeps one row per key
    again = ST.stream_labels(spark, sf, root)
    assert again.count() == batch.count()
    assert again.groupBy("conv_id", "turn").count().filter("count > 1").count() == 0


def test_sparse_topk_equals_join_form(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    lab = spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id")
    pw, qw = SP.tfidf(docs.join(lab, "doc_id", "left_anti"), docs.join(lab, "doc_id", "left_semi"), "doc_id", "text")
    pairs = qw.select(F.col("id").alias("q_id"), "term", F.col("w").alias("wq")).join(
        pw.select(F.col("id").alias("n_id"), "term", F.col("w").alias("wp")), "term")
    cos = pairs.groupBy("q_id", "n_id").agg(F.sum(F.col("wq") * F.col("wp")).alias("cos"))
    w = Window.partitionBy("q_id").orderBy(F.round("cos", 9).desc(), "n_id")
    cols = ["q_id", "n_id", "rank", F.round("cos", 6).alias("c")]
    a = {tuple(r) for r in cos.withColumn("rank", F.row_number().over(w) - 1).filter("rank < 3").select(*cols).collect()}
    for q, p in ((7, 5), (1000, 1000)):
        b = {tuple(r) for r in SP.topk_sparse(qw, pw, 3, q_docs=q, p_docs=p).select(*cols).collect()}
        assert a == b and len(a) > 0


def test_sparse_topk_leaves_out_own_group(spark):
    rows = [(i, f"alpha beta gamma word{i % 3}", i // 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, conv long")
    pw, qw = SP.tfidf(df, df, "id", "text")
    conv = df.select("id", "conv")
    got = SP.topk_sparse(qw.join(conv, "id"), pw.join(conv, "id"), 3, own="conv").collect()
    assert got and all(r.q_id // 2 != r.n_id // 2 for r in got)


def test_clusters_of_long_chains(spark):
    """Each text differs a little from the next: one cluster over many links."""
    words = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(200):
        texts.append(" ".join(words))
        words = words[1:] + [f"n{i}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.cluster for r in D.near_dup_clusters(df, "id", "text", 0.85).collect()}
    assert set(got.values()) == {0} and len(got) == 200
