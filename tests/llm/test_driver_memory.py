"""What the operators hand to the driver or make it plan stays small."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import circulant, importance

TEXTS = ["good plain words here", "spam spam spam buy now", "more good words", "", None] * 40


def test_sums_of_all_buckets_do_not_pass_the_driver(spark, monkeypatch):
    rows = spark.createDataFrame([(t, int(t is not None and "good" in t)) for t in TEXTS], "text string, role int").repartition(3)
    sent = []

    def counted(f):
        def call(self, *args, **kwargs):
            got = list(f(self, *args, **kwargs))
            sent.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
            return iter(got) if f.__name__ == "toLocalIterator" else got
        return call

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(type(rows), name, counted(getattr(type(rows), name)))
    weights = importance.fit(rows)
    assert sum(sent) < 1 << 20

    raw, target = np.zeros(1 << importance.BITS), np.zeros(1 << importance.BITS)
    for t in TEXTS:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, bucket = importance.features(data, np.array([0, len(data)]))
        raw[bucket] += 1
        target[bucket] += t is not None and "good" in t
    share = sum(t is not None and "good" in t for t in TEXTS) / len(TEXTS)
    want = np.log((target + importance.SHRINK) / (raw * share + importance.SHRINK))
    want[want > -importance.EFFECT] = 0
    assert weights.dtype == np.float32 and np.array_equal(weights, want.astype(np.float32)) and weights.any()
    assert isinstance(rows, DataFrame)


def test_without_rows_of_both_kinds_no_bucket_speaks(spark):
    rows = spark.createDataFrame([("a b c", 0)], "text string, role int")
    assert not importance.fit(rows).any() and not importance.fit(rows.limit(0)).any()


def test_signature_test_is_a_short_expression_and_counts_bytes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        x = rng.integers(0, 256, 64, dtype=np.uint8)
        y, at = x.copy(), rng.choice(64, rng.integers(0, 30), replace=False)
        y[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
        b, c = rng.integers(0, 3, 16), rng.integers(0, 3, 16)
        rows.append((x.view(np.int64).tolist(), y.view(np.int64).tolist(), int((x == y).sum()), b.tolist(), c.tolist(),
                     int(rng.integers(0, 4)), int((b == c).argmax()) if (b == c).any() else -1))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, same int, b array<long>, c array<long>, band int, first int")
    got = df.select("same", "first", "band", circulant._agree("x", "y", 64, 47).alias("agree"), circulant._first_shared("b", "c", F.col("band")).alias("shared"))
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    for r in got.collect():
        assert r["agree"] == (r["same"] >= 47) and bool(r["shared"]) == (r["first"] == r["band"])
