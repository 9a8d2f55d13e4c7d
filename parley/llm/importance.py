"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens, adjacent pairs, and a mark for one
token three times running) say how likely a text's n-grams are in target text (documents
labelled good and not toxic) and in raw text (all documents). Both come from one Spark
aggregation of document counts per bucket. The logarithm of their ratio is a text's
importance. Ratios are shrunk by ``SHRINK`` documents on both sides, and only buckets whose
shrunk ratio is at most exp(-``EFFECT``) speak: the gate asks for an effect of a fixed size,
so a larger table does not let ever weaker n-grams in. It takes at least 9 expected documents
to speak; that many are all missing by chance in 2e-4 of the buckets, and the cut allows for it. Ratios
above one count as one, so frequent clean words cannot buy off junk. Rows are then ranked by
Gumbel top-k over the importance in levels of ``CUT_STEP``: the k rows with the largest
SHARPNESS * level + Gumbel noise, the noise a hash of the row. The noise spans less than
SHARPNESS, so it orders the rows of one level and never lifts a row over one of a higher
level. The cut is the importance that best separates good from bad labelled rows among those
that lose at most ``MAX_LOSS`` of the good ones. k is the number of rows that reach the cut and,
below it, of as many as good rows are expected there: by the rule of succession from the good
labelled rows the cut loses, ``MAX_LOSS`` of the rows above it at most. So k ends inside a level,
and the noise draws the rows of that level that stay.

The models' target side and the cut are fitted on at most ``SAMPLE`` good and ``SAMPLE`` bad
labelled documents (those with the smallest hashes of their ids); raw counts, scores, k and
the selection cover all rows.

Nulls: a null text has no n-gram and importance 0, a null doc_id is unlabelled, a label with
a null quality or toxic is skipped. Contradicting labels: the lowest quality and highest
toxicity hold. Repeated rows share one noise value, so they stay or go together, which can
move the number kept off k by their count. Without labels of both kinds all rows are kept.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, IS_SPACE, TO_LOWER, U, batches_of_rows, bound_batches, mix64, release, split_spans, store, text_buffer, word_names

BITS, SLICE, SAMPLE = 21, 1 << 14, 20_000
BUCKETS = 1 << BITS
SHRINK, EFFECT, MAX_LOSS = 5.0, 1.0, 0.001
SHARPNESS, CUT_STEP = 64.0, 0.25  # the noise lies between -4 and 38
KIND = np.full(256, 1, np.uint8)  # letters, digits and bytes of longer characters
KIND[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 2
KIND[IS_SPACE] = 0


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of the n-grams of each row."""
    start, end, at = split_spans(KIND[data], off)
    name = word_names(TO_LOWER[data], start, end)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(at))
    two = row[1:] == row[:-1]
    pair = mix64(name[:-1] * GOLD + name[1:])[two]
    same = (name[1:] == name[:-1]) & two
    three = np.flatnonzero(same[1:] & same[:-1])
    rows = np.concatenate([row, row[1:][two], row[three]])
    bucket = np.concatenate([name, pair, np.full(len(three), GOLD)]) >> U(64 - BITS)
    both = np.unique(rows << BITS | bucket.astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, role): at most ``sample`` good (1) and ``sample`` bad (2) documents."""
    one = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    role = F.when((F.col("q") == 1) & (F.col("t") == 0), 1).otherwise(2)
    one = one.select("doc_id", role.alias("role"))
    pick = lambda r: one.filter(F.col("role") == r).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return pick(1).unionByName(pick(2))


def _with_role(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    known = labelled(labels, sample).select(F.col("doc_id").alias("_id"), F.col("role").alias("_role"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "text", F.coalesce("_role", F.lit(0)).alias("role"), F.xxhash64("doc_id", "text").alias("noise"))


def fit(rows: DataFrame) -> np.ndarray:
    """Shrunk log of target over raw share per bucket where it is at most -EFFECT, else 0;
    rows: (text, role)."""

    def count(batches):
        raw, target = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        n = t = 0
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            good = batch.column("role").to_numpy() == 1
            n, t = n + len(good), t + int(good.sum())
            for a, b in batches_of_rows(off, 1 << 19):
                row, bucket = features(data[off[a]:off[b]], off[a:b + 1] - off[a])
                np.add.at(raw, bucket, 1)
                np.add.at(target, bucket[good[a:b][row]], 1)
        for i in range(0, 1 << BITS, SLICE):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // SLICE], pa.int32()), pa.array([n if i == 0 else 0], pa.int64()), pa.array([t if i == 0 else 0], pa.int64()),
                 pa.array([raw[i:i + SLICE].tobytes()], pa.binary()), pa.array([target[i:i + SLICE].tobytes()], pa.binary())],
                names=["slice", "n", "t", "raw", "target"])

    def add(table: pa.Table) -> pa.Table:
        total = lambda c: sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column(c).to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "t": pa.array([sum(table.column("t").to_pylist())], pa.int64()),
                         "raw": pa.array([total("raw").tobytes()], pa.binary()), "target": pa.array([total("target").tobytes()], pa.binary())})

    schema = "slice int, n long, t long, raw binary, target binary"
    sums = store(rows.select("text", "role").mapInArrow(count, schema).groupBy("slice").applyInArrow(lambda t: add(t), schema), "sums", BUCKETS // SLICE)
    n, t = (x or 0 for x in sums.agg(F.sum("n"), F.sum("t")).first())
    weights = np.zeros(BUCKETS, np.float32)
    if not n or not t:
        return weights

    def speak(batches):
        for batch in batches:
            for i, raw, target in zip(*(batch.column(c).to_pylist() for c in ("slice", "raw", "target"))):
                expected = np.frombuffer(raw, np.int64) * (t / n)
                ratio = np.log((np.frombuffer(target, np.int64) + SHRINK) / (expected + SHRINK))
                at = np.flatnonzero(ratio <= -EFFECT)
                yield pa.RecordBatch.from_arrays([pa.array([(at + i * SLICE).tobytes()], pa.binary()), pa.array([ratio[at].astype(np.float32).tobytes()], pa.binary())],
                                                 names=["bucket", "weight"])

    # one row per slice, with the buckets that speak only: sums of all buckets do not pass the driver
    for r in sums.mapInArrow(speak, "bucket binary, weight binary").toLocalIterator():
        weights[np.frombuffer(r["bucket"], np.int64)] = np.frombuffer(r["weight"], np.float32)
    return weights


def _importance(weights: np.ndarray, column) -> np.ndarray:
    data, off = text_buffer(column)
    out = np.zeros(len(off) - 1)
    for a, b in batches_of_rows(off, 1 << 19):
        row, bucket = features(data[off[a]:off[b]], off[a:b + 1] - off[a])
        out[a:b] = np.bincount(row, weights=weights[bucket], minlength=b - a)
    return out


def _key(importance: np.ndarray, noise: np.ndarray) -> np.ndarray:
    u = (mix64(noise.astype(np.int64).view(U)) >> U(11)).astype(float) + 0.5
    return SHARPNESS * np.floor(importance / CUT_STEP) - np.log(-np.log(u / 2.0 ** 53))


def score(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, role, importance, key) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            s = _importance(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("role"), pa.array(s), pa.array(_key(s, batch.column("noise").to_numpy()))],
                names=["doc_id", "role", "importance", "key"])

    return rows.mapInArrow(run, "doc_id long, role int, importance double, key double")


def cut_of(scores: DataFrame) -> tuple[float, float]:
    """The importance that best separates good from bad labelled rows, losing at most
    ``MAX_LOSS`` of the good, and the share of good rows expected below it."""
    step = F.floor(F.col("importance") / CUT_STEP)
    bins = scores.filter("role > 0").groupBy(F.greatest(step, F.lit(-4000)).alias("b"), "role").count().collect()
    good, bad = (sum(r["count"] for r in bins if r["role"] == k) for k in (1, 2))
    if not good or not bad:
        return -math.inf, 0.0
    best, cut, share = 1.0, -math.inf, 0.0  # as good as keeping all
    for b in sorted({r["b"] for r in bins}):
        lost = sum(r["count"] for r in bins if r["role"] == 1 and r["b"] < b) / good
        wrong = lost + sum(r["count"] for r in bins if r["role"] == 2 and r["b"] >= b) / bad
        if lost <= MAX_LOSS and wrong < best:
            best, cut, share = wrong, b * CUT_STEP, min(MAX_LOSS, (lost * good + 1) / (good + 2))
    return cut, share


def kth_key(scores: DataFrame, k: int) -> float:
    """The k-th largest key, by counting in bins and narrowing to the bin that holds it."""
    ends = scores.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    low, high = ends["a"], ends["b"]
    if low is None or k <= 0:
        return math.inf
    while True:
        width = (high - low) / 1024
        inside = scores.filter((F.col("key") >= low) & (F.col("key") <= high))
        if width <= 1e-9:
            return low
        bins = {r["b"]: (r["count"], r["low"], r["high"]) for r in inside.groupBy(
            F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("b")).agg(
            F.count(F.lit(1)).alias("count"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b][0]:
                break
            k -= bins[b][0]
        else:
            return low
        if bins[b][0] == k or bins[b][1] == bins[b][2]:
            return bins[b][1]
        low, high = bins[b][1], bins[b][2]


def _fitted(docs: DataFrame, labels: DataFrame, sample: int):
    bound_batches(docs.sparkSession)
    rows = _with_role(docs, labels, sample)
    weights = fit(rows)
    scores = store(score(rows, weights), "importance")
    cut, share = cut_of(scores)
    above = scores.filter(F.col("importance") >= cut).count()
    return weights, scores, kth_key(scores, above + int(share * above))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, importance, key) of the rows that the sample keeps."""
    _, scores, least = _fitted(docs, labels, sample)
    return scores.filter(F.col("key") >= least).select("doc_id", "importance", "key")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns."""
    weights, _, least = _fitted(docs, labels, sample)
    release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    noise = "_parley_noise"
    while noise in docs.columns:
        noise += "_"
    text = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            key = _key(_importance(shared.value, batch.column(text)), batch.column(batch.num_columns - 1).to_numpy())
            table = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield table.filter(pa.array(key >= least))

    return docs.withColumn(noise, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(keep, docs.schema)
