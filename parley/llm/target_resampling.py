"""Resampling towards a target distribution, ranked by a distributed radix sort.

Features are all runs of one to three consecutive words, hashed into ``BUCKETS`` buckets. One
pass over the documents and one over the target texts count the buckets; a bucket's gain is
the scaled logarithm of its share in the target over its share in the documents, both with
one added per bucket. A second pass scores every document by an array lookup per feature.
Seeded Gumbel noise makes the highest scores a sample drawn by weight.

The draw ranks rows by least-significant-digit radix sort. Rows lie in blocks of bounded size
in their current order. A pass counts (block, digit) pairs, turns the counts into global
offsets (all rows of smaller digits, then rows of the same digit in earlier blocks), and a
row's destination is its offset plus its place among the rows of its block and digit. The
destination is the row's new position, so equal digits keep their order; after the pass over
the highest digit the position is the rank. No group is larger than a block, whatever the
keys hold, and every pass ends in a table in the shared folder.

Nulls: a null text has no feature and weight 0; a null doc_id hashes like an empty one and
ranks after all others. Repeated rows count each time; rows equal in score and doc_id rank by
fewer features first. Very long texts are taken apart in slices of rows, one text being one
slice at least. Empty tables give no row; an empty target gives gains from the documents
alone. Other columns are not read.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, batches_of_rows, drop_stored, split_spans, store, text_buffer

BUCKETS, SHARE_PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, 42
DIGIT_BITS, BLOCK_ROWS = 12, 1 << 20
SCALE = 1000
#: Bytes of words: digits, letters a to z (after lower-casing) and all of longer characters.
IN_WORD = np.zeros(256, np.uint8)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
ALL_ONES = np.uint32(0xFFFFFFFF)
LONG_WORD = 48


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """[length, byte of the checksum, its value]: what a checksum turns into when ``length``
    zero bytes follow; a checksum of joined strings is this of the first, xor the second's."""
    t = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [t]
    for _ in range(256):
        t = STEP[t & 255] ^ (t >> 8)
        out.append(t)
    return np.stack(out)


SHIFT = _shift_tables()


def _shifted(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of A + B from those of A and B and the byte length of B."""
    low = length & 255
    c = (SHIFT[low, 0, first & 255] ^ SHIFT[low, 1, first >> 8 & 255]
         ^ SHIFT[low, 2, first >> 16 & 255] ^ SHIFT[low, 3, first >> 24])
    rest, table = length >> 8, SHIFT[256]
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        c[odd] = _shifted(table, c[odd])
        rest, table = rest >> 1, _shifted(table, table)
    return c ^ second


def with_space(c: np.ndarray) -> np.ndarray:
    c = c ^ ALL_ONES
    return STEP[(c ^ 0x20) & 255] ^ (c >> 8) ^ ALL_ONES


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of every word data[start:end], a byte position of all words at a time."""
    c = np.full(len(start), ALL_ONES)
    length = end - start
    live = np.flatnonzero(length <= LONG_WORD)
    k = 0
    while len(live):
        c[live] = STEP[(c[live] ^ data[start[live] + k]) & 255] ^ (c[live] >> 8)
        k += 1
        live = live[length[live] > k]
    c ^= ALL_ONES
    for i in np.flatnonzero(length > LONG_WORD):
        c[i] = zlib.crc32(data[start[i]:end[i]])
    return c


def grams(data: np.ndarray, off: np.ndarray):
    """(word offsets of the rows, buckets of the runs of one, two and three words that start
    at each word; -1 where the row ends before)."""
    data = TO_LOWER[data]
    start, end, at = split_spans(IN_WORD[data], off)
    length = end - start
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(at))
    c = word_checksums(data, start, end)
    out = [(c % BUCKETS).astype(np.int32)]
    run = c
    for n in (2, 3):
        b = np.full(len(c), -1, np.int32)
        if len(c) >= n:
            run = joined(with_space(run[:-1]), c[n - 1:], length[n - 1:])
            same = row[n - 1:] == row[:1 - n]
            b[:1 - n][same] = (run % BUCKETS)[same]
        out.append(b)
    return at, out


def _slices(batch, column: str):
    data, off = text_buffer(batch.column(column))
    for a, b in batches_of_rows(off, 1 << 19):
        yield a, b, grams(data[off[a]:off[b]], off[a:b + 1] - off[a])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over all rows; ``BUCKETS`` numbers reach the driver."""

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, _, (_, found) in _slices(batch, "text"):
                for b in found:
                    total += np.bincount(b + 1, minlength=BUCKETS + 1)
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[1:][some])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log of the share of each bucket in the target over that in the raw texts."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    gain = np.concatenate([gain, [0]])  # the last one for runs that leave their row

    def run(batches):
        for batch in batches:
            words = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for a, b, (at, found) in _slices(batch, "text"):
                upto = np.concatenate([[0], np.cumsum(sum(gain[x] for x in found))])
                words[a:b], weight[a:b] = np.diff(at), upto[at[1:]] - upto[at[:-1]]
            n = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """Scaled standard Gumbel noise, drawn from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def counting_pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One stable pass: rows (.., _block, _pos) in the order of (_block, _pos) get the position
    that sorting by ``digit`` gives them."""
    t = rows.withColumn("_digit", digit)
    counts = t.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select(  # one row per digit value
        "_digit", before(Window.orderBy("_digit")).alias("_base"))
    earlier = before(Window.partitionBy("_digit").orderBy("_block"))
    offsets = counts.select("_block", "_digit", earlier.alias("_earlier")).join(F.broadcast(smaller), "_digit") \
        .select("_block", "_digit", (F.col("_base") + F.col("_earlier")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_pos")).cast("long") - 1
    to = F.col("_start") + F.col("_place")
    return t.withColumn("_place", place).join(offsets, ["_block", "_digit"]) \
        .withColumn("_pos", to).withColumn("_block", F.floor(to / F.lit(block_rows)).cast("long")) \
        .drop("_digit", "_place", "_start")


def radix_rank(rows: DataFrame, n: int, keys: list[tuple[Column, int]], digit_bits: int = DIGIT_BITS,
               block_rows: int | None = None) -> DataFrame:
    """``rows`` with ``_pos``, the place from 0 in ascending order of ``keys``, given least
    significant first as (non-negative long, greatest value); ``n`` is the number of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = block_rows or max(1, min(BLOCK_ROWS, n // (4 * parts)))
    at = F.monotonically_increasing_id()
    now = store(rows.withColumn("_pos", at).withColumn("_block", F.pmod(F.xxhash64("_pos"), F.lit(n // block + 1)).cast("long")), "radix")
    for key, most in keys:
        passes = -(-int(most).bit_length() // digit_bits)
        width = -(-int(most).bit_length() // max(passes, 1))
        for k in range(passes):
            digit = F.shiftrightunsigned(key, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
            last, now = now, store(counting_pass(now, digit, block), "radix")
            drop_stored(last)
    return now


def resample(docs: DataFrame, target: DataFrame, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, digit_bits: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null but for the
    highest ``percent`` of the rows with ``least_words`` words or more."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = store(weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(seed)), "weights")
    fit = F.col("n_words") >= least_words
    s = scored.filter(fit).agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("high"), F.min("score").alias("low"), F.max("n_features").alias("features"),
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("doc_id").alias("ids")).first()
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not s["n"]:
        return rest
    keys = [(F.col("n_features"), s["features"])]
    if s["ids"]:
        if s["last"] - s["first"] < 2**63:
            keys.append((F.coalesce(F.col("doc_id") - F.lit(s["first"]), F.lit(0)), s["last"] - s["first"]))
        else:  # wider than a long: the bits of an unsigned number in the same order
            keys.append((F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(-2**63)), F.lit(0)), 2**64 - 1))
    if s["ids"] < s["n"]:
        keys.append((F.col("doc_id").isNull().cast("long"), 1))
    keys.append((F.lit(s["high"]) - F.col("score"), s["high"] - s["low"]))
    ranked = radix_rank(scored.filter(fit).select(*columns), s["n"], keys, digit_bits, block_rows)
    drawn = percent * s["n"] // 100
    return ranked.select(*columns, F.when(F.col("_pos") < drawn, F.col("_pos") + 1).alias("rank")).unionByName(rest)
