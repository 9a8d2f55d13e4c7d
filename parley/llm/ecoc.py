"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier tells the languages
with a one there from those with a zero. All are naive Bayes models over hashed byte
n-grams, made from one Spark aggregation of n-gram counts by language over all training
rows. Up to seven languages take the exhaustive code (every way to split them), more take
rows of a Hadamard matrix, whose words differ in half their bits. Decoding adds up, for each
language, the logistic loss of each bit's margin, weighted by how far that bit's classifier
separates its two sides, and takes the least; a small lead over the next one is flagged as
ambiguous.

A row is held out if crc32(doc_id as text) mod 4 is 2; training takes rows with a known,
other remainder and a non-null lang. Null text or one without a letter: ``und``, score 0, as
is every text when nothing was learned. A null doc_id is not held out and teaches nothing.
Repeated rows count as often as they stand. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, TO_LOWER, U, batches_of_rows, text_buffer

ORDERS, BITS = (2, 3, 4), 11  # n-gram lengths in bytes, 2 ** BITS buckets for each
SMOOTH, FULL_EVIDENCE, SHARPNESS, AMBIGUOUS = 0.5, 60, 12.0, 0.2
MAX_LANGUAGES = 512  # bound of the model: languages x buckets counts
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
#: letters and bytes of longer characters stay, all else is one space
LETTER = TO_LOWER.copy()
LETTER[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte n-gram inside a row."""
    text = LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(text))
    rows, buckets = [], []
    code = text.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] << np.uint32(8) | text[n - 1:] if len(code) > 1 else code[:0]
        if n in ORDERS:
            at = np.flatnonzero(left[:len(code)] >= n)
            h = (code[at].astype(U) + U(n << 40)) * GOLD >> U(64 - BITS)
            rows.append(row[at]), buckets.append(h.astype(np.int64) + (ORDERS.index(n) << BITS))
    return np.concatenate(rows), np.concatenate(buckets)


def code_words(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language."""
    if languages <= 1:
        return np.zeros((languages, 0))
    if languages <= 7:
        bits = np.arange(1, 2 ** (languages - 1))
        return np.array([[1 - 2 * (b >> k & 1) for b in bits] for k in range(languages)], float)
    h = np.ones((1, 1))
    while len(h) <= languages:
        h = np.block([[h, h], [h, -h]])
    return h[1:languages + 1, 1:]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights per bucket and bit) from the training rows."""
    width = len(ORDERS) << BITS

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            data, off = text_buffer(batch.column("text"))
            for a, b in batches_of_rows(off, 1 << 19):
                row, bucket = ngrams(data[off[a]:off[b]], off[a:b + 1] - off[a])
                names = {x: i for i, x in enumerate(dict.fromkeys(langs[a:b]))}
                which = np.array([names[x] for x in langs[a:b]])
                sums = np.bincount(which[row] * width + bucket, minlength=len(names) * width).reshape(-1, width)
                for x, i in names.items():
                    found[x] = found[x] + sums[i] if x in found else sums[i]
        for x, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "bucket", "n"])

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.filter((remainder != 2) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(by_lang), width))
    for i, r in enumerate(by_lang):
        for x in r["c"]:
            table[i, x["bucket"]] = x["n"]
    share = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * width)
    words = code_words(len(by_lang))
    logs = np.stack([np.log(share[words[:, b] > 0].mean(axis=0)) - np.log(share[words[:, b] < 0].mean(axis=0))
                     for b in range(words.shape[1])], axis=1) if words.size else np.zeros((width, 0))
    return [r["lang"] for r in by_lang], words, logs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""
    languages, words, logs = model
    width = len(ORDERS) << BITS
    # a bit counts by how far its classifier separates the two sides
    trust = np.abs(logs).mean(axis=0) if logs.size else np.zeros(0)
    trust = trust / max(trust.sum(), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((logs, words, trust))

    def score(batches):
        logs, words, trust = shared.value
        for batch in batches:
            n = batch.num_rows
            data, off = text_buffer(batch.column("text"))
            best, value, doubt = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            for a, b in batches_of_rows(off, 1 << 18) if len(languages) > 1 else ():
                for a, b in [(x, min(b, x + 128)) for x in range(a, b, 128)]:
                    row, bucket = ngrams(data[off[a]:off[b]], off[a:b + 1] - off[a])
                    bag = np.bincount(row * width + bucket, minlength=(b - a) * width).reshape(-1, width)
                    total = bag.sum(axis=1)
                    margin = bag @ logs / np.maximum(total, 1)[:, None]
                    margin *= (SHARPNESS * np.minimum(1, total / FULL_EVIDENCE))[:, None]
                    loss = np.logaddexp(0, -margin[:, None, :] * words[None]) @ trust
                    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
                    p /= p.sum(axis=1, keepdims=True)
                    order = np.sort(p, axis=1)
                    best[a:b], value[a:b] = p.argmax(axis=1), order[:, -1]
                    doubt[a:b] = order[:, -1] - order[:, -2] < AMBIGUOUS
            if len(languages) == 1:
                value[:], doubt[:] = 1.0, False
            readable = np.array(batch.column("has_letter").to_pylist(), bool) & bool(languages)
            names = [languages[i] if ok else "und" for i, ok in zip(best, readable)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                 pa.array(np.where(readable, value, 0.0)), pa.array(doubt | ~readable)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    id_text = F.col("doc_id").cast("string").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(id_text) % 4 == 2, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
