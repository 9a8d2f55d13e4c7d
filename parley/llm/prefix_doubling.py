"""Suffix-array dedup by content-anchored windows of doubled ranks.

Every text position has a rank by its next h bytes; the rank by 2h bytes is that of the pair
(rank at i, rank at i + h). Ranks are content names, equal exactly where the bytes are equal,
so all doublings run inside a task and no rank pair goes through Spark. A window of
``threshold`` bytes is anchored at the least rank by ``FIRST`` bytes among its positions
(winnowing); Spark groups runs of windows by the anchor's name and compares them by their
whole content (see ``repeats``). This replaces the dealt rounds of sorting and reranking.

Nulls: a null text is empty, a null doc_id ranks after all others. A text shorter than the
threshold keeps all bytes. Repeated rows: equal ids never remove each other's bytes. Other
columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_NAME, text_buffer
from .repeats import repeated_windows

THRESHOLD = 50
FIRST = 20  # bytes at which ranks are compared across documents for the first time
SCHEMA = "doc_id long, text string, spans array<struct<lo:long,hi:long>>"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _bytes(data, off):
    lo, hi = int(off[0]), int(off[-1])
    return BYTE_NAME[data[lo:hi]], off - lo


def _anchors(first: int):
    def anchors(u, piece, rolling):
        rank = rolling.everywhere(first)
        return rank, rank, first
    return anchors


def _spans_of(rows: int, lo, hi, row):
    at = np.searchsorted(row, np.arange(rows + 1))
    return lo.tolist(), hi.tolist(), at.tolist()


def _text_and_spans(table, lo, hi, row):
    lo, hi, at = _spans_of(len(table), lo, hi, row)
    spans = [[{"lo": a, "hi": b} for a, b in zip(lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]])] for i in range(len(table))]
    return pa.table({"doc_id": table.column("doc_id"), "text": table.column("text"),
                     "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))})


def _digest(table, lo, hi, row):
    data, off = text_buffer(table.column("text"))
    lo, hi, at = _spans_of(len(table), lo, hi, row)
    view = memoryview(data)
    out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for i in range(len(table)):
        a, b = int(off[i]), int(off[i + 1])
        h, pos, removed = hashlib.sha256(), a, 0
        for x, y in zip(lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]]):
            h.update(view[pos:a + x])
            pos, removed = a + y, removed + y - x
        h.update(view[pos:b])
        for k, v in zip(out, (b - a, removed, at[i + 1] - at[i], h.hexdigest())):
            out[k].append(v)
    return pa.table({"doc_id": table.column("doc_id"), **{k: pa.array(v, pa.string() if k[0] == "k" else pa.int64()) for k, v in out.items()}})


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST, digest: bool = False, **options) -> DataFrame:
    """(doc_id, text, spans): per row of ``docs`` the byte ranges [lo, hi) covered by a
    string of ``threshold`` bytes that also starts in a document with a smaller doc_id;
    with ``digest``, counts and the hash of the bytes kept instead."""
    first = min(first, threshold)
    return repeated_windows(docs, threshold, _bytes, _anchors(first), True,
                            _digest if digest else _text_and_spans, DIGEST if digest else SCHEMA, **options)
