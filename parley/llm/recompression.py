"""Substring dedup by recompression.

A text is a sequence of word names. Each round replaces maximal runs of one symbol by a
name for (symbol, length), then every adjacent pair whose left symbol falls in the round's
left half of the names and whose right symbol falls in the right half by a name for the
pair. The names are made of the names they replace, the halves of the names too, so equal
substrings anywhere in the corpus get the same symbols except near their ends; no
dictionary has to be exchanged to name a pair globally. Each symbol carries the range of
words that settled it. All ``ROUNDS`` rounds run inside a task, over one chunk of texts. Spark
then groups the high-level symbols by name, together with the ``CONTEXT`` words that settle
them: they are the anchors of windows. A symbol that stands once reveals that no window
holding it repeats; shared ones lead to the windows, whose whole content is then compared
(see ``repeats``). No round exchanges pair names through Spark.

A window in which no symbol is settled (long runs of one word) is compared by itself.

Nulls: a null text has no word. A text with fewer words than the window keeps all. Repeated
rows count as places of their own, so both lose their windows. Other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import GOLD, IS_SPACE, U, batches_of_rows, mix64, split_spans, word_names
from .prefix_doubling import _spans_of, _text_and_spans
from .repeats import NONE, repeated_windows

WINDOW = 35
ROUNDS = 3
CONTEXT = 16  # words that may settle a symbol, so that 20 windows see it
SCHEMA = "doc_id long, text string, spans array<struct<lo:long,hi:long>>"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FAR = 1 << 40


def words(data, off):
    """(word names, offsets of the rows in words), a few MB of text at a time."""
    names, ends = [], [np.zeros(1, np.int64)]
    total = 0
    for d, e in batches_of_rows(off, 1 << 20):
        part = data[off[d]:off[e]]
        start, end, at = split_spans(~IS_SPACE[part], off[d:e + 1] - off[d])
        names.append(word_names(part, start, end))
        ends.append(at[1:] + total)
        total += len(start)
    return (np.concatenate(names) if names else np.zeros(0, U)), np.concatenate(ends)


def recompress(u: np.ndarray, piece: np.ndarray, rounds: int):
    """Symbols after ``rounds`` rounds: (name, lo, hi), settled by the words [lo, hi)."""
    name, lo = u, np.arange(len(u))
    hi = lo + 1
    row = piece
    for r in range(rounds):
        if len(name) < 2:
            break
        # runs
        same = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(at[1:], len(name)) - 1
        n = last - at + 1
        edge = row[at][1:] != row[at][:-1]
        before = np.concatenate([[-FAR], np.where(edge, -FAR, lo[last[:-1]])])
        after = np.concatenate([np.where(edge, FAR, hi[at[1:]]), [FAR]])
        new = np.where(n > 1, mix64(name[at] * GOLD + n.astype(U)), name[at])
        lo, hi, row, name = np.minimum(lo[at], before), np.maximum(hi[last], after), row[at], new
        # pairs
        right = (mix64(name + U(r + 1)) & U(1)).astype(bool)
        linked = row[1:] == row[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & linked
        tail = np.concatenate([[False], pair[:-1]])
        before = np.concatenate([[-FAR], np.where(linked, lo[:-1], -FAR)])
        after = np.concatenate([np.where(linked, hi[1:], FAR), [FAR]])
        nxt = np.append(name[1:], U(0))
        name = np.where(pair, mix64(name * U(0xA0761D6478BD642F) + mix64(nxt)), name)
        # a left symbol looked at its right neighbour, a right one at its left
        lo, hi = np.where(right, np.minimum(lo, before), lo), np.where(right, hi, np.maximum(hi, after))
        keep = ~tail
        name, lo, hi, row = name[keep], lo[keep], hi[keep], row[keep]
    return name, lo, hi


def _anchors(rounds: int, context: int):
    def anchors(u, piece, rolling):
        name, lo, hi = recompress(u, piece, rounds)
        good = np.flatnonzero((lo >= 0) & (hi - lo <= context))
        value, names = np.full(len(u), NONE, U), np.zeros(len(u), U)
        rank = mix64(name[good] ^ GOLD) >> U(1)
        o = np.argsort(rank)[::-1]  # of symbols settled from the same word on, the least stays
        at = lo[good][o]
        value[at] = rank[o]
        whole = np.flatnonzero(at + context <= len(u))  # the others are in no window
        names[at[whole]] = name[good][o][whole] * GOLD + rolling.at(at[whole], context)
        return value, names, context
    return anchors


def _digest(table, lo, hi, row):
    lo, hi, at = _spans_of(len(table), lo, hi, row)
    out = {"n_words": [], "n_removed": [], "kept_sha256": []}
    for i, text in enumerate(table.column("text").to_pylist()):
        w = (text or "").encode().split()
        kept, pos = [], 0
        for x, y in zip(lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]]):
            kept += w[pos:x]
            pos = y
        kept += w[pos:]
        for k, v in zip(out, (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
            out[k].append(v)
    return pa.table({"doc_id": table.column("doc_id"), **{k: pa.array(v, pa.string() if k[0] == "k" else pa.int64()) for k, v in out.items()}})


def repeated_passages(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, context: int = CONTEXT,
                      digest: bool = False, **options) -> DataFrame:
    """(doc_id, text, spans): per row of ``docs`` the word ranges [lo, hi) covered by a
    window of ``window`` words that also starts anywhere else, the same text included;
    with ``digest``, counts and the hash of the words kept instead. Words are maximal runs
    of bytes other than space and the controls 9 to 13, unchanged."""
    return repeated_windows(docs, window, words, _anchors(rounds, min(context, window)), False,
                            _digest if digest else _text_and_spans, DIGEST if digest else SCHEMA, **options)
