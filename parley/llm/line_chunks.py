"""Line dedup by overlapping chunks of lines.

A chunk reaches from a line that is not blank to the next such line, so it holds two of them
and shares each with its neighbour. No boundary is chosen: a passage of two or more lines
that repeats is covered by its own chunks, whatever stands before and after it. Chunks are
grouped by name over all documents; every occurrence but the first (smallest doc_id, then row
key, then position) fetches its bytes and the first one's, and its lines are removed if they
are equal. The first occurrence of a line is in no later chunk, so every line stays once. Hot
chunks combine before the shuffle, and the comparison is a join whose large side may be split.

Lines end at ``\\n``; the lines kept are joined by it. Nulls: a null text has no lines and
stays null, a null doc_id ranks after all others. Repeated rows, told apart by (doc_id,
text), share one verdict. Other columns are not read by ``line_dedup`` and kept by ``dedup``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U, batches_of_rows, store, text_buffer, word_names

CHUNKS = "name long, rk long, doc long, at int"
LINE_END = np.ones(256, bool)
LINE_END[10] = False
BLANK = np.zeros(256, bool)
BLANK[[9, 11, 12, 13, 32]] = True


def lines_of(data: np.ndarray, off: np.ndarray):
    """Lines of all rows: (row offsets of the lines, byte start, byte end). A text of n
    newlines has n + 1."""
    rows = len(off) - 1
    brk = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, brk, side="right") - 1
    count = np.bincount(owner, minlength=rows) + 1 if rows else np.zeros(0, np.int64)
    line_off = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    start = np.zeros(line_off[-1], np.int64)
    end = np.zeros(line_off[-1], np.int64)
    start[line_off[:-1]], end[line_off[1:] - 1] = off[:-1], off[1:]
    inner = np.ones(line_off[-1], bool)
    inner[line_off[:-1]] = False
    start[inner] = brk + 1
    inner = np.ones(line_off[-1], bool)
    inner[line_off[1:] - 1] = False
    end[inner] = brk
    return line_off, start, end


def spans_of(data: np.ndarray, lines):
    """Chunks of all rows from their ``lines``: (row, first line, line count, byte start, byte
    end). Lines count from 0 in their row."""
    line_off, start, end = lines
    text = ~BLANK[data] & LINE_END[data]
    seen = np.concatenate([[0], np.cumsum(text, dtype=np.int64)])
    solid = np.flatnonzero(seen[end] > seen[start])
    row = np.searchsorted(line_off, solid, side="right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    a, z, row = solid[pair], solid[pair + 1], row[pair]
    return row, a - line_off[row], z - a + 1, start[a], end[z]


def chunks_of(data: np.ndarray, off: np.ndarray):
    """``spans_of`` all rows and the names of the chunks."""
    row, at, n, lo, hi = spans_of(data, lines_of(data, off))
    name = np.zeros(len(lo), U)
    for k in (0, 1):  # every second chunk: those do not overlap
        name[k::2] = word_names(data, lo[k::2], hi[k::2])
    return row, at, n, lo, hi, name


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _list(batches):
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        rk, doc = batch.column("rk").to_numpy(), batch.column("doc").to_numpy()
        for a, b in batches_of_rows(off, 1 << 20):
            row, _, _, _, _, name = chunks_of(data[off[a]:off[b]], off[a:b + 1] - off[a])
            place = np.arange(len(row)) - np.searchsorted(row, row)  # the chunk's number in its row
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(rk[a + row]), pa.array(doc[a + row]), pa.array(place.astype(np.int32))],
                names=["name", "rk", "doc", "at"])


def _fetch(batches):
    """The bytes of the chunks listed in ``wanted``."""
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        view = memoryview(data)
        wanted = batch.column("wanted").to_pylist()
        rk = batch.column("rk").to_pylist()
        for a, b in batches_of_rows(off, 1 << 20):
            part = data[off[a]:off[b]]
            row, _, _, lo, hi = spans_of(part, lines_of(part, off[a:b + 1] - off[a]))
            base = np.searchsorted(row, np.arange(b - a))
            out = ([], [], [], [], [])
            for i in range(a, b):
                for w in wanted[i]:
                    j = base[i - a] + w["at"]
                    for x, y in zip(out, (w["name"], rk[i], w["at"], w["first"], bytes(view[off[a] + lo[j]:off[a] + hi[j]]))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())],
                names=["name", "rk", "at", "first", "bytes"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(rk, gone array<int>): per row key the numbers of the chunks to remove."""
    rows = _rows(docs)
    listed = store(rows.select("rk", "doc", "text").mapInArrow(_list, CHUNKS), "chunks")
    place = F.struct("doc", "rk", "at")
    shared = listed.groupBy("name").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most").select("name", "least")
    wanted = store(listed.distinct().join(shared, "name").groupBy("rk").agg(F.collect_list(
        F.struct("at", "name", (place == F.col("least")).alias("first"))).alias("wanted")), "wanted")
    fetched = store(rows.select("rk", "text").join(wanted.hint("merge"), "rk").groupBy("rk").agg(
        F.first("text").alias("text"), F.first("wanted").alias("wanted")).mapInArrow(
        _fetch, "name long, rk long, at int, first boolean, bytes binary"), "chunk-bytes")
    first = fetched.filter("first").select("name", F.col("bytes").alias("_bytes"))
    gone = fetched.filter("not first").join(first, "name").filter(F.col("bytes") == F.col("_bytes"))
    return store(gone.groupBy("rk").agg(F.collect_list("at").alias("gone")), "gone")


def _kept(texts, gone):
    """Per row (kept text, lines, lines removed)."""
    data, off = text_buffer(texts)
    view = memoryview(data)
    null = texts.is_null().to_pylist()
    kept, lines, removed = [], [], []
    for a, b in batches_of_rows(off, 1 << 20):
        part, span = data[off[a]:off[b]], off[a:b + 1] - off[a]
        line_off, lo, hi = lines_of(part, span)
        if any(gone[a:b]):
            row, at, n, _, _ = spans_of(part, (line_off, lo, hi))
            base = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(a, b):
            s, e = int(line_off[i - a]), int(line_off[i - a + 1])
            if null[i]:
                kept.append(None), lines.append(0), removed.append(0)
                continue
            out = np.zeros(e - s, bool)
            for k in gone[i] or ():
                j = base[i - a] + k
                out[at[j]:at[j] + n[j]] = True
            if out.any():
                kept.append(b"\n".join(bytes(view[off[a] + lo[j]:off[a] + hi[j]]) for j in (s + np.flatnonzero(~out)).tolist()))
            else:
                kept.append(bytes(view[off[i]:off[i + 1]]))
            lines.append(e - s), removed.append(int(out.sum()))
    return pa.array(kept, pa.binary()).cast(pa.string()), lines, removed


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row: the text without repeated chunks."""
    rows = _rows(docs).select("rk", "doc_id", "text").join(repeated_chunks(docs).hint("merge"), "rk", "left").select("doc_id", "text", "gone")

    def cut(batches):
        for batch in batches:
            text, lines, removed = _kept(batch.column("text"), batch.column("gone").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())],
                                             names=["doc_id", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(cut, "doc_id long, text string, n_lines long, n_removed long")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text`` and ``n_chars``, if there, counted
    anew; rows of whose text only blank lines are left go."""
    key, gone = "_parley_row", "_parley_gone"
    while key in docs.columns or gone in docs.columns:
        key, gone = key + "_", gone + "_"
    cuts = repeated_chunks(docs).select(F.col("rk").alias(key), F.col("gone").alias(gone))
    joined = docs.withColumn(key, _row_key()).join(cuts.hint("merge"), key, "left").drop(key)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for batch in batches:
            text, _, removed = _kept(batch.column(at), batch.column(batch.num_columns - 1).to_pylist())
            columns = list(batch.columns[:-1])
            columns[at] = text
            table = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            said = [not r or bool(t.strip()) for r, t in zip(removed, text.to_pylist())]
            yield table.filter(pa.array(said, pa.bool_()))

    out = joined.mapInArrow(cut, docs.schema)
    if count is not None:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
