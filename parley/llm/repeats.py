"""Repeated windows of a corpus: which windows of ``width`` consecutive units (bytes or
words) occur again, decided exactly for every window of every text.

Shipping one name per window would move many times the input. Instead windows are taken
together that share an *anchor*: a position chosen from the window's own content, so equal
windows choose alike wherever they stand. A *run* is a maximal row of windows of one text
with the same anchor position; it has the anchor's name as its key and the name of all its
content. Three passes over the texts, each with one exchange of names:

1. runs: per chunk of texts, each distinct (key, run) goes out once with its smallest
   document. A key that stands in one run only is unique: none of its windows can occur
   again, and it drops out. Equal runs are settled whole. Runs of one key that differ may
   still share some windows.
2. windows: one representative of each run of such a mixed key sends its windows' names.
3. marks: every chunk gets the names that count as repeated and marks its windows.

Hot keys: chunks combine before they send, so a key costs a chunk one row per distinct run,
and a key with more than ``HOT_RUNS`` runs in a chunk is dealt by (key, run) instead, with
one summary row in the key's own partition. Windows are dealt by their own names. No group
of rows ever has to fit one task beyond one row per chunk.

Names are 64 bits, and two names (key and content) must agree.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U, Rolling, chunk_count, mix64, sliding_min, store, text_buffer, with_chunk

ASK = "part int, chunk int, key binary, name binary, doc binary, flag binary"
REPLY = "chunk int, kind int, name binary"
MANY, SUMMARY = 1, 2          # bits of flag
WHOLE, SEND, WINDOW = 0, 1, 2  # kinds of reply
HOT_RUNS = 256
POS_BITS = 20
NONE = np.iinfo(np.uint64).max
CID = U(0xD6E8FEB86659FD93)


def _pieces(off: np.ndarray, width: int, size: int):
    """Batches of (row, lo, hi): ranges of units with all windows of the rows; a row longer
    than ``size`` windows is cut into ranges that overlap by width - 1."""
    rows, lo, hi, total = [], [], [], 0
    for d in range(len(off) - 1):
        a, end = int(off[d]), int(off[d + 1])
        while end - a >= width:
            b = min(end, a + size + width - 1)
            rows.append(d), lo.append(a), hi.append(b)
            total += b - a
            if total >= size:
                yield np.array(rows), np.array(lo), np.array(hi)
                rows, lo, hi, total = [], [], [], 0
            if b == end:
                break
            a = b - width + 1
    if rows:
        yield np.array(rows), np.array(lo), np.array(hi)


def find_runs(units: np.ndarray, off: np.ndarray, width: int, anchors: Callable, size: int = 1 << 17,
              wanted: np.ndarray | None = None):
    """Runs of all windows: (row, start, n, key, name); with ``wanted`` (sorted run ids),
    also (row, start, key, name) of every single window in those runs.

    ``anchors(u, rows, rolling)`` gives (value, name, span) per position: the priority of a
    candidate that is settled by the ``span`` units from there on (NONE: no candidate), and
    its name."""
    runs, windows = [], []
    for rows, lo, hi in _pieces(off, width, size):
        u = np.concatenate([units[a:b] for a, b in zip(lo, hi)])
        lens = hi - lo
        base = np.cumsum(lens) - lens
        piece = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        rolling = Rolling(u, width)
        value, name, span = anchors(u, piece, rolling)
        value = np.where(value == NONE, NONE, (value >> U(POS_BITS) << U(POS_BITS)) | np.arange(len(u), dtype=U))
        best = sliding_min(value, width - span + 1)
        left = np.repeat(base + lens, lens) - np.arange(len(u))
        s = np.flatnonzero(left >= width)
        b, p = best[s], piece[s]
        new = np.ones(len(s), bool)
        new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1]) | (b[1:] == NONE)
        at = np.flatnonzero(new)
        start, n = s[at], np.diff(np.append(at, len(s)))
        first, last = rolling.at(start, width), rolling.at(start + n - 1, width)
        anchor = (b[at] & U((1 << POS_BITS) - 1)).astype(np.int64)
        bare = b[at] == NONE
        key = np.where(bare, first, mix64(name[np.where(bare, 0, anchor)]))
        whole = mix64(first * U(3) + last * U(0x9E3779B97F4A7C15) + n.astype(U))
        shift = lo[p[at]] - base[p[at]]
        row = rows[p[at]]
        runs.append((row, start + shift, n, key, whole))
        if wanted is not None:
            hit = np.flatnonzero(_among(key * CID + whole, wanted))
            if len(hit):
                k = np.repeat(hit, n[hit])
                w = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                windows.append((row[k], w + shift[k], key[k], rolling.at(w, width)))
    empty = np.zeros(0, np.int64)
    join = lambda parts, kinds: [np.concatenate(x) for x in zip(*parts)] if parts else [empty.astype(t) for t in kinds]
    out = join(runs, (np.int64, np.int64, np.int64, U, U))
    return out if wanted is None else (out, join(windows, (np.int64, np.int64, U, U)))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending int64 values as differences in the narrowest width that holds them."""
    if not len(x):
        return b""
    d = np.diff(x.astype(np.uint64))
    top = int(d.max()) if len(d) else 0
    kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8"
    return kind[1].encode() + int(x[0]).to_bytes(8, "little", signed=True) + d.astype("<" + kind).tobytes()


def _unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    d = np.frombuffer(b, dtype="<u" + b[:1].decode(), offset=9)
    first = np.array([int.from_bytes(b[1:9], "little", signed=True)]).astype(np.uint64)
    return np.cumsum(np.concatenate([first, d.astype(np.uint64)])).astype(np.int64)


def _distinct(key, name, doc):
    """Distinct (key, name) with the smallest doc and whether there are several rows:
    (key, name, doc, many)."""
    if not len(key):
        return key, name, doc, np.zeros(0, bool)
    o = np.lexsort((doc, name, key))
    k, m, d = key[o], name[o], doc[o]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    at = np.flatnonzero(new)
    return k[at], m[at], d[at], np.diff(np.append(at, len(k))) > 1


def _ask_batches(chunk: int, parts: int, key, name, doc, flag, deal):
    """One Arrow row per partition: the names this chunk asks about."""
    part = (deal % U(parts)).astype(np.int64)
    o = np.lexsort((doc, part))
    key, name, doc, flag, part = key[o], name[o], doc[o], flag[o], part[o]
    cut = np.flatnonzero(np.diff(part)) + 1
    at = [0, *cut.tolist(), len(part)]
    out = [[], [], [], [], [], []]
    for a, b in zip(at[:-1], at[1:]):
        if a < b:
            for x, y in zip(out, (int(part[a]), chunk, key[a:b].tobytes(), name[a:b].tobytes(), _pack_sorted(doc[a:b]), flag[a:b].tobytes())):
                x.append(y)
    return pa.table({"part": pa.array(out[0], pa.int32()), "chunk": pa.array(out[1], pa.int32()),
                     **{n: pa.array(out[i + 2], pa.binary()) for i, n in enumerate(("key", "name", "doc", "flag"))}})


def _answer(by_first: bool, windows: bool):
    """The reducer of one partition of names."""

    def answer(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        key = np.concatenate([np.frombuffer(x, U) for x in col["key"]])
        name = np.concatenate([np.frombuffer(x, U) for x in col["name"]])
        flag = np.concatenate([np.frombuffer(x, np.uint8) for x in col["flag"]])
        doc = np.concatenate([_unpack_sorted(x) for x in col["doc"]])
        chunk = np.repeat(np.array(col["chunk"]), [len(x) for x in col["flag"]])
        del col
        o = np.lexsort((chunk, doc, name, key))
        key, name, flag, doc, chunk = key[o], name[o], flag[o], doc[o], chunk[o]
        summary = flag & SUMMARY > 0
        newkey = np.ones(len(key), bool)
        newkey[1:] = key[1:] != key[:-1]
        new = newkey.copy()
        new[1:] |= name[1:] != name[:-1]
        new |= summary  # each summary row stands alone
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(key)))
        least = doc[at][group]
        several = ((count > 1) | (np.maximum.reduceat(flag & MANY, at) > 0))[group]
        kinds = []
        if by_first:
            kinds.append((WHOLE, least < doc))
        else:
            kinds.append((WHOLE, several))
        if windows:
            kinds = [(WINDOW, kinds[0][1])]
        else:
            k = np.cumsum(newkey) - 1
            mixed = (np.bincount(k, weights=new) > 1) | (np.bincount(k, weights=summary) > 0)
            # a key dealt by (key, run) is mixed in every partition; its rows say so
            kinds.append((SEND, (mixed[k] | (flag & 4 > 0)) & (new if not by_first else least == doc)))
        cid = key * CID + name
        rows = [[], [], []]
        for kind, pick in kinds:
            pick = np.flatnonzero(pick & ~summary)
            pick = pick[np.argsort(chunk[pick], kind="stable")]
            c = chunk[pick]
            cut = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a < b:
                    rows[0].append(int(c[a])), rows[1].append(kind), rows[2].append(cid[pick[a:b]].tobytes())
        return pa.table({"chunk": pa.array(rows[0], pa.int32()), "kind": pa.array(rows[1], pa.int32()),
                         "name": pa.array(rows[2], pa.binary())})

    return answer


def _replies(table: pa.Table) -> dict[int, np.ndarray]:
    got = {WHOLE: [], SEND: [], WINDOW: []}
    for kind, name in zip(table.column("kind").to_pylist(), table.column("name").to_pylist()):
        got[kind].append(np.frombuffer(name, U))
    return {k: np.sort(np.concatenate(v)) if v else np.zeros(0, U) for k, v in got.items()}


def _in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows by doc_id, null last; ties by text, so every pass sees one order."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NULL_ID).to_numpy().astype(np.int64) if len(table) else np.zeros(0, np.int64)


def repeated_windows(docs: DataFrame, width: int, units: Callable, anchors: Callable, by_first: bool,
                     finish: Callable, schema: str, chunk_bytes: int = 16 << 20, parts: int | None = None) -> DataFrame:
    """Marks every window of ``width`` units that also starts elsewhere and hands each
    chunk's marks to ``finish``.

    units(data, off) -> (unit names, row offsets in units); by_first: a window counts if it
    also starts in a document with a smaller id, otherwise if it starts at any other place.
    finish(table, lo, hi, row) -> Arrow table, for removed spans [lo, hi) of units, by row.
    """
    spark = docs.sparkSession
    chunks = chunk_count(docs, chunk_bytes)
    parts = parts or max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_chunk(docs, chunks)
    answer = {w: _answer(by_first, w) for w in (False, True)}

    def ask_runs(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = _in_order(table)
        u, off = units(*text_buffer(table.column("text")))
        row, _, _, key, name = find_runs(u, off, width, anchors)
        key, name, doc, many = _distinct(key, name, _doc_ids(table)[row])
        flag = many.astype(np.uint8)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        hot = np.repeat(size > HOT_RUNS, size) if len(key) else np.zeros(0, bool)
        flag[hot] |= 4
        deal = np.where(hot, mix64(key ^ name), mix64(key))
        first = at[size > HOT_RUNS] if len(key) else at
        key, name, doc, deal = (np.concatenate([x, x[first]]) for x in (key, name, doc, deal))
        deal[len(flag):] = mix64(key[len(flag):])
        flag = np.concatenate([flag, np.full(len(first), SUMMARY, np.uint8)])
        return _ask_batches(chunk, parts, key, name, doc, flag, deal)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _ask_batches(0, parts, *(np.zeros(0, t) for t in (U, U, np.int64, np.uint8, U)))
        chunk = table.column("chunk")[0].as_py()
        table = _in_order(table)
        u, off = units(*text_buffer(table.column("text")))
        _, (row, _, key, name) = find_runs(u, off, width, anchors, wanted=_replies(replies)[SEND])
        key, name, doc, many = _distinct(key, name, _doc_ids(table)[row])
        return _ask_batches(chunk, parts, key, name, doc, many.astype(np.uint8), mix64(name ^ (key >> U(7))))

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return finish(table, *(np.zeros(0, np.int64),) * 3)
        got = _replies(replies)
        table = _in_order(table)
        u, off = units(*text_buffer(table.column("text")))
        (row, start, n, key, name), (wrow, wstart, wkey, wname) = find_runs(u, off, width, anchors, wanted=got[SEND])
        doc = _doc_ids(table)

        def counted(row, key, name, said):
            cid = key * CID + name
            o = np.argsort(cid, kind="stable")  # rows are in the documents' order: the first is the smallest
            new = np.ones(len(o), bool)
            new[1:] = cid[o][1:] != cid[o][:-1]
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            out = np.zeros(len(o), bool)
            if len(o):
                here = doc[row[o]] > doc[row[o]][at][group] if by_first else (np.diff(np.append(at, len(o))) > 1)[group]
                out[o] = here
            return out | _among(cid, said)

        whole = counted(row, key, name, got[WHOLE])
        single = counted(wrow, wkey, wname, got[WINDOW])
        r = np.concatenate([row[whole], wrow[single]])
        lo = np.concatenate([start[whole], wstart[single]])
        hi = np.concatenate([start[whole] + n[whole] - 1 + width, wstart[single] + width])
        o = np.argsort(lo, kind="stable")
        r, lo, hi = r[o], lo[o], hi[o]
        if len(lo):
            reach = np.maximum.accumulate(hi)
            new = np.ones(len(lo), bool)
            new[1:] = (lo[1:] > reach[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            lo, hi, r = lo[at], np.maximum.reduceat(hi, at), r[at]
        return finish(table, lo - off[r], hi - off[r], r)

    asked = dealt.groupBy("chunk").applyInArrow(lambda t: ask_runs(t), ASK)
    runs = store(asked.groupBy("part").applyInArrow(lambda t: answer[False](t), REPLY), "runs")
    asked = dealt.groupBy("chunk").cogroup(runs.filter(F.col("kind") == SEND).groupBy("chunk")).applyInArrow(
        lambda a, b: ask_windows(a, b), ASK)
    windows = store(asked.groupBy("part").applyInArrow(lambda t: answer[True](t), REPLY), "windows")
    said = runs.unionByName(windows)
    return dealt.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(lambda a, b: mark(a, b), schema)
