"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters and digits, lower case). Numbers, names (capitalised
inside a sentence) and units of measure become typed placeholders; digits joined by a point or
comma are one number, names with one space between them one name. Windows of ``WINDOW``
template tokens of the benchmark are joined by hash with those of every document; along each
alignment of a document with an item, the slots of the matching windows are compared: the
item's slot values must map to the document's as a function, type by type, so "Ann has 3 ...
Ann" matches "Bo has 5 ... Bo" but not "Bo has 5 ... Cy". A document that holds a consistent
window is contaminated, whether the slots are unchanged or given other values; it
is reparameterised if any window along an alignment has other values. Template windows need
``LITERAL`` tokens that are not placeholders. An item shorter than the window takes its whole
length and needs ``FEW`` of them, as does an item of which no window has ``LITERAL``; with
fewer, other values in it are not told from any other numbers. Beside them every item has literal windows, the lower-case tokens
without placeholders and without a minimum, so text copied word for word is found whatever
is typed as a name or number in it. Items of fewer than ``SHORT`` tokens flag nothing.

The benchmark side goes to the tasks in blocks of at most ``BLOCK_TOKENS`` tokens, one pass
over the documents each, so what is broadcast does not grow with the benchmark.

Nulls: a null text has no token, items with a null id are named by null. Repeated rows and
items match like any other. Empty tables of documents or items give no row. A text of any
length is read whole, in one task. Other columns are not read by ``leaks`` and kept by ``clean``.
"""
from __future__ import annotations

import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, TO_LOWER, U, Rolling, batches_of_rows, mix64, split_spans, text_buffer, word_names
from .importance import KIND

WINDOW, LITERAL, FEW, SHORT, BLOCK_TOKENS = 10, 5, 3, 3, 1_000_000
NUMBER, NAME, UNIT = 1, 2, 3
#: Units of measure, currency and time.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms
ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute
minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd
eur percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres""".split()


def _names_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return np.sort(word_names(data, np.concatenate([[0], end[:-1]]), end))


UNIT_NAMES = _names_of(UNITS)
#: Upper and title case, by code point.
UPPER = np.array([unicodedata.category(chr(c)) in ("Lu", "Lt") for c in range(1 << 17)])


def _capital(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character at each ``start`` is a capital letter."""
    b = [data[np.minimum(start + i, len(data) - 1)].astype(np.int64) for i in range(4)]
    low = [x & 63 for x in b]
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
                      [b[0], (b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]],
                      (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])
    return UPPER[np.minimum(point, len(UPPER) - 1)]


def canonical(data: np.ndarray, off: np.ndarray):
    """(literal names, row offsets) of the tokens of each row as they stand, then (literal
    names, types, template names, row offsets) with numbers and names of several tokens made
    one."""
    start, end, at = split_spans(KIND[data] == 1, off)
    literal = word_names(TO_LOWER[data], start, end)
    kind = np.zeros(len(start), np.int8)
    if not len(start):
        return (literal, at), (literal, kind, literal, at)
    digit = (data >= 48) & (data <= 57)
    digits = np.concatenate([[0], np.cumsum(digit)])
    number = digits[end] > digits[start]
    # the last byte before the token that is not a space, if any, in the same row
    solid = np.where(IS_SPACE[data], -1, np.arange(len(data)))
    before = np.concatenate([[-1], np.maximum.accumulate(solid)])[start]
    row = np.repeat(off[:-1], np.diff(at))
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    opens = (before < row) | np.isin(data[np.maximum(before, 0)], [33, 46, 58, 63]) | (newline[start] > newline[np.maximum(before, 0)])
    spot = np.minimum(np.searchsorted(UNIT_NAMES, literal), len(UNIT_NAMES) - 1)
    kind[_capital(data, start) & ~opens] = NAME
    kind[UNIT_NAMES[spot] == literal] = UNIT
    kind[number] = NUMBER

    # a token goes on with the one before it, one byte away in the same row
    near = (start[1:] == end[:-1] + 1) & (row[1:] == row[:-1])
    gap, both = data[np.minimum(end[:-1], len(data) - 1)], kind[1:] == kind[:-1]
    joined = near & both & (((kind[1:] == NUMBER) & ((gap == 44) | (gap == 46)) & digit[start[1:]] & digit[end[:-1] - 1])
                            | ((kind[1:] == NAME) & (gap == 32)))
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    many = np.flatnonzero(last > first)
    one = literal[first]
    if len(many):
        one[many] = word_names(TO_LOWER[data], start[first[many]], end[last[many]])
    kind = kind[first]
    return (literal, at), (one, kind, np.where(kind > 0, mix64(kind.astype(U)), one), np.searchsorted(first, at))


def _windows(tokens, kind, at, length, least):
    """(row, first token, name) of all windows of ``length`` tokens, ``least`` of them literal."""
    count = np.diff(at)
    per = np.maximum(0, count - length + 1)
    first = np.repeat(at[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    row = np.repeat(np.arange(len(count)), per)
    if least:
        plain = np.concatenate([[0], np.cumsum(kind == 0)])
        good = plain[first + length] - plain[first] >= least
        first, row = first[good], row[good]
    return row, first, Rolling(tokens, length).at(first, length) if len(first) else np.zeros(0, U)


def _sorted(length: int, row, first, name) -> dict:
    o = np.argsort(name, kind="stable")
    return {length: (name[o], row[o], first[o])} if len(o) else {}


def make_block(items: list, texts: list[str]) -> SimpleNamespace:
    """Literal and template windows of some benchmark items, by length and sorted by name."""
    data = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    (plain, plain_at), (literal, kind, template, at) = canonical(data, off)
    by_length, exact = {}, {}
    for n in range(SHORT, WINDOW + 1):
        for windows, tokens, ends, least in ((by_length, template, at, FEW), (exact, plain, plain_at, 0)):
            row, first, name = _windows(tokens, kind, ends, n, least)
            size = np.diff(ends)[row]
            pick = size == n if n < WINDOW else size >= n
            if n == WINDOW and least:  # few literal tokens will do for an item that has no better window
                solid = np.concatenate([[0], np.cumsum(kind == 0)])
                good = solid[first + n] - solid[first] >= LITERAL
                pick &= good | (np.bincount(row[good], minlength=len(texts))[row] == 0)
            windows |= _sorted(n, row[pick], first[pick], name[pick])
    return SimpleNamespace(items=items, literal=literal, by_length=by_length, exact=exact)


def _aligned(windows: dict, tokens, kind, at, least: int) -> list[np.ndarray]:
    """(row, item index, shift, first token, length) of the windows found, by length."""
    found = []
    for n, (name, item, pos) in windows.items():
        row, first, mine = _windows(tokens, kind, at, n, least)
        lo, hi = np.searchsorted(name, mine, "left"), np.searchsorted(name, mine, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        many = (hi - lo)[hit]
        k = np.repeat(hit, many)
        b = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
        # one alignment: the same row, item and shift
        found.append(np.stack([row[k], item[b], first[k] - pos[b], first[k], np.full(len(k), n)], axis=1))
    return found


def hits(block: SimpleNamespace, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(row, item index, windows, slots changed) of rows that hold a consistent window."""
    (plain, plain_at), (literal, kind, template, at) = canonical(data, off)
    out: dict[tuple[int, int], list] = {}
    for align in _aligned(block.exact, plain, kind, plain_at, 0):
        for row, item in align[:, :2].tolist():
            out.setdefault((row, item), [0, False])[0] += 1
    for align in _aligned(block.by_length, template, kind, at, FEW):
        for row, item, shift, first, n in align.tolist():
            slots = [t for t in range(first, first + n) if kind[t]]
            pairs = {(int(kind[t]), int(block.literal[t - shift]), int(literal[t])) for t in slots}
            # with no slot changed it is word for word the item's, and counted above
            if len({p[:2] for p in pairs}) == len(pairs) and any(a != b for _, a, b in pairs):
                entry = out.setdefault((row, item), [0, False])
                entry[0] += 1
                entry[1] = True
    return [(row, item, n, changed) for (row, item), (n, changed) in out.items()]


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of bounded size, one after the other."""
    items, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        items.append(r["item_id"]), texts.append(r["text"])
        size += len(r["text"]) // 4 + 1
        if size >= BLOCK_TOKENS:
            yield make_block(items, texts)
            items, texts, size = [], [], 0
    yield make_block(items, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, reparameterised): every document that holds a window of
    a benchmark item, with the number of windows and whether its slots have other values."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            block = shared.value
            for batch in batches:
                data, off = text_buffer(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[a + r], block.items[i], n, c) for a, b in batches_of_rows(off, 1 << 20)
                         for r, i, n, c in hits(block, data[off[a]:off[b]], off[a:b + 1] - off[a])]
                cols = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                                                 names=["doc_id", "item_id", "n_windows", "reparameterised"])

        one = rows.mapInArrow(find, "doc_id long, item_id long, n_windows long, reparameterised boolean")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            for batch in batches:
                data, off = text_buffer(batch.column(at))
                good = np.ones(batch.num_rows, bool)
                for a, b in batches_of_rows(off, 1 << 20):
                    for r, _, _, _ in hits(shared.value, data[off[a]:off[b]], off[a:b + 1] - off[a]):
                        good[a + r] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
