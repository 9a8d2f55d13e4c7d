"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
max(``LEAST``, ``TIMES`` * q) words that cannot be made longer. At scale b = 8, 16, 32, ...
every text is cut into blocks of b words. A run with b <= q < 2b (at the first scale, q < 16)
holds a whole block within its first 2b - 1 words, and that block stands again q words later,
still inside the run. So for each block the sum of squared differences between it and the
words d further on is taken for all distances of the scale at once, by convolution in a
number-theoretic transform. Word numbers are dense within a text and the primes' product
exceeds any sum, so a sum is zero exactly where the block occurs. Each such distance seeds an
extension to both sides, word by word, which gives the run.

Blocks are passed over only where no run can be missed: a block with a word that does not
stand again within 2b - 1 words has no occurrence, and an occurrence inside a run of a period
q0 <= b already found belongs to that run (two runs of different smallest periods q and q0
overlap by fewer than q + q0 words).

Every text is taken whole in one task, in slices of about ``SLICE`` bytes of whole rows.
Nulls: a null text has no words; a null doc_id is kept, and its words stay as they are where
``planted`` asks for repeats. Empty texts and tables give no run. Repeated rows give equal
results. Ties between runs go to the smaller start, then the smaller period. Other columns
are not read. A text of more than 2**27 words raises an error.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, batches_of_rows, split_spans, text_buffer

LEAST, TIMES, FIRST_BLOCK, SLICE = 24, 3, 8, 1 << 19
#: (prime, a generator of its multiplicative group); all allow transforms of up to 2**25 points.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
POINTS = 1 << 18  # transformed at once
U = np.uint64
RUN = "array<struct<start:long,length:long,period:long>>"


class Transform:
    """Number-theoretic transform of the rows of a matrix, n points modulo a prime. Forward
    results are in bit-reversed order, which the inverse takes."""

    def __init__(self, n: int, prime: int, generator: int):
        if (prime - 1) % n:
            raise ValueError("a text has too many words for the transform")
        self.n, self.p = n, U(prime)
        root = pow(generator, (prime - 1) // n, prime)
        self.down, self.up = self._powers(root, prime), self._powers(pow(root, prime - 2, prime), prime)
        self.scale = U(pow(n, prime - 2, prime))

    def _powers(self, root: int, prime: int) -> np.ndarray:
        out = np.ones(max(1, self.n // 2), U)
        done = 1
        while done < len(out):
            out[done:2 * done] = out[:done] * U(pow(root, done, prime)) % U(prime)
            done *= 2
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        half = self.n // 2
        while half:
            v = x.reshape(len(x), -1, 2, half)
            a, b = v[:, :, 0], v[:, :, 1]
            y = np.empty_like(v)
            y[:, :, 0] = (a + b) % self.p
            y[:, :, 1] = (a + (self.p - b)) * self.down[::self.n // (2 * half)] % self.p
            x, half = y.reshape(len(x), self.n), half // 2
        return x

    def inverse(self, x: np.ndarray) -> np.ndarray:
        half = 1
        while half < self.n:
            v = x.reshape(len(x), -1, 2, half)
            a, b = v[:, :, 0], v[:, :, 1] * self.up[::self.n // (2 * half)] % self.p
            y = np.empty_like(v)
            y[:, :, 0] = (a + b) % self.p
            y[:, :, 1] = (a + (self.p - b)) % self.p
            x, half = y.reshape(len(x), self.n), half * 2
        return x * self.scale % self.p


_TRANSFORMS: dict[tuple[int, int], Transform] = {}


def _transform(n: int, which: int) -> Transform:
    if (n, which) not in _TRANSFORMS:
        _TRANSFORMS[n, which] = Transform(n, *PRIMES[which])
    return _TRANSFORMS[n, which]


def zero_mismatch(block: np.ndarray, window: np.ndarray, most: int) -> np.ndarray:
    """[i, k] tells whether the sum of (block[i] - window[i, k:k + b])**2 is zero; all values lie
    in 0..``most``. Modulo enough primes for any possible sum, so the answer is exact."""
    b, lags = block.shape[1], window.shape[1] - block.shape[1] + 1
    n = 1 << (window.shape[1] + b - 2).bit_length()
    bound, zero = b * most * most, np.ones((len(block), lags), bool)
    for which, (prime, _) in enumerate(PRIMES):
        p, t = U(prime), _transform(n, which)
        x, y = np.zeros((len(block), n), U), np.zeros((len(block), n), U)
        x[:, :b], y[:, :window.shape[1]] = block[:, ::-1], window
        x %= p
        y %= p
        cross = t.inverse(t.forward(x) * t.forward(y) % p)[:, b - 1:b - 1 + lags]
        own = np.cumsum(np.concatenate([np.zeros((len(block), 1), U), y[:, :window.shape[1]] * y[:, :window.shape[1]] % p], 1), 1)
        total = (x * x % p).sum(1)[:, None] + (own[:, b:] - own[:, :-b]) + U(2) * (p - cross)
        zero &= total % p == 0
        bound //= prime
        if not bound:
            return zero
    raise ValueError("a text has too many words for the transform")


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def planted(at: np.ndarray, ids: list) -> np.ndarray:
    """For the words of rows with offsets ``at``: the place of the word each one becomes. Of the
    rows whose id's checksum h ends in 0, the words from a on repeat with period p."""
    source = np.arange(at[-1], dtype=np.int64)
    for i, doc in enumerate(ids):
        n = int(at[i + 1] - at[i])
        if doc is None or not n:
            continue
        g, last = divmod(zlib.crc32(str(doc).encode()), 10)
        if last == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[at[i] + a:at[i + 1]] = at[i] + a + np.arange(n - a) % p
    return source


def _dense(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers dense from 0 within each row, distance to the next equal word of the row)."""
    n = len(x)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    order = np.argsort(row * (int(x.max()) + 1) + x, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    number = np.cumsum(new) - 1
    base = number[np.minimum(at[:-1], n - 1)]
    out, gap = np.empty(n, np.int64), np.full(n, n + 1, np.int64)
    out[order] = number - base[row[order]]
    again = ~new[1:]
    gap[order[:-1][again]] = order[1:][again] - order[:-1][again]
    return out, gap


def _extend(x: np.ndarray, d: int, seeds: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, end) around the seeds where words d apart are equal; the end counts the
    later word."""
    differ = np.concatenate([[-1], np.flatnonzero(x[:-d] != x[d:]), [len(x) - d]])
    k = np.unique(np.searchsorted(differ, seeds))
    return list(zip((differ[k - 1] + 1).tolist(), (differ[k] + d).tolist()))


def find_runs(x: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by row, of the rows of word numbers x[at[i]:at[i + 1]]."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sizes = np.diff(at)
    if not len(sizes) or sizes.max() < LEAST:
        return runs
    x, gap = _dense(x, at)
    most = int(x.max()) + 1  # stands behind a row's end and equals no word
    b = FIRST_BLOCK
    while TIMES * b <= sizes.max():
        low = 1 if b == FIRST_BLOCK else b
        rows = np.flatnonzero(sizes >= max(LEAST, TIMES * b))
        count = sizes[rows] // b
        row = np.repeat(rows, count)
        first = np.arange(len(row), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
        pos = at[row] + first * b
        edges = np.stack([pos, pos + b], 1).reshape(-1)
        widest = np.maximum.reduceat(np.append(gap, 0), edges)[::2]
        alive = widest < 2 * b
        row, pos = row[alive], pos[alive]
        if len(row):
            inside = _reach(runs, row, pos, at, b)
            open_ = pos + 3 * b - 1 > inside
            row, pos, inside = row[open_], pos[open_], inside[open_]
        for r, group in _seeds(x, at, row, pos, inside if len(row) else None, b, low, most):
            _grow(x[at[r]:at[r + 1]], group, runs.setdefault(r, []), b)
        b *= 2
    return {r: sorted(found, key=lambda t: (t[0], t[2])) for r, found in runs.items() if found}


def _reach(runs, row, pos, at, b):
    """The furthest end of a run with a period of at most b that holds the whole block."""
    out = np.full(len(row), -1, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for i, j in zip(cut, np.append(cut[1:], len(row))):
        for start, length, period in runs.get(int(row[i]), ()):
            s = at[row[i]] + start
            if period <= b:
                part = out[i:j]
                held = (pos[i:j] >= s) & (pos[i:j] + b <= s + length)
                part[held] = np.maximum(part[held], s + length)
    return out


def _seeds(x, at, row, pos, inside, b, low, most):
    """(row, [(distance, block starts within the row)]) of the occurrences of the blocks."""
    lags = np.arange(2 * b - low)
    width = 3 * b - 1 - low
    step = max(1, POINTS // (4 * b))
    rows, places, dist = [], [], []
    for i in range(0, len(row), step):
        p, end = pos[i:i + step, None], at[row[i:i + step] + 1][:, None]
        w = p + low + np.arange(width)
        window = np.where(w < end, x[np.minimum(w, len(x) - 1)], most)
        hit = zero_mismatch(x[p + np.arange(b)].astype(U), window.astype(U), most)
        hit &= p + low + lags + b > inside[i:i + step, None]  # the rest lies in a run already found
        k, d = np.nonzero(hit)
        rows.append(row[i:i + step][k])
        places.append(pos[i:i + step][k])
        dist.append(d + low)
    if not rows:
        return
    rows, places, dist = (np.concatenate(v) for v in (rows, places, dist))
    order = np.lexsort((places, dist, rows))
    rows, places, dist = rows[order], places[order], dist[order]
    cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (dist[1:] != dist[:-1])])) if len(rows) else []
    groups: dict[int, list] = {}
    for i, j in zip(cut, np.append(cut[1:], len(rows)) if len(rows) else []):
        groups.setdefault(int(rows[i]), []).append((int(dist[i]), places[i:j] - at[rows[i]]))
    yield from groups.items()


def _grow(x: np.ndarray, group, found: list, b: int) -> None:
    """Extend the seeds of one text, distances ascending, and add the runs to ``found``."""
    for d, seeds in group:
        for start, length, period in found:
            if period < d and period <= b:  # a block and its image inside that run
                seeds = seeds[(seeds < start) | (seeds + d + b > start + length)]
        if not len(seeds):
            continue
        for s, e in _extend(x, d, seeds):
            if e - s >= max(LEAST, TIMES * d) and not any(q <= d and u <= s and u + n >= e for u, n, q in found):
                found.append((s, e - s, d))


def _kept(size: int, runs) -> np.ndarray:
    """Words that no run holds after its first period."""
    keep = np.ones(size, bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return keep


def _best(runs):
    best = None
    for s, n, q in runs:  # by start, then period
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def _rows(batch, plant: bool):
    """(row, words as bytes after planting, runs) of a batch."""
    data, off = text_buffer(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for a, z in batches_of_rows(off, SLICE):
        body = data[off[a]:off[z]]
        start, end, at = split_spans((~IS_SPACE[body]).astype(np.uint8), off[a:z + 1] - off[a])
        source = planted(at, ids[a:z]) if plant else np.arange(len(start))
        runs = find_runs(word_numbers(body, start, end)[source], at) if len(start) else {}
        raw = body.tobytes()
        for i in range(a, z):
            j, k = at[i - a], at[i - a + 1]
            words = raw[off[i] - off[a]:off[i + 1] - off[a]].split()  # bytes split at just these controls
            if plant:
                moved = source[j:k] - j
                changed = np.flatnonzero(moved != np.arange(k - j))
                if len(changed):
                    words[changed[0]:] = [words[m] for m in moved[changed[0]:]]
            yield i, words, runs.get(i - a, [])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): all runs by start, then period, and the words that no run
    holds after its first period, joined by one space. ``plant`` first repeats words of some
    rows (see ``planted``)."""

    def run(batches):
        for batch in batches:
            runs, text = [], []
            for _, words, found in _rows(batch, plant):
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                text.append(_collapse(words, found).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(text, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    return _read(docs).mapInArrow(run, f"doc_id long, runs {RUN}, collapsed string")


def _collapse(words: list[bytes], runs) -> bytes:
    if runs:
        words = [words[i] for i in np.flatnonzero(_kept(len(words), runs))]
    return b" ".join(words)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def run_digest(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the run with the greatest exact length / period (start, length,
    period, exponent_milli; null without a run) and digests of all runs and of the collapsed text."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names[1:]]
            for _, words, found in _rows(batch, plant):
                best = _best(found)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                row = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                       hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapse(words, found)).hexdigest())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return _read(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                       "runs_sha256 string, collapsed_sha256 string")
