"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct shingles of five words. One permutation scrambles the
shingles; a second, shifted circularly by 0, 1, 2, ... gives all coordinates of the
signature: coordinate k is the least value of second(first(x) - k) over the set, in a
universe of 2 ** 32. Bands of ``ROWS`` coordinates name the buckets in which documents meet.
A pair at the threshold misses all buckets with a probability of at most ``MISS``, more
similar ones far less; ``shape`` gives the bands for that, 16 at 85 percent and 22 at 80.

Documents with equal sets are one class from the start. Links join into components, and
members of one component need no further check. So each class is checked against one hub
first, the least of those of its buckets. In buckets that still hold several components,
members are then checked against a few neighbours in a random order, in cells of bounded
size, as long as that finds links; last, all members of different components are checked,
block by block of two cells, each pair in the first bucket it shares. A bucket of thousands of
copies costs a few checks each, yet no link between components is lost. Pairs whose sizes rule the threshold out are not checked, nor, after
the first hub, those whose signatures agree in fewer coordinates than ``shape`` says,
which a pair at the threshold does with probability ``PASS_BY`` at most. A check compares the full shingle
sets of both texts, in salted groups of one hub and up to ``GROUP`` members.

Nulls: a null text is empty; documents without words have an empty set and link with
nothing. With fewer than five words the whole sequence is the only shingle. A null doc_id
ranks after all others. Rows are told apart by (doc_id, text); repeated rows are one node and
share its verdict. Other columns are not read by ``near_duplicates`` and kept by
``keep_one``.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import GOLD, IS_SPACE, NULL_ID, TO_LOWER, U, Rolling, batches_of_rows, mix64, release, split_spans, store, text_buffer, word_names

SHINGLE, THRESHOLD = 5, 85  # words; percent of the union that the intersection must reach
ROWS, GROUP = 4, 256
MISS, PASS_BY = 1e-5, 2e-7


def shape(percent: int) -> tuple[int, int]:
    """(bands, coordinates that must agree) for a threshold; the bands are even, as eight
    coordinates share a number."""
    p = percent / 100
    if p >= 1:
        return 2, 2 * ROWS
    bands = 2 * math.ceil(math.log(MISS) / math.log(1 - p ** ROWS) / 2)
    n, agree, below = bands * ROWS, 0, 0.0
    while (below := below + math.comb(n, agree) * p ** agree * (1 - p) ** (n - agree)) <= PASS_BY:
        agree += 1
    return bands, agree


BANDS, AGREE = shape(THRESHOLD)
#: Neighbours looked at per member, members of one cell, rounds at most, and the share of
#: checks (one in RETURN) that must find a link for another round. They order the work only.
LOOK, CELL, MAX_TURNS, RETURN = 8, 512, 6, 50
TASK_ROWS = 1500
SIGNED = "rk long, doc_id long, n long, s1 long, s2 long, bands array<long>, sig array<long>"


def shingles(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(names, row offsets) of all shingles, repeats included."""
    start, end, at = split_spans(~IS_SPACE[data], off)
    name = word_names(TO_LOWER[data], start, end)
    count = np.diff(at)
    rolling = Rolling(name, width)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(at[:-1], per) + np.arange(out_off[-1]) - np.repeat(out_off[:-1], per)
    out = np.zeros(out_off[-1], U)
    full = np.repeat(count >= width, per)
    out[full] = rolling.at(first[full], width)
    for n in range(1, width):
        rows = np.flatnonzero(count == n)
        out[out_off[rows]] = rolling.at(at[rows], n) ^ mix64(np.full(len(rows), n, U))
    return out, out_off


def circulant_minima(x: np.ndarray, start: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (coordinates x rows) of the nonempty rows that begin at ``start``."""
    first = (x >> U(32)).astype(np.uint32)  # names are scrambled already: the first permutation
    out = np.empty((coordinates, len(start)), np.uint32)
    for k in range(coordinates):
        h = first - np.uint32(k)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        out[k] = np.minimum.reduceat(h, start)
    return out


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(rows: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(rk, doc_id, n, s1, s2, bands, sig): set size, two names of the whole set, band names,
    and the low bytes of all coordinates, eight to a number."""

    def sign(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            size = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((2, batch.num_rows), U)
            band = np.zeros((batch.num_rows, bands), U)
            low = np.zeros((batch.num_rows, bands * per_band), np.uint8)
            for a, b in batches_of_rows(off, 1 << 20):
                x, at = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
                some = np.flatnonzero(np.diff(at)) if len(at) > 1 else np.zeros(0, np.int64)
                if not len(some):
                    continue
                for i in some.tolist():
                    s = np.unique(x[at[i]:at[i + 1]])
                    size[a + i] = len(s)
                    sums[0, a + i], sums[1, a + i] = mix64(s ^ GOLD).sum(), mix64(s * GOLD).sum()
                h = circulant_minima(x, at[some], bands * per_band).astype(U)
                low[a + some] = (h & U(255)).astype(np.uint8).T
                for j in range(bands):
                    name = np.full(len(some), j, U)
                    for k in range(j * per_band, (j + 1) * per_band):
                        name = mix64(name * GOLD + h[k])
                    band[a + some, j] = name
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.reshape(-1))
                     for m in (band.view(np.int64), low.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk"), batch.column("doc_id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists],
                names=["rk", "doc_id", "n", "s1", "s2", "bands", "sig"])

    return rows.mapInArrow(sign, SIGNED)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _check(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    asked = pairs.count()
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    member = pairs.join(salts, "a").select(F.col("b").alias("rk"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    hub = salts.select(F.col("a").alias("rk"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    seats = store(member.unionByName(hub), "seats", 2 * asked)
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seats.count() // TASK_ROWS))
    texts = rows.select("rk", "text").join(seats.hint("merge"), "rk").groupBy("rk", "hub", "salt").agg(F.first("text").alias("text"))
    seated = texts.withColumn("g", F.pmod(F.xxhash64("hub", "salt"), F.lit(groups)).cast("int"))

    def check(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hub", "ascending"), ("salt", "ascending")])
        rk, hub, salt = (t.column(c).to_numpy() for c in ("rk", "hub", "salt"))
        data, off = text_buffer(t.column("text"))
        sets = []
        for a, b in batches_of_rows(off, 1 << 20):
            x, at = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
            sets += [np.unique(x[i:j]) for i, j in zip(at[:-1], at[1:])]
        out = ([], [])
        cut = np.flatnonzero((hub[1:] != hub[:-1]) | (salt[1:] != salt[:-1])) + 1 if len(rk) else []
        for i, j in zip([0, *cut], [*cut, len(rk)]):
            own = [k for k in range(i, j) if rk[k] == hub[i]]
            if not own:
                continue
            s = sets[own[0]]
            for k in range(i, j):
                if rk[k] != hub[i]:
                    if _linked(s, sets[k], percent):
                        out[0].append(int(hub[i])), out[1].append(int(rk[k]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return store(seated.groupBy("g").applyInArrow(lambda t: check(t), "a long, b long"), "links", asked, heavy=True)


def _similar_size(x: str, y: str, percent: int):
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def _first_shared(x: str, y: str, band):
    """Whether ``band`` is the first one whose names are the same."""
    return F.array_position(F.zip_with(x, y, lambda a, b: a == b), F.lit(True)) == band + 1


def _agree(x: str, y: str, coordinates: int, agree: int):
    """Whether two signatures agree in enough coordinates: bytes that differ, folded to one
    bit each and counted. Lists are folded step by step: spelled out, the steps for all numbers
    and neighbours are an expression whose plans cost the driver seconds and much memory."""
    def fold(shift, mask):
        return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))

    d = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        d = F.transform(d, fold(shift, mask))
    return F.aggregate(d, F.lit(0), lambda total, v: total + F.bit_count(v)) <= coordinates - agree


def _mates(band, cell, two, part, n, bands, sig, percent, agree):
    """Pairs (i, j) of one block's members that need a check: of different components, of
    similar size and signature, and in the first bucket that both share."""
    out = []
    for i in range(0, len(n), 64):
        r = slice(i, min(len(n), i + 64))
        ok = part[r, None] != part[None]
        ok &= 100 * np.minimum(n[r, None], n[None]) >= percent * np.maximum(n[r, None], n[None])
        # a block of two cells holds the pairs between them, a block of one those inside
        ok &= (cell[r, None] != cell[None]) if two else (cell[r, None] == cell[None])
        ok &= np.arange(len(n))[r, None] < np.arange(len(n))[None]
        x, y = np.nonzero(ok)
        x += i
        good = (sig[x] == sig[y]).sum(axis=1) >= agree
        x, y = x[good], y[good]
        good = (bands[x] == bands[y]).argmax(axis=1) == band
        out.append((x[good], y[good]))
    return [np.concatenate(v) for v in zip(*out)]


def _check_cells(texts: DataFrame, placed: DataFrame, percent: int, members: int) -> DataFrame:
    """Links between all members of one bucket and different components. Buckets are cut into
    cells of about ``CELL`` members; each two cells are a block, whose pairs are found from
    the signatures in one task and travel as one list per member, not as rows."""
    cells = F.ceil(F.col("size") / CELL).cast("int")
    own = placed.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("rk", F.lit(-1)), F.col("cells")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))) \
        .withColumn("block", F.xxhash64("bucket", F.least("cell", "other"), F.greatest("cell", "other"))) \
        .select("block", "band", "cell", (F.col("cell") != F.col("other")).cast("int").alias("two"), "rk", "part", "n", "bands", "sig")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agree = shape(percent)[1]

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("rk", "ascending")])
        col = {c: t.column(c).to_numpy() for c in ("block", "band", "cell", "two", "rk", "part", "n")}
        lists = {c: t.column(c).combine_chunks().flatten().to_numpy().reshape(len(t), -1) for c in ("bands", "sig")}
        low = np.ascontiguousarray(lists["sig"]).view(np.uint8)
        cut = (np.flatnonzero(np.diff(col["block"])) + 1).tolist() if len(t) else []
        out = ([], [], [])
        for i, j in zip([0, *cut], [*cut, len(t)]):
            r = slice(i, j)
            if j - i < 2:
                continue
            x, y = _mates(col["band"][i], col["cell"][r], col["two"][i], col["part"][r], col["n"][r], lists["bands"][r], low[r], percent, agree)
            if not len(x):
                continue
            rk = col["rk"][r]
            for k in np.union1d(x, y).tolist():
                out[0].append(int(col["block"][i])), out[1].append(int(rk[k])), out[2].append(rk[y[x == k]].tobytes())
        return pa.table({"block": pa.array(out[0], pa.int64()), "rk": pa.array(out[1], pa.int64()), "mates": pa.array(out[2], pa.binary())})

    schema = "block long, rk long, mates binary"
    found = dealt.withColumn("g", F.pmod("block", F.lit(8 * parts)).cast("int")).groupBy("g").applyInArrow(lambda t: find(t), schema)
    seats = store(found, "seats", members, heavy=True)
    groups = max(parts, -(-seats.count() // TASK_ROWS))
    seated = texts.select("rk", "text").join(seats.hint("merge"), "rk").groupBy("rk", "block").agg(F.first("text").alias("text"), F.first("mates").alias("mates"))

    def check(t: pa.Table) -> pa.Table:
        rk, block = t.column("rk").to_numpy(), t.column("block").to_numpy()
        data, off = text_buffer(t.column("text"))
        sets: dict = {}
        for a, b in batches_of_rows(off, 1 << 20):
            x, at = shingles(data[off[a]:off[b]], off[a:b + 1] - off[a])
            for i in range(a, b):
                if rk[i] not in sets:  # a member of several blocks
                    sets[rk[i]] = np.unique(x[at[i - a]:at[i - a + 1]])
        out = ([], [])
        for a, mates in zip(rk.tolist(), t.column("mates").to_pylist()):
            for b in np.frombuffer(mates, np.int64).tolist():
                if _linked(sets[a], sets[b], percent):
                    out[0].append(a), out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    seated = seated.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return store(seated.groupBy("g").applyInArrow(lambda t: check(t), "a long, b long"), "links", members, heavy=True)


def _joined(parts: DataFrame | None, links: DataFrame, about: int) -> DataFrame:
    """Components of ``parts`` and ``links`` together, ``about`` so many links."""
    if parts is not None:
        links = links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = connected_components(links, rows=about)
    release(links.sparkSession)
    return out


def _open(seats: DataFrame, parts: DataFrame) -> DataFrame:
    """``seats`` with the component of each member (``part``), in buckets that hold several,
    and the bucket's size."""
    placed = seats.join(parts.select(F.col("node").alias("rk"), F.col("component").alias("part")), "rk", "left").withColumn("part", F.coalesce("part", "rk"))
    several = placed.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y")
    return placed.join(several.select("bucket", "size"), "bucket")


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    """(rk, doc_id, n, component_id, best): best is the row key of the component's first row."""
    rows = _rows(docs)
    bands, agree = shape(percent)
    signed = store(signatures(rows, bands), "signed")
    n = signed.count()
    order = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.col("rk").alias("rk"))
    same = ["n", "s1", "s2"]
    classes = store(signed.filter("n > 0").groupBy(*same).agg(
        F.min(order).alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select(
        *same, F.col("first.rk").alias("rk"), F.col("first.doc").alias("doc"), "bands", "sig"), "classes", n)
    seen = classes.select("rk", "n", F.posexplode("bands").alias("band", "name")).select(
        F.xxhash64("band", "name").alias("bucket"), "band", "rk", "n")
    hubs = seen.groupBy("bucket").agg(F.min(F.struct("rk", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = store(seen.join(hubs.select("bucket", "hub"), "bucket"), "members", 2 * n)
    beside = members.filter((F.col("rk") != F.col("hub.rk")) & _similar_size("n", "hub.n", percent)).select(F.col("hub.rk").alias("a"), F.col("rk").alias("b"))

    # one hub for each class
    pairs = beside.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    parts = _joined(None, _check(rows, store(pairs, "pairs", n), percent), n)

    # buckets that still hold several components, and the texts of their members
    seats = members.select("bucket", "band", "rk", "n")
    placed = _open(seats, parts).join(classes.select("rk", "bands", "sig"), "rk")
    placed = store(placed, "open", n)
    texts = store(rows.join(placed.select("rk").distinct().hint("merge"), "rk", "left_semi"), "texts", n)

    # neighbours in a random order of each bucket's members, while that finds links; a pair is
    # asked for only in the first bucket that both share, as copies share most of theirs
    for turn in range(MAX_TURNS):
        cell = [F.col("bucket"), F.pmod(F.xxhash64("rk", F.lit(2 * turn)), F.ceil(F.col("size") / CELL))]
        near = Window.partitionBy(*cell).orderBy(F.xxhash64("rk", F.lit(2 * turn + 1)))
        other = F.struct(F.col("rk").alias("a"), F.col("part").alias("a_part"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig"), F.col("bands").alias("a_bands"))
        looked = placed.select("band", "rk", "part", "n", "sig", "bands", *[F.lag(other, i).over(near).alias(f"o{i}") for i in range(1, LOOK + 1)])
        # tested before they become rows: only pairs that need a check do
        asks = [F.when((F.col("part") != F.col(f"o{i}.a_part")) & _similar_size("n", f"o{i}.a_n", percent)
                       & _first_shared("bands", f"o{i}.a_bands", F.col("band")) & _agree("sig", f"o{i}.a_sig", bands * ROWS, agree),
                       F.struct(F.least(f"o{i}.a", "rk").alias("a"), F.greatest(f"o{i}.a", "rk").alias("b"))) for i in range(1, LOOK + 1)]
        pairs = looked.select(F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull())).alias("p")).select("p.*").distinct()
        pairs = store(pairs, "pairs", n)
        links = _check(texts, pairs, percent)
        asked, found = pairs.count(), links.count()
        if found:
            parts = _joined(parts, links, n)
            placed = store(_open(placed.select("bucket", "band", "rk", "n", "bands", "sig"), parts), "open", n)
        if found * RETURN <= asked:
            break

    parts = _joined(parts, _check_cells(texts, placed, percent, n), n)

    named = classes.select(*same, "rk", "doc").join(parts.withColumnRenamed("node", "rk"), "rk", "left").withColumn("part", F.coalesce("component", "rk"))
    first = named.groupBy("part").agg(F.min(F.struct("doc", "rk")).alias("best"))
    named = named.join(first, "part").select(*same, "best")
    out = signed.select("rk", "doc_id", *same).join(named, same, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("best.doc", F.lit(NULL_ID)))
    return out.select("rk", "doc_id", "n", component.alias("component_id"), F.coalesce("best.rk", "rk").alias("best"))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the component is named by its
    smallest doc_id, whose document is kept."""
    g = _groups(docs, percent)
    return g.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rk") == F.col("best")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with all columns."""
    g = _groups(docs, percent)
    key = "_parley_row"
    while key in docs.columns:
        key += "_"
    kept = g.filter(F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rk") == F.col("best"))).select(F.col("rk").alias(key)).distinct()
    return docs.withColumn(key, _row_key()).join(kept.hint("merge"), key, "left_semi").drop(key)
