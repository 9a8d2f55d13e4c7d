"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one vocabulary entry can be its last token: the one that
ends there (found by an automaton that reports all entries ending at each position), that
fits the last token of the prefix before it, and so on back to the start. Two tokens fit if
merging their concatenation keeps them apart, which is read off their merge trees: at each
moment of merging one piece of the left token and one of the right touch the border, and
they must not be a merge of an earlier rank than those that consume them. The stored last
tokens are back-pointers; following them from the end gives the exact ids.

Words come from the tokenizer's own steps: special strings are cut out of the raw text, the
rest is normalised and split. Texts within Latin-1 and Latin Extended-A take an equal path
with plain string functions; others use the tokenizer's normaliser and splitter themselves.

Nulls: a null text is empty and has no token. Repeated rows are encoded alike. Other columns
are not read.
"""
from __future__ import annotations

import gc
import hashlib
import re
import sys
import types
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000  # encodings a worker keeps between batches; beyond it starts anew
IDS = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BEYOND = re.compile("[^\x00-ſ]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others take code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """A word-level BPE model read from a tokenizer file with an end-of-word mark."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        letters = byte_letters()
        self.letters = letters
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)

        def symbols(token: str) -> str | None:
            """One character per byte; the last of a word is shifted by 256."""
            ends = token.endswith(mark) and len(token) > len(mark)
            body = token[:-len(mark)] if ends else token
            try:
                s = [letters[c] for c in body]
            except KeyError:
                return None
            if ends:
                s[-1] += 256
            return "".join(map(chr, s))

        spelled = {t: symbols(t) for t in model["vocab"]}
        id_of = {s: model["vocab"][t] for t, s in spelled.items() if s}
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = spelled.get(a), spelled.get(b)
            if x and y and x + y in id_of:
                rank.setdefault((id_of[x], id_of[y]), (r, id_of[x + y]))
        self.rank = {a << 32 | b: r for (a, b), (r, _) in rank.items()}
        self.right, self.left = {}, {}
        machine = ahocorasick.Automaton()
        for s, i in id_of.items():
            tree = self._tree([id_of[c] for c in s], rank)
            if tree is None:
                continue  # merging its letters gives something else: never a result
            self.right[i], self.left[i] = self._edge(tree, 2), self._edge(tree, 1)
            machine.add_word(s, (i, len(s)))
        machine.make_automaton()
        self.machine = machine
        self.fits: dict[int, bool] = {}
        kinds = {"L": "", "N": ""}
        for c in map(chr, range(0x180)):
            k = unicodedata.category(c)[0]
            if k in kinds:
                kinds[k] += re.escape(c)
        space = "\t-\r \x85\xa0"
        # fixed values: the tokenizer's own word pattern, spelled for the Latin range
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+").findall

    @staticmethod
    def _tree(ids: list[int], rank) -> tuple | None:
        """(id, left, right, rank) of the single token that merging gives, or None."""
        nodes = [(i, None, None, -1) for i in ids]
        while len(nodes) > 1:
            best = min(((rank[p][0], k) for k in range(len(nodes) - 1) if (p := (nodes[k][0], nodes[k + 1][0])) in rank), default=None)
            if best is None:
                return None
            k = best[1]
            r, made = rank[nodes[k][0], nodes[k + 1][0]]
            nodes[k:k + 2] = [(made, nodes[k], nodes[k + 1], r)]
        return nodes[0]

    @staticmethod
    def _edge(tree, side: int) -> list[tuple[int, float]]:
        """Pieces that touch the token's border, each with the rank that consumes it."""
        out, until = [], float("inf")
        while tree is not None:
            out.append((tree[0], until))
            until, tree = tree[3], tree[side]
        return out

    def _fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            rank = self.rank
            known = True
            for x, until_x in self.right[a]:
                for y, until_y in self.left[b]:
                    r = rank.get(x << 32 | y)
                    # of two merges of one rank the left one goes first
                    if r is not None and r < until_x and r <= until_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.fits) < 2_000_000:
                self.fits[key] = known
        return known

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one word, given a character per byte with the last shifted by 256."""
        n = len(s)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits, fit = self.fits, self._fit
        known, done = fits.get, -1
        for end, (token, length) in self.machine.iter(s):
            if end == done:  # this prefix has its last token
                continue
            at = end + 1 - length
            if at:
                ok = known(last[at] << 32 | token)
                if not (fit(last[at], token) if ok is None else ok):
                    continue
            done = end
            last[end + 1], back[end + 1] = token, at
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def encode_word(self, word: str) -> tuple[str, str]:
        """(ids, token strings) of one split word, each joined by a space."""
        raw = word.encode()
        ids = self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
        return " ".join(map(str, ids)), " ".join([self.text[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if text.isascii() or not BEYOND.search(text):
            return self.words(text.lower())
        lib = self.library
        return [bytes(map(self.letters.__getitem__, w)).decode("utf-8", "surrogateescape")
                for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def decode(self, ids) -> str:
        """Token strings joined by a space, which is what a file without decoder asks for."""
        return " ".join([self.text[i] for i in ids])


def _model(path: str):
    """The model and the word cache of this worker process."""
    home = sys.modules.setdefault("_parley_bpe_models", types.ModuleType("_parley_bpe_models"))
    if path not in home.__dict__:
        setattr(home, path, (PrefixBPE(path), ({}, {})))
        gc.collect()
        gc.freeze()  # millions of small cached values need no collecting
    return home.__dict__[path]


def _encoded(model: PrefixBPE, cache: tuple[dict, dict], text: str) -> tuple[str, str]:
    sections = model.cut.split(text) if model.cut and "<" in text else [text]
    ids, said = [], []
    for i, section in enumerate(sections):
        if i % 2:
            ids.append(str(model.special[section])), said.append(section)
            continue
        words = model.split(section)
        if not words:
            continue
        ids_of, said_of = cache
        try:
            one = " ".join(map(ids_of.__getitem__, words))
        except KeyError:
            missing = set(words).difference(ids_of)
            if len(ids_of) + len(missing) > CACHE_WORDS:
                ids_of.clear(), said_of.clear()
                missing = set(words)
            for w in missing:
                ids_of[w], said_of[w] = model.encode_word(w)
            one = " ".join(map(ids_of.__getitem__, words))
        ids.append(one), said.append(" ".join(map(said_of.__getitem__, words)))
    return " ".join(ids), " ".join(said)


def encode_decode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; with ``digest``, counts and hashes of
    both instead. ``path``: the tokenizer file, the same on every executor."""

    def run(batches):
        model, cache = _model(path)
        for batch in batches:
            out = ([], [], [])
            for text in batch.column("text").to_pylist():
                ids, said = _encoded(model, cache, text or "")
                if digest:
                    out[0].append(ids.count(" ") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(said.encode()).hexdigest())
                else:
                    out[0].append([int(x) for x in ids.split()]), out[1].append(said)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())] if digest else [
                pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DIGEST if digest else IDS)
