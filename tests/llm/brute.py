"""Plain single-process versions of the operators, for small fixtures."""
import hashlib
import itertools
import random
import re
from collections import Counter

SPACE = re.compile("[\x20\x09-\x0d]+")
TOP = 2**63 - 1


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    return (text or "").encode().split()


def passages(rows, width=35):
    seen = Counter(tuple(w[s:s + width]) for _, t in rows for w in [words(t)] for s in range(len(w) - width + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s:s + width])] > 1:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def byte_spans(rows, width=50):
    first = {}
    for i, t in rows:
        b, d = (t or "").encode(), TOP if i is None else i
        for s in range(len(b) - width + 1):
            first[b[s:s + width]] = min(first.get(b[s:s + width], TOP), d)
    out = []
    for i, t in rows:
        b, d = (t or "").encode(), TOP if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s:s + width]] < d:
                gone[s:s + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def shingle_set(text, n=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in SPACE.split(t) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), TOP), TOP if i is None else i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), None if c == TOP else c))
    return out


def top_k(rows, k=20, every=20):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        v = [int(x * 64 // 1) for x in v]
        vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return out


def corpus(seed, n=60, vocabulary=40):
    """Documents of common words with copies, near copies, shared passages and odd rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "é", "ing", "a", "日"]) for _ in range(rnd.randint(1, 3)))
    vocab = [word() for _ in range(vocabulary)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rnd.randrange(7)
        if kind == 0 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rnd.choice(rows)[1] or "x").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = text(rnd.randint(0, 30)) + "\n" + rnd.choice(shared) + "\n" + text(rnd.randint(0, 30))
        elif kind == 3:
            t = " ".join([rnd.choice(vocab)] * rnd.randint(30, 90))
        else:
            t = text(rnd.randint(0, 120))
        rows.append((i, t))
    return rows


def hard_rows():
    """Null, empty, tiny, very long, repeated and tied rows."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "x"]) + str(rnd.randrange(400)) for _ in range(30_000))
    para = " ".join(f"w{k}" for k in range(70))
    return [(3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, para), (9, para), (9, para),
            (None, para), (None, None), (10, para.upper()), (11, "Z" * 3000), (12, "Z" * 2500), (13, long), (14, long[5000:]),
            (15, "a b " * 60), (16, "b a " * 25), (9, "other text under a used id " * 9)]
