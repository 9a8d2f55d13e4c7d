"""Substring dedup (recompression) and suffix-array dedup (prefix doubling)."""
import numpy as np
import pytest
from brute import byte_spans, corpus, hard_rows, passages
from llm_helpers import frame, rows_of  # noqa: F401
from parley.llm import prefix_doubling, recompression, repeats
from parley.llm.common import Rolling, sliding_min


def test_rolling_and_sliding_min():
    rnd = np.random.default_rng(1)
    u = rnd.integers(0, 3, 500).astype(np.uint64)
    r = Rolling(u, 50)
    for n in (1, 7, 20, 35, 50):
        names = {}
        got = r.everywhere(n)
        for i in range(500 - n + 1):
            assert names.setdefault(u[i:i + n].tobytes(), got[i]) == got[i]
        assert len(set(names.values())) == len(names)
        assert (r.at(np.arange(500 - n + 1), n) == got[:500 - n + 1]).all()
        m = sliding_min(u, n)
        assert all(m[i] == u[i:i + n].min() for i in range(500 - n + 1))


def test_equal_substrings_share_interior_symbols():
    rnd = np.random.default_rng(2)
    body = rnd.integers(1, 2**60, 300).astype(np.uint64)
    found = []
    for k in range(2):
        u = np.concatenate([rnd.integers(1, 2**60, 50 + k).astype(np.uint64), body, rnd.integers(1, 2**60, 40).astype(np.uint64)])
        name, lo, hi = recompression.recompress(u, np.zeros(len(u), np.int32), 3)
        inside = (lo >= 50 + k) & (hi <= 350 + k)
        found.append(set(zip(name[inside].tolist(), (lo[inside] - 50 - k).tolist())))
    assert found[0] == found[1] and len(found[0]) > 80


@pytest.mark.parametrize("rows", [corpus(1), corpus(2, 40, 8), hard_rows()], ids=["mixed", "few words", "hard"])
def test_against_brute_force(frame, rows):
    for chunk in (1 << 11, 16 << 20):
        got = recompression.repeated_passages(frame(rows), digest=True, chunk_bytes=chunk)
        assert rows_of(got) == sorted(passages(rows), key=repr)
        got = prefix_doubling.repeated_spans(frame(rows), digest=True, chunk_bytes=chunk)
        assert rows_of(got) == sorted(byte_spans(rows), key=repr)


def test_spans_and_small_windows(frame):
    rows = corpus(3, 30)
    for r in recompression.repeated_passages(frame(rows), window=6, context=5, rounds=1).collect():
        for s in r["spans"]:
            assert s["hi"] - s["lo"] >= 6 and s["hi"] <= len((r["text"] or "").split())
    got = prefix_doubling.repeated_spans(frame(rows), threshold=12, first=5, digest=True)
    assert rows_of(got) == sorted(byte_spans(rows, 12), key=repr)
    got = recompression.repeated_passages(frame(rows), window=6, context=5, rounds=1, digest=True)
    assert rows_of(got) == sorted(passages(rows, 6), key=repr)


def test_hot_key_dealt_by_run(frame, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", 3)
    common = " ".join(f"c{k}" for k in range(45))
    rows = [(i, f"start{i} and {i * i} " + common + f" {i} ends in {i}") for i in range(40)] + [(99, common)]
    got = recompression.repeated_passages(frame(rows), digest=True, chunk_bytes=1 << 11)
    assert rows_of(got) == sorted(passages(rows), key=repr)
    got = prefix_doubling.repeated_spans(frame(rows), digest=True, chunk_bytes=1 << 11)
    assert rows_of(got) == sorted(byte_spans(rows), key=repr)


def test_empty_table(frame, spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert recompression.repeated_passages(empty, digest=True).count() == 0
    assert prefix_doubling.repeated_spans(empty).count() == 0
