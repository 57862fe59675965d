"""Repeated windows of words against brute force, SQL and awkward rows."""

import re
from collections import Counter

import numpy as np
import odd
import pytest
from compare import connect, difference

from abstain_eval.llm import queries, substrings

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if seen[tuple(w[at : at + window])] > 1:
                gone[at : at + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept))
    return out


def found(df, **options):
    rows = substrings.without_repeats(df, **options).collect()
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def test_query_agrees_with_sql(spark):
    assert difference(spark, connect(SMALL), queries.op13_substrings, queries.ORACLES["op13_substrings"], SMALL) == ""


@pytest.mark.parametrize("bits", [4, None])
def test_windows_against_brute_force(spark, monkeypatch, bits):
    """Also with a sketch so small that it lets everything through."""
    if bits:
        monkeypatch.setattr(substrings, "sketch_bits", lambda n: bits)
    draw = np.random.default_rng(3)
    shared = [" ".join(f"s{draw.integers(500)}" for _ in range(n)) for n in (34, 35, 36, 60)]
    rows = []
    for i in range(60):
        own = [f"w{draw.integers(60)}" for _ in range(draw.integers(0, 90))]
        cut = int(draw.integers(0, len(own) + 1))
        rows.append((i, "  ".join(own[:cut] + [shared[draw.integers(4)]] * int(draw.integers(0, 3)) + own[cut:])))
    rows += [(100, "a " * 35), (101, "b " * 36), (102, "c d " * 40), (103, rows[0][1]), (104, "a " * 34)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(brute(rows, 35), key=str)
    assert found(spark.createDataFrame(rows, SCHEMA), window=3) == sorted(brute(rows, 3), key=str)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in odd.rows()]
    assert found(odd.documents(spark)) == sorted(brute(rows, 35), key=str)
    assert found(odd.documents(spark, True)) == []


def test_sketch_never_underestimates():
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 5, n)) for n in (0, 34, 35, 80, 400)] + ["x " * 200]
    seen = substrings.Windows(texts, 35)
    counted = Counter(seen.sketch_keys().tolist())
    h1, h2 = seen.hashes(seen.starts)
    windows = Counter(zip(h1.tolist(), h2.tolist(), strict=True))
    for key, least in zip(zip(h1.tolist(), h2.tolist(), strict=True), seen.least.tolist(), strict=True):
        assert counted[least] >= windows[key]
