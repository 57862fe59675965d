"""Repair of conversations against an exhaustive search, whatever the size of chunks, and awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from abstain_eval.llm import conversations, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, chunk long, state long, place long"


def cheapest(rows):
    """(cost, edits, messages) by trying all edits, the least edits in ASCII order first."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state, inserted):
        if i == n and state in "Na" and not inserted:
            options = [(0, "", ())]
        else:
            options = []
        made = {"N": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if inserted < 2:
            cost, edits, rest = best(i, made[0], inserted + 1)
            options.append((cost + 2, "I" + edits, ((made, ""), *rest)))
        if i < n:
            role, text, fault = rows[i]
            cost, edits, rest = best(i + 1, state, 0)
            options.append((cost + 3, "D" + edits, rest))
            if fault not in "bd":
                more = fault == "t"
                if role[:1] in {"N": "su", "s": "u", "u": "a", "a": "u"}[state] and role[:1]:
                    cost, edits, rest = best(i + 1, role[:1], 0)
                    options.append((cost + more, "K" + edits, ((role, text), *rest)))
                cost, edits, rest = best(i + 1, made[0], 0)
                options.append((cost + 2 + more, "R" + edits, ((made, text), *rest)))
        if i == n and state in "Na":
            options.append((0, "", ()))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, "N", 0)


def account(rows):
    """The columns of the result of one conversation's rows (turn, role, text) in order."""
    seen, found = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not last else "d" if (role, text) in seen else "." if last[-1] in ".!?" else "t"
        seen.add((role, text))
        found.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, edits, messages = cheapest(found)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
    return gaps, *(sum(f == x for _, _, f in found) for x in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest


def in_turns(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def brute(rows, damaged):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20 if damaged else 19
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(((c, *account(in_turns(r))) for c, r in by.items()), key=str)


def repaired(df, damaged=False):
    found = conversations.repaired(*conversations.damage(df)) if damaged else conversations.repaired(df)
    return sorted((tuple(r) for r in found.collect()), key=str)


def given(sf_dir):
    return duckdb.sql(f"select conv_id, turn, role, text from '{sf_dir}/conversations.parquet'").fetchall()


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_given_conversations(spark, sf_dir):
    found = sorted((tuple(r) for r in queries.op11_conversations(spark, sf_dir).collect()), key=str)
    assert found == brute(given(sf_dir), True)


def random_rows(draw, n, conversations_, roles):
    texts = ["Yes.", "No!", "Well", "", " \n", "Why?", "a. b"]
    return [
        (int(draw.integers(conversations_)), i, roles[draw.integers(len(roles))], texts[draw.integers(len(texts))] if draw.random() < 0.4 else f"Text {i}" + ".?"[i % 2] * (draw.random() < 0.8))
        for i in range(n)
    ]


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunks_of_any_size(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = random_rows(np.random.default_rng(chunk), 160, 6, ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown"])
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)
    assert repaired(frame) == brute(rows, False)
    assert repaired(frame, True) == brute(rows, True)


def test_auction_and_trace_against_all_edits():
    draw = np.random.default_rng(9)
    for _ in range(400):
        n = int(draw.integers(0, 9))
        initials = ["suax"[i] for i in draw.integers(0, 4, n)]
        faults = "".join("bdt...."[i] for i in draw.integers(0, 7, n))
        lattice = conversations.Lattice(initials, faults, conversations.ENDS)
        cost = lattice.auction(conversations.NOTHING)
        edits, state = lattice.trace(conversations.NOTHING)
        want = cheapest([(i, "", f) for i, f in zip(initials, faults, strict=True)])
        assert (cost, edits + conversations.endings(state)) == want[:2]


def test_awkward_rows(spark):
    long = "word " * 200_000
    rows = [
        (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 0, None, None), (1, 5, "assistant", long), (2, None, None, None), (2, None, "", ""),
        (None, 1, "system", "Be kind."), (None, 2, "user", "So?"), (None, 2, "assistant", "So!"), (3, 7, "assistant", "日本。"), (4, -2, "user", "İß!"), (4, 9, "user", "İß!"),
    ]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)
    assert repaired(frame) == brute(rows, False)
    assert repaired(frame, True) == brute(rows, True)
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty) == repaired(empty, True) == []


def test_messages_and_conversations_without_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (2, 0, "user", "Hi.")]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)
    found = conversations.messages(frame).orderBy("conv_id", "chunk", "place").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in found] == [(1, "user", "Hi."), (1, "assistant", "Hm."), (2, "user", "Hi."), (2, "assistant", "")]
    gone = conversations.repaired(frame, F.when(F.col("conv_id") == 1, 0).otherwise(1)).filter("conv_id = 1").collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_over_many_ranges(spark):
    """Equal rows, too, are cut into several chunks, and only the first one counts as no duplicate."""
    rows = [(7, 0, "user", "Hi.")] * 300 + [(7, 1, "assistant", "Yes.")] * 2
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)
    assert repaired(frame) == brute(rows, False)
    assert conversations.chunked(frame, F.lit(1)).count() > 4
