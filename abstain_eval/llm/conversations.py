"""Repair of the order of roles in conversations, by auction shortest paths.

A conversation should read as an optional system turn and then pairs of a user and an assistant
turn. Edits of its rows span a lattice: a node is a place between rows and what has been kept so
far (nothing, a system turn, a user turn, an assistant turn), and an arc is an edit with an
integer cost: keep, rerole, delete, insert. The auction algorithm finds the cheapest edits: it
holds a price for every node and a path from the origin. The end of the path bids for its
cheapest way on; if that costs more than its price, the price rises to it and the path is
contracted by that node, else the path is extended. Prices start at the least costs of the rows
ahead. When the path arrives, prices are an optimal dual solution, so that every cheapest path
runs along tight arcs (price = cost + price ahead); of these the path with the ASCII-least edits
is traced.

Rows are sorted by conversation and turn into ranges and cut into chunks of up to `CHUNK` rows,
so a conversation of any length is many rows of work. A conversation within one chunk is
repaired there. For longer ones every chunk's costs from each state to each are found by
itself; a pass over these 16 numbers for each chunk hands every chunk the prices behind it, and
a second one the state that it starts from. Only the SHA-256 of a conversation is a stream over
its chunks, since that digest has no other form.

Faults, the first that a row has: blank (nothing but ASCII white space), duplicate (role and
text seen earlier in the conversation), truncated (the last character that isn't white space
ends no sentence). Rows of one turn are ordered by role and then by a digest of the text; null
turns come first. A null role or text is one space. A null conversation is one of its own.
Empty texts are blank, and very long ones make chunks of fewer rows. Repeated rows are
duplicates. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import tasks, written

CHUNK = 64
CHUNK_CHARS = 500_000
RETURNED_ROWS = 500  # rows of a batch that a task hands on
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Which state follows from a state and the initial of a turn.
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What a rerole or an insertion makes in each state.
MADE = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Cost of the insertions that end a conversation in each state.
ENDS = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60  # the cost of what can't be reached


class Lattice:
    """The edits of some rows, given as role initials and faults (b, d, t or .), and what each state costs behind them."""

    def __init__(self, initials: list[str], faults: str, behind: list[int]):
        self.n = len(initials)
        self.goal = 4 * (self.n + 1)
        self.arcs: list[list[tuple[int, int, str]]] = []
        least = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            least[i] = least[i + 1] + (DELETE if faults[i] in "bd" else TRUNCATED if faults[i] == "t" else 0)
        for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            here, ahead, more = 4 * i, 4 * i + 4, TRUNCATED if fault == "t" else 0
            for state in range(4):
                made = FOLLOWS[state][MADE[state][0]]
                out = [(DELETE, ahead + state, "D"), (INSERT, here + made, "I")]
                if fault not in "bd":
                    if initial in FOLLOWS[state]:
                        out.append((more, ahead + FOLLOWS[state][initial], "K"))
                    out.append((REROLE + more, ahead + made, "R"))
                self.arcs.append(out)
        self.arcs += [[(cost, self.goal, "")] if cost < FAR else [] for cost in behind]
        low = min(behind)
        self.prices = [least[i // 4] + low for i in range(self.goal)] + [0]

    def auction(self, state: int) -> int:
        """The least cost from a state before the first row, by extending and contracting a path from there."""
        prices, arcs, goal = self.prices, self.arcs, self.goal
        path = [state]
        while (node := path[-1]) != goal:
            bid, target = FAR, -1
            for cost, ahead, _ in arcs[node]:
                if cost + prices[ahead] < bid:
                    bid, target = cost + prices[ahead], ahead
            if prices[node] < bid:
                prices[node] = bid
                if len(path) > 1:
                    path.pop()
                elif bid == FAR:
                    break
            else:
                path.append(target)
        return prices[state]

    def trace(self, state: int) -> tuple[str, int]:
        """The ASCII-least edits along tight arcs from a state, and the state behind them. Call `auction` first."""
        prices, arcs, goal = self.prices, self.arcs, self.goal
        tight = [[(edit, ahead) for cost, ahead, edit in out if cost + prices[ahead] == prices[node]] for node, out in enumerate(arcs)]
        before: dict[int, list[int]] = {}
        for node, out in enumerate(tight):
            for _, ahead in out:
                before.setdefault(ahead, []).append(node)
        arrives, todo = {goal}, [goal]
        while todo:
            for node in before.get(todo.pop(), ()):
                if node not in arrives:
                    arrives.add(node)
                    todo.append(node)
        node, edits = state, []
        while node < 4 * self.n:
            edit, node = min(way for way in tight[node] if way[1] in arrives)
            edits.append(edit)
        return "".join(edits), node - 4 * self.n


def costs_between(initials: list[str], faults: str) -> list[int]:
    """The least cost from each state before some rows to each state behind them, row by row of a 4 x 4 matrix."""
    system = any(i == "s" and f not in "bd" for i, f in zip(initials, faults, strict=True))
    out = [FAR] * 16
    for to in range(4):
        lattice = Lattice(initials, faults, [0 if s == to else FAR for s in range(4)])
        for state in range(4):
            if not initials:
                out[4 * state + to] = 0 if state == to else FAR
            elif to in (USER, ASSISTANT) or state == to or (to == SYSTEM and state == NOTHING and system):
                out[4 * state + to] = lattice.auction(state)
    return out


def fault_of(text: str) -> str:
    text = text.rstrip(SPACE)
    return "b" if not text else "." if text[-1] in ".!?" else "t"


def edited(roles: list[str], texts: list[str], edits: str, state: int) -> list[tuple[str, str]]:
    """The messages that edits leave of some rows."""
    out, at = [], 0
    for edit in edits:
        if edit == "I":
            role, text = MADE[state], ""
        else:
            role, text = (MADE[state] if edit == "R" else roles[at]), texts[at]
            at += 1
        if edit != "D":
            out.append((role, text))
            state = FOLLOWS[state][role[:1]]
    return out


#: Kinds of columns as Spark and Arrow name them.
LONG, FLAG, TEXT = ("long", pa.int64()), ("boolean", pa.bool_()), ("string", pa.string())
LONGS, TEXTS = ("array<long>", pa.list_(pa.int64())), ("array<string>", pa.list_(pa.string()))
MESSAGES = ("array<struct<role: string, text: string>>", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
Fields = dict[str, tuple[str, pa.DataType]]


def mapped(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[tuple]], fields: Fields) -> DataFrame:
    """`function` over the rows of every partition; it hands on tuples, which go out in batches."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*held, strict=True), fields.values(), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in function(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) >= RETURNED_ROWS:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return df.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items()))


CHUNKS: Fields = {
    "conv_id": LONG, "chunk": LONG, "whole": FLAG, "turns": LONGS, "roles": TEXTS, "texts": TEXTS, "faults": TEXT,
}


def chunked(rows: DataFrame, copies: Column) -> DataFrame:
    """Conversations in chunks, numbered in order; `whole` ones hold all of their conversation.

    Faults are those that show within the chunk. `copies` says how often a row is there; a
    conversation whose rows are all gone is an empty chunk.
    """
    there = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))
    named = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies"),
    ).withColumn("copy", F.explode(there))
    gone = F.col("copy") == 0
    kept = named.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")), gone.alias("gone"))
    # The last key lets equal rows, however many, stand in several ranges.
    keyed = kept.withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "digest", "place"]
    ordered = keyed.repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order)

    def cut(found: Iterator[dict]) -> Iterator[tuple]:
        base = TaskContext.get().partitionId() << 32
        number, conversation, lone = 0, None, False
        turns: list = []
        roles: list[str] = []
        texts: list[str] = []
        chars, opened = 0, False

        def chunk(whole: bool) -> tuple:
            seen, faults = set(), []
            for role, text in zip(roles, texts, strict=True):
                fault = fault_of(text)
                faults.append(fault if fault == "b" else "d" if (role, text) in seen else fault)
                seen.add((role, text))
            return conversation, base + number, whole, turns, roles, texts, "".join(faults)

        for row in found:
            new = opened and row["conv_id"] != conversation
            if opened and (new or len(roles) >= CHUNK or chars >= CHUNK_CHARS):
                yield chunk(new and lone)
                number, turns, roles, texts, chars = number + 1, [], [], [], 0
                lone = new  # the first of a range may have begun in the range before
            conversation, opened = row["conv_id"], True
            if not row["gone"]:
                turns.append(row["turn"])
                roles.append(row["role"])
                texts.append(row["text"])
                chars += len(row["text"])
        if opened:
            yield chunk(False)  # it may go on in the next range

    return mapped(ordered.select("conv_id", "turn", "role", "text", "gone"), cut, CHUNKS)


def conversation_key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conversation")


def in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    """The chunks of every conversation in one partition, in order; a conversation streams through its task."""
    by = F.col("chunk").desc() if descending else F.col("chunk")
    return df.repartition(tasks(df), "conversation").sortWithinPartitions("conversation", by)


def repeats_between(chunks: DataFrame) -> DataFrame:
    """(chunk, again): places of rows that an earlier chunk of their conversation holds."""

    def named(found: Iterator[dict]) -> Iterator[tuple]:
        for row in found:
            for at, (role, text, fault) in enumerate(zip(row["roles"], row["texts"], row["faults"], strict=True)):
                if fault not in "bd":
                    digest = xxhash.xxh128_digest(f"{len(role)}:{role}{text}".encode())
                    yield row["conversation"], row["chunk"], at, *(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))

    fields = {"conversation": TEXT, "chunk": LONG, "at": LONG, "d1": LONG, "d2": LONG}
    rows = mapped(chunks.select(conversation_key(), "chunk", "roles", "texts", "faults"), named, fields)
    keys = ["conversation", "d1", "d2"]
    first = rows.groupBy(*keys).agg(F.min("chunk").alias("first"))
    return rows.join(first, keys).filter("chunk > first").groupBy("chunk").agg(F.collect_list("at").alias("again"))


def with_repeats(row: dict) -> str:
    faults = list(row["faults"])
    for at in row["again"] or ():
        faults[at] = "d"
    return "".join(faults)


def solved(initials: list[str], faults: str, behind: list[int], state: int) -> tuple[str, int]:
    lattice = Lattice(initials, faults, behind)
    lattice.auction(state)
    return lattice.trace(state)


def endings(state: int) -> str:
    """The insertions that end a conversation in a state."""
    return "I" * (ENDS[state] // INSERT)


def plans_of_long(chunks: DataFrame, again: DataFrame) -> DataFrame:
    """(chunk, state, edits) of conversations of several chunks."""
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")
    narrow = written(chunks.select(conversation_key(), "chunk", initials, "faults").join(again, "chunk", "left"), "faults")

    def between(found: Iterator[dict]) -> Iterator[tuple]:
        for row in found:
            yield row["conversation"], row["chunk"], costs_between(row["initials"], with_repeats(row))

    costs = mapped(narrow, between, {"conversation": TEXT, "chunk": LONG, "costs": LONGS})

    def backward(found: Iterator[dict]) -> Iterator[tuple]:
        """Prices behind every chunk, from the last one on."""
        conversation, behind = None, ENDS
        for row in found:
            last = row["conversation"] != conversation
            if last:
                conversation, behind = row["conversation"], ENDS
            yield row["chunk"], behind, last
            behind = [min(row["costs"][4 * a + b] + behind[b] for b in range(4)) for a in range(4)]

    behind = mapped(in_order(costs, True), backward, {"chunk": LONG, "behind": LONGS, "last": FLAG})

    def ways(found: Iterator[dict]) -> Iterator[tuple]:
        """The edits from each state that a chunk can start from, and the state behind them."""
        for row in found:
            faults = with_repeats(row)
            traced = [solved(row["initials"], faults, row["behind"], state) for state in range(4)]
            edits = [e + endings(to) if row["last"] else e for e, to in traced]
            yield row["conversation"], row["chunk"], edits, [to for _, to in traced]

    fields = {"conversation": TEXT, "chunk": LONG, "ways": TEXTS, "to": LONGS}
    traced = mapped(narrow.join(written(behind, "behind"), "chunk"), ways, fields)

    def forward(found: Iterator[dict]) -> Iterator[tuple]:
        conversation, state = None, NOTHING
        for row in found:
            if row["conversation"] != conversation:
                conversation, state = row["conversation"], NOTHING
            yield row["chunk"], state, row["ways"][state]
            state = row["to"][state]

    return mapped(in_order(traced), forward, {"chunk": LONG, "state": LONG, "edits": TEXT})


PIECES: Fields = {
    "conv_id": LONG, "chunk": LONG, "whole": FLAG, "turns": LONGS, "roles": TEXTS, "faults": TEXT, "edits": TEXT, "messages": MESSAGES,
}


def pieces(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Repaired chunks: the turns, roles and faults that were found, the edits, and the messages they leave.

    `rows` has conv_id, turn, role and text, and what `copies` needs; that says how often a row
    counts, and 0 leaves only its conversation.
    """
    chunks = written(chunked(rows, F.lit(1) if copies is None else copies), "chunks")

    def piece(row: dict, faults: str, edits: str, state: int) -> tuple:
        messages = [{"role": r, "text": t} for r, t in edited(row["roles"], row["texts"], edits, state)]
        return row["conv_id"], row["chunk"], row["whole"], row["turns"], row["roles"], faults, edits, messages

    def alone(found: Iterator[dict]) -> Iterator[tuple]:
        for row in found:
            edits, state = solved([r[:1] for r in row["roles"]], row["faults"], ENDS, NOTHING)
            yield piece(row, row["faults"], edits + endings(state), NOTHING)

    def planned(found: Iterator[dict]) -> Iterator[tuple]:
        for row in found:
            yield piece(row, with_repeats(row), row["edits"], row["state"])

    long = chunks.filter("not whole")
    again = written(repeats_between(long), "again")
    plans = written(plans_of_long(long, again), "plans")
    joined = long.join(again, "chunk", "left").join(plans, "chunk")
    return mapped(chunks.filter("whole"), alone, PIECES).union(mapped(joined, planned, PIECES))


def messages(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, chunk, place, role, text, to be read in order of chunk and place."""
    found = pieces(rows, copies).select("conv_id", "chunk", F.posexplode("messages").alias("place", "message"))
    return found.select("conv_id", "chunk", "place", "message.role", "message.text")


REPAIRED: Fields = {
    "conv_id": LONG, "gaps": LONG, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "cost": LONG,
    "audit": TEXT, "repaired_sha256": TEXT,
}


class Account:
    """What is told of one conversation, chunk by chunk."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.illegal, self.cost, self.turns = conv_id, 0, 0, 0
        self.faults = {"b": 0, "d": 0, "t": 0, ".": 0}
        self.initial = self.first = self.last = None
        self.edits: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for turn in row["turns"]:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        for role in row["roles"]:
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
        for fault in row["faults"]:
            self.faults[fault] += 1
        at = 0
        for edit in row["edits"]:
            if edit == "I":
                self.cost += INSERT
                continue
            kept_fault = TRUNCATED if row["faults"][at] == "t" and edit != "D" else 0
            self.cost += {"K": 0, "R": REROLE, "D": DELETE}[edit] + kept_fault
            at += 1
        self.edits.append(row["edits"])
        for message in row["messages"]:
            self.digest.update(("\n" * self.begun + f"{message['role']}:{message['text']}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        counts = (self.faults[f] for f in "bdt")
        return self.conv_id, gaps, *counts, self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest()


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row for each conversation: its gaps, faults, illegal pairs of roles, cost, edits and the digest of what is left."""
    found = written(pieces(rows, copies).withColumn("conversation", conversation_key()), "pieces")

    def told(found: Iterator[dict]) -> Iterator[tuple]:
        account, conversation = None, None
        for row in found:
            if account is None or row["conversation"] != conversation:
                if account is not None:
                    yield account.row()
                account, conversation = Account(row["conv_id"]), row["conversation"]
            account.add(row)
        if account is not None:
            yield account.row()

    long = in_order(found.filter("not whole"))
    return mapped(found.filter("whole"), told, REPAIRED).union(mapped(long, told, REPAIRED))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the faults that a checksum of conversation and turn gives them, and how often each is there."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    found = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return found, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
