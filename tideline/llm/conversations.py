"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation is empty, or an optional system message and then one or more pairs of
user and assistant. Each message is kept, given another role or deleted, and empty messages
may be inserted. The states of this grammar are those of a Viterbi search over the messages:
one survivor (cheapest edits, of equals the least by their letters) per state.

Survivors are leaves of a tree of back pointers with reference counts. A node that no survivor
needs any more is freed; as soon as the oldest row of the tree holds one node, all survivors
share it and its edit is emitted. So the memory of a conversation is that of its unresolved
rows, which carry no text. Complete unresolved suffixes are compared: the letters of two
survivors that end with edits of the same message are equal or differ at some letter before
either ends, so their order is carried on from row to row, and a tie costs constant time.

Messages reach the search sorted, one conversation after the other, in Arrow batches, and texts
are joined to the emitted edits afterwards.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3

#: States: nothing yet, after system, after user, after assistant; the first and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_FOLLOWS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {state: [to for (own, letter), to in _FOLLOWS.items() if own == state and letter != "s"] for state in range(4)}


def _inserted(state: int) -> list[tuple[int, str, int]]:
    """``state, letters, cost`` of up to two insertions; more lead to a state that fewer reach."""
    out = [(state, "", 0)]
    for _ in range(2):
        state = _AFTER[state][0]
        out.append((state, out[-1][1] + INSERT, out[-1][2] + COST[INSERT]))
    return out


def _moves(initial: str, gone: bool, cut: bool) -> list[list[tuple[int, int, str]]]:
    """For each state before a message: ``cost, state after, letters``, the best for each state after."""
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        for state, letters, cost in _inserted(start):
            options = [(DELETE, state, 0)]
            if not gone:
                extra = TRUNCATED_COST if cut else 0
                kept = _FOLLOWS.get((state, initial))
                options += [(KEEP, kept, extra)] if kept is not None else []
                options += [(REROLE, to, extra) for to in _AFTER[state]]
            for letter, to, extra in options:
                found = cost + COST[letter] + extra, letters + letter
                best[to] = min(best.get(to, found), found)
        out.append([(cost, to, letters) for to, (cost, letters) in best.items()])
    return out


MOVES = {(i, g, c): _moves(i, g, c) for i, g, c in product(("s", "u", "a", ""), (False, True), (False, True))}
_ENDS = [[(cost, letters) for state, letters, cost in _inserted(start) if state in (EMPTY, ASSISTANT)] for start in range(4)]


#: ``_MIMIC[a][b]``: what it costs at most to follow any ending of state b from state a, by
#: insertions and, where it starts with a system message, by deleting that. A survivor that is
#: dearer by more than this can no longer win, nor tie.
_MIMIC = {
    EMPTY: {SYSTEM: 0, USER: 3, ASSISTANT: 0},
    SYSTEM: {EMPTY: 10, USER: 3, ASSISTANT: 6},
    USER: {EMPTY: 7, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {EMPTY: 4, SYSTEM: 0, USER: 3},
}


class Node:
    """The edits at one message on some survivor's path: insertions, then the message's own."""

    __slots__ = ("parent", "letters", "start", "uses", "row")

    def __init__(self, parent: Node | None, letters: str, start: int, row: Row):
        self.parent, self.letters, self.start, self.uses, self.row = parent, letters, start, 0, row


class Row:
    """A message of the search and the live nodes at it."""

    __slots__ = ("message", "nodes")

    def __init__(self, message):
        self.message, self.nodes = message, set()


class Repair:
    """The search over one conversation; ``add`` and ``end`` give the edits that are settled.

    An edit is ``letter, message (None for an insertion), role (None: its own; of a deletion also)``.
    """

    def __init__(self):
        self.rows: deque[Row] = deque()
        #: state: cost, place in the order of the survivors' letters, node
        self.survivors: dict[int, tuple[int, int, Node | None]] = {EMPTY: (0, 0, None)}
        #: rows held at most at a time
        self.most = 0

    def add(self, initial: str, gone: bool, cut: bool, message) -> Iterator[tuple]:
        moves = MOVES[initial if initial in ("s", "u", "a") else "", gone, cut]
        best: dict[int, tuple] = {}
        for state, (cost, place, _) in self.survivors.items():
            for extra, to, letters in moves[state]:
                found = cost + extra, place, letters, state
                if to not in best or found < best[to]:
                    best[to] = found
        lost = [b for b in best if any(best[a][0] + extra < best[b][0] for a in best for c, extra in _MIMIC[a].items() if c == b)]
        for state in lost:
            del best[state]
        row, old = Row(message), self.survivors
        order = {key: n for n, key in enumerate(sorted({(place, letters) for _, place, letters, _ in best.values()}))}
        self.survivors = {}
        for to, (cost, place, letters, state) in best.items():
            parent = old[state][2]
            node = Node(parent, letters, state, row)
            node.uses = 1
            row.nodes.add(node)
            if parent is not None:
                parent.uses += 1
            self.survivors[to] = cost, order[place, letters], node
        self.rows.append(row)
        for _, _, node in old.values():
            self.release(node)
        self.most = max(self.most, len(self.rows))
        while len(self.rows) > 1 and len(self.rows[0].nodes) == 1:
            shared = self.rows.popleft().nodes.pop()
            for child in self.rows[0].nodes:
                child.parent = None
            yield from self.edits(shared)

    @staticmethod
    def release(node: Node | None) -> None:
        while node is not None:
            node.uses -= 1
            if node.uses:
                return
            node.row.nodes.discard(node)
            node = node.parent

    @staticmethod
    def edits(node: Node) -> Iterator[tuple]:
        state = node.start
        for letter in node.letters:
            if letter == INSERT:
                state = _AFTER[state][0]
                yield letter, None, _ROLE[state]
            else:
                yield letter, node.row.message, _ROLE[_AFTER[state][0]] if letter == REROLE else None

    def end(self) -> Iterator[tuple]:
        """The edits of the best survivor that are not settled yet, and the insertions after the last message."""
        _, _, letters, state = min(
            (cost + extra, place, letters, state)
            for state, (cost, place, _) in self.survivors.items()
            for extra, letters in _ENDS[state]
        )
        path, node = [], self.survivors[state][2]
        while node is not None:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            yield from self.edits(node)
        for letter in letters:
            state = _AFTER[state][0]
            yield letter, None, _ROLE[state]


class Message(NamedTuple):
    turn: int | None
    role: str
    fault: str | None
    key: bytes


#: Rows of an output batch.
BATCH = 4096


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, BATCH).columns], strict=True)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted messages (conv_id, turn, role, key, blank, cut, earlier) to edits."""
    def own(conv, place, edit) -> tuple:
        letter, message, role = edit
        if message is None:
            return conv, place, letter, None, None, None, role, None
        if letter == DELETE:
            return conv, place, letter, message.turn, message.role, message.fault, None, None
        return conv, place, letter, message.turn, message.role, message.fault, role or message.role, message.key

    def edits(rows) -> Iterator[tuple]:
        conv, last, place, repair = None, None, 0, None
        for at, turn, role, key, blank, cut, earlier in rows:
            if repair is None or at != conv:
                if repair is not None:
                    for edit in repair.end():
                        yield own(conv, place, edit)
                        place += 1
                conv, last, place, repair = at, None, 0, Repair()
            repeated = earlier or last == (turn, key)
            last = turn, key
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if cut else None
            for edit in repair.add(role[:1], blank or repeated, cut, Message(turn, role, fault, key)):
                yield own(conv, place, edit)
                place += 1
        if repair is not None:
            for edit in repair.end():
                yield own(conv, place, edit)
                place += 1

    def columns(first: pa.RecordBatch) -> pa.Schema:
        types = [first.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary()]
        return pa.schema(list(zip(EDIT_COLUMNS, types, strict=True)))

    def chained(first) -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    start = next(batches, None)
    if start is not None:
        yield from _batched(edits(_rows(chained(start))), columns(start))


EDIT_COLUMNS = ("conv_id", "place", "edit", "turn", "was_role", "fault", "role", "key")


def _order(turn: Column) -> Column:
    """Turns with null before all others, as a value that ``min`` can take."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def _messages(conversations: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    # lengths keep different parts from running together
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("role")]
    sizes = [F.when(F.col("conv_id").isNull(), "-").otherwise(F.length(parts[0]).cast("string")), F.length("role").cast("string")]
    return rows.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", *sizes, *parts, "text"), 256)))


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: ``conv_id, place, edit, turn, was_role, fault, role, text``.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Messages are
    taken by turn (null first), then role, then a hash of the text; a null role or text counts
    as one space, and rows with a null conv_id form one conversation. ``place`` counts the edits
    of a conversation from 0. ``edit`` is K (kept), R (other role), D (deleted) or I (inserted).
    ``fault`` is the message's first fault: blank, duplicate (role and text seen earlier),
    truncated (the last character but spaces is none of ``.!?``), or null. ``role`` and ``text``
    are those of the repaired message (null if deleted; the text of an inserted one is empty).
    The edits are the cheapest (keep 0, role 3, delete 4, insert 3, and 3 for a truncated message
    that stays; blank and duplicate messages must go); of equals, the least by letters.
    A conversation without rows, so an empty table too, has no edits.
    """
    rows = _messages(conversations)
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    slim = rows.select(
        "conv_id", "turn", "role", "key", (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    first = slim.groupBy("key").agg(F.min(_order(F.col("turn"))).alias("first"))
    slim = slim.join(first, "key").select(
        "conv_id", "turn", "role", "key", "blank", "cut", (_order(F.col("turn")) > F.col("first")).alias("earlier")
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    types = [slim.schema["conv_id"].dataType, T.LongType(), T.StringType(), T.LongType(), *[T.StringType()] * 3, T.BinaryType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(EDIT_COLUMNS, types, strict=True)])
    edits = ordered.mapInArrow(_search, schema)
    texts = rows.select("key", F.col("turn").alias("own_turn"), F.col("text").alias("own_text")).dropDuplicates(["key", "own_turn"])
    same = (F.col("edits.key") == F.col("texts.key")) & F.col("edits.turn").eqNullSafe(F.col("texts.own_turn"))
    text = F.when(F.col("edit") == INSERT, "").otherwise(F.col("own_text"))
    return edits.alias("edits").join(texts.alias("texts"), same, "left").select(
        *[F.col(f"edits.{c}") for c in EDIT_COLUMNS[:-1]], text.alias("text")
    )


_DIGEST_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {"su", "ua", "au"}


class _Digest:
    def __init__(self):
        self.turns = None
        self.counts = dict.fromkeys(_DIGEST_COUNTS, 0)
        self.before, self.audit, self.hash, self.lines = None, [], hashlib.sha256(), 0

    def add(self, edit, turn, was_role, fault, role, text) -> None:
        counts = self.counts
        self.audit.append(edit)
        counts["cost"] += COST[edit] + (TRUNCATED_COST if fault == "truncated" and edit != DELETE else 0)
        if edit != INSERT:
            if fault:
                counts[fault] += 1
            if self.before is not None and self.before + was_role[:1] not in _LEGAL:
                counts["illegal"] += 1
            self.before = was_role[:1]
            if turn is not None:
                low, high, distinct = self.turns or (turn, turn, 1)
                self.turns = low, turn, distinct + (turn != high)
        if edit != DELETE:
            self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self, conv) -> tuple:
        if self.turns:
            low, high, distinct = self.turns
            self.counts["gaps"] = high - low + 1 - distinct
        return conv, *self.counts.values(), "".join(self.audit), self.hash.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edits to one row a conversation; texts pass through the hash one by one."""

    def folded(rows) -> Iterator[tuple]:
        conv, state = None, None
        for at, _, *edit in rows:
            if state is None or at != conv:
                if state is not None:
                    yield state.row(conv)
                conv, state = at, _Digest()
            state.add(*edit)
        if state is not None:
            yield state.row(conv)

    def chained(first) -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    first = next(batches, None)
    if first is not None:
        names = ["conv_id", *_DIGEST_COUNTS, "audit", "repaired_sha256"]
        types = [first.schema.field(0).type, *[pa.int64()] * len(_DIGEST_COUNTS), pa.string(), pa.string()]
        yield from _batched(folded(_rows(chained(first))), pa.schema(list(zip(names, types, strict=True))))


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: counts of what was found, cost, edit letters, and a hash of the repaired messages.

    ``gaps`` is the number of turns missing between the least and the greatest one (nulls
    ignored), ``illegal`` the number of neighbouring messages whose roles may not follow each
    other. The messages of a conversation go through one hash, so through one task, as a stream.
    """
    ordered = edits.select(
        "conv_id", "place", "edit", "turn", "was_role", "fault", "role", "text"
    ).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    fields = [T.StructField("conv_id", edits.schema["conv_id"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in _DIGEST_COUNTS]
    fields += [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")]
    return ordered.mapInArrow(_digest, T.StructType(fields))


def damage(conversations: DataFrame) -> DataFrame:
    """The messages with faults by a hash of conversation and turn, one message in five: some are
    dropped, emptied, cut of ``.!?``, repeated or given to the user. A null counts as one space."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    text = F.when(code == 1, "").when(code == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    damaged = conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    )
    return damaged.drop("copy")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(repair(damage(given))).withColumnRenamed("conv_id", "own_id")
    known = given.select("conv_id").distinct()
    joined = known.join(found, known["conv_id"].eqNullSafe(found["own_id"]), "left").drop("own_id")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _DIGEST_COUNTS]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL: dict[str, str] = {}
