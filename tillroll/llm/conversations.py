"""Repair of conversations whose turns are out of order of roles, at the least cost.

Method. Rows are dealt by conversation and sorted within tasks by conversation, turn, role and
text; a task streams them through mapInArrow (as mapInPandas does, but pandas has no BIGINT with
NULLs) and carries the state of a dynamic programme from batch to batch, so that a conversation may
span any number of batches. The repaired roles have to read ``(s?(ua)+)?``, in first letters. Its
states: nothing said, system said, user said, pair complete. Per state the programme keeps the
least cost, the rank of its edits in ASCII order among the states, and the SHA-256 of the rows it has
kept so far; no text is held. Edits of equal cost are told apart by rank: just after a row no two
edit strings are prefixes of each other, and different states have different ones, so ranks
extended by the next letters decide. As costs only matter relative to each other, the programme
has few situations, and a step is remembered by situation and kind of row.

A step leaves a byte for each state, which says where it came from and by which edits. These
backpointers are followed at the end to write the edits down. Beyond SPILL rows of a conversation
they go to an unnamed file in Spark's own local folders, which ends with the task, as do the
digests of the rows seen, in sorted runs; if the task is lost, so are they, and it starts anew.

Edits: K keep; R make the row a user's or assistant's; D delete; I insert an empty row of either.
Costs: 0, 2, 3, 2; a truncated row that stays costs 1 more; blank and duplicate rows must go. Of
the cheapest edits the ASCII-least are taken.

Faults, the first of a row counts: blank (nothing but white space), duplicate (role and text of an
earlier row of the conversation), truncated (its last character but white space isn't ``.``, ``!``
or ``?``).

Cases: a NULL role or text is one space; NULL turns come first; rows of one turn come by role and
text; a NULL conv_id is a conversation. A row whose role has no first letter out of s, u, a must be
deleted or rerolled. A column named as ``copies`` tells how often a row stands there, 0 for a row
that does not but names its conversation. A conversation without rows has zeros, empty edits and the
hash of the empty string. Repeated rows are duplicates. An empty table gives an empty one; further
columns are not looked at. A conversation is the work of one task, in its order, with bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import arrow_schema, ddl, importable, record_batch

# Rows of a conversation whose backpointers, and digests, are held in memory.
SPILL = 1 << 18

NOTHING, SYSTEM, USER, PAIR = range(4)
# State -> what an inserted or rerolled row has to be, and the state after it.
_DUE = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
_KEEP = {(NOTHING, "s"): SYSTEM} | {(s, role[0]): after for s, (role, after) in _DUE.items()}
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
_LETTERS = "DKR"
_NEVER = 1 << 30

_BLANK = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


def _inserted(state: int) -> list[tuple[int, str]]:
    """(state, inserts) reached from ``state`` by inserting up to two rows; more only cost more."""
    out = [(state, "")]
    for n in (1, 2):
        out.append((_DUE[out[-1][0]][1], "I" * n))
    return out


@lru_cache(None)
def step(situation: tuple, initial: str, fault: str) -> tuple[tuple, tuple, bytes, int]:
    """The situation after a row, where each state came from, that as bytes, and the cost all share.

    A situation is (cost, rank) of each state. ``initial`` is s, u, a or "", ``fault`` blank,
    duplicate, truncated or "". A state comes from (state, inserts, letter), or None if
    it can't be reached.
    """
    stays = TRUNCATED if fault == "truncated" else 0
    best: dict[int, tuple] = {}

    def offer(state: int, cost: int, rank: int, edits: str, source: int) -> None:
        found = (cost, rank, edits, source)
        if state not in best or found < best[state]:
            best[state] = found

    for source, (cost, rank) in enumerate(situation):
        if cost >= _NEVER:
            continue
        for state, inserts in _inserted(source):
            paid = cost + INSERT * len(inserts)
            offer(state, paid + DELETE, rank, inserts + "D", source)
            if fault in ("blank", "duplicate"):
                continue
            offer(_DUE[state][1], paid + REROLE + stays, rank, inserts + "R", source)
            if (state, initial) in _KEEP:
                offer(_KEEP[state, initial], paid + KEEP + stays, rank, inserts + "K", source)
    ranks = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    least = min(found[0] for found in best.values())
    after = tuple((best[s][0] - least, ranks[s]) if s in best else (_NEVER, 0) for s in range(4))
    came = tuple((best[s][3], best[s][2][:-1], best[s][2][-1]) if s in best else None for s in range(4))
    packed = bytes(c[0] | len(c[1]) << 2 | _LETTERS.index(c[2]) << 4 if c else 255 for c in came)
    return after, came, packed, least


START = ((0, 0), (_NEVER, 0), (_NEVER, 0), (_NEVER, 0))


def finish(situation: tuple) -> tuple[int, int, str]:
    """State after the last row, cost from there, and rows to insert at the end."""
    ends = [
        (cost + INSERT * len(inserts), rank, inserts, source)
        for source, (cost, rank) in enumerate(situation)
        if cost < _NEVER
        for state, inserts in _inserted(source)
        if state in (NOTHING, PAIR)
    ]
    cost, _, inserts, source = min(ends)
    return source, cost, inserts


class Spilled:
    """Bytes that go to an unnamed file in Spark's local folders once there are many."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file, self.size = limit, bytearray(), None, 0

    def add(self, data: bytes) -> None:
        self.held += data
        if len(self.held) >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.file is None:
            folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
            self.file = tempfile.TemporaryFile(dir=folders[0] or None)
        self.file.write(self.held)
        self.size += len(self.held)
        self.held = bytearray()

    def backwards(self, width: int) -> Iterator[bytes]:
        """Records of ``width`` bytes from the last to the first."""
        blocks = iter([bytes(self.held)])
        if self.file is not None:
            blocks = self._blocks(width << 16)
        for block in blocks:
            for at in range(len(block) - width, -1, -width):
                yield block[at : at + width]

    def _blocks(self, size: int) -> Iterator[bytes]:
        self.flush()
        end = self.size
        while end:
            start = max(0, end - size)
            self.file.seek(start)
            yield self.file.read(end - start)
            end = start

    def array(self, dtype) -> np.ndarray:
        """The spilled bytes as numbers that are read from the file as needed."""
        self.flush()
        self.file.flush()
        return np.memmap(self.file, dtype, "r")


class Seen:
    """Which digests came before: the latest in a set, older ones in sorted runs on disk.

    Runs double in size, so that there are few of them.
    """

    def __init__(self, limit: int):
        self.limit, self.latest, self.runs = limit, set(), []

    def add(self, digest: bytes) -> bool:
        """Whether ``digest`` (16 bytes) came before; from now on it did."""
        if digest in self.latest:
            return True
        # Comparing numpy strings, trailing zero bytes do not count, on neither side.
        item = np.array([digest], "S16") if self.runs else None
        for run in self.runs:
            at = int(np.searchsorted(run, item)[0])
            if at < len(run) and run[at] == item[0]:
                return True
        self.latest.add(digest)
        if len(self.latest) >= self.limit:
            new = np.sort(np.array(list(self.latest), "S16"))
            while self.runs and len(self.runs[-1]) <= len(new):
                new = np.sort(np.concatenate([self.runs.pop(), new]), kind="stable")
            kept = Spilled(1 << 20)
            for at in range(0, len(new), 1 << 16):
                kept.add(new[at : at + (1 << 16)].tobytes())
            self.runs.append(kept.array("S16"))
            self.latest = set()
        return False


class Conversation:
    """The running repair of one conversation."""

    def __init__(self, spill: int):
        self.situation, self.cost = START, 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.pointers, self.seen = Spilled(4 * spill), Seen(spill)
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if self.last is None or turn != self.last:
                self.turns += 1
            self.last = turn
        data = f"{role}:{text}".encode()
        key = f"{len(role)}:{role}:{text}".encode()
        came = self.seen.add(hashlib.blake2b(key, digest_size=16).digest())
        solid = text.rstrip(_BLANK)
        fault = "blank" if not solid else "duplicate" if came else "" if solid[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        state = step(self.situation, initial if initial and initial in "sua" else "", fault)
        self.situation, sources, packed, least = state
        self.cost += least
        self.pointers.add(packed)
        self.hashes = [c and self._hash(c, data, text) for c in sources]

    def _hash(self, source: tuple, data: bytes, text: str):
        state, inserts, letter = source
        if letter == "D" and not inserts:
            return self.hashes[state]
        made = self.hashes[state].copy()
        for _ in inserts:
            role, after = _DUE[state]
            made.update((b"\n" if state != NOTHING else b"") + f"{role}:".encode())
            state = after
        if letter != "D":
            row = data if letter == "K" else f"{_DUE[state][0]}:{text}".encode()
            made.update((b"\n" if state != NOTHING else b"") + row)
        return made

    def result(self) -> tuple:
        state, cost, inserts = finish(self.situation)
        last = self._hash((state, inserts, "D"), b"", "") if inserts else self.hashes[state]
        edits = [inserts]
        for record in self.pointers.backwards(4):
            byte = record[state]
            edits.append("I" * (byte >> 2 & 3) + _LETTERS[byte >> 4])
            state = byte & 3
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (
            gaps,
            *self.counts.values(),
            self.illegal,
            self.cost + cost,
            "".join(reversed(edits)),
            last.hexdigest(),
        )


_RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def _ordered(rows: DataFrame, copies: str | None, *more: str) -> DataFrame:
    """Rows by conversation, within tasks in the order of their turns."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    times = F.col(copies).cast("int") if copies else F.lit(1)
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), one("role"), one("text"), times.alias("copies"), *more
    )
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", *more, F.asc_nulls_first("turn"), "role", "text"
    )


def repair_conversations(rows: DataFrame, copies: str | None = None, spill: int = SPILL) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): its faults, the cost and the
    letters of the cheapest edits, and the SHA-256 of the repaired rows."""
    ordered = _ordered(rows, copies)
    schema = f"{ddl(rows.select('conv_id'))}, {_RESULT}"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, None
        for batch in batches:
            done = []
            for name, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if found is None or name != current:
                    if found is not None:
                        done.append((current, *found.result()))
                    current, found = name, Conversation(spill)
                for _ in range(copies):
                    found.add(turn, role, text)
            if done:
                yield record_batch(list(map(list, zip(*done))), arrow)
        if found is not None:
            yield record_batch([[v] for v in (current, *found.result())], arrow)

    return importable(ordered).mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, repairs: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), turn (NULL where inserted), role, text and
    edit (K, R or I), from ``rows`` and the result of ``repair_conversations`` over them.

    The letters of a conversation stream ahead of its rows, so no row is looked up.
    """
    letters = repairs.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(0).alias("_rows"),
    )
    times = F.col(copies).cast("int") if copies else F.lit(1)
    rows = rows.select("conv_id", "turn", "role", "text", times.alias("copies"), F.lit(1).alias("_rows"))
    ordered = _ordered(letters.unionByName(rows), "copies", "_rows")
    schema = f"{ddl(rows.select('conv_id'))}, position bigint, turn bigint, role string, text string, edit string"
    arrow = arrow_schema(schema)

    def insert(out, name, position, state):
        role, state = _DUE[state]
        out.append((name, position, None, role, "", "I"))
        return position + 1, state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position, current = "", 0, NOTHING, 0, None
        for batch in batches:
            out: list[tuple] = []
            for name, turn, role, text, copies, is_row in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_row:
                    while at < len(audit):  # rows inserted at the end of the one before
                        position, state = insert(out, current, position, state)
                        at += 1
                    audit, at, state, position, current = text, 0, NOTHING, 0, name
                    continue
                for _ in range(copies):
                    while audit[at] == "I":
                        position, state = insert(out, name, position, state)
                        at += 1
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        said = _DUE[state][0] if letter == "R" else role
                        state = _DUE[state][1] if letter == "R" else _KEEP[state, role[0]]
                        out.append((name, position, turn, said, text, letter))
                        position += 1
            if out:
                yield record_batch(list(map(list, zip(*out))), arrow)
        out = []
        while at < len(audit):
            position, state = insert(out, current, position, state)
            at += 1
        if out:
            yield record_batch(list(map(list, zip(*out))), arrow)

    return importable(ordered).mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The damaged rows of the contract: conv_id, turn, role, text, copies (0 where a row is dropped)."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", one("conv_id"), one("turn"))) % 20
    text = one("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(one("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def conversation_query(conversations: DataFrame) -> DataFrame:
    return repair_conversations(damage(conversations), "copies")
