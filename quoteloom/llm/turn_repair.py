"""Operator 13, conversation structure repair: the cheapest edits that make a conversation alternate.

The role initials of a repaired conversation read ``(s?(ua)+)?``. Four grammar states say what was kept last: nothing, s, u
or a. Edits of a row: keep it (K, 0), give it the role that the grammar needs (R, 1), delete it (D, 2); rows with a fault
``blank`` or ``duplicate`` can only be deleted, ``truncated`` ones cost 5 more unless deleted. Between rows an empty user or
assistant row may be inserted (I, 5). Of equally cheap edits the ASCII-least string of initials wins.

1. ``damage`` (the query's own input) and the faults that a row has by itself are column expressions; whether a role and
   text were seen in an earlier turn comes from an aggregate of their SHA-256, joined back.
2. Rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any length is spread over tasks. Each task
   streams its rows, sorted, through a forward Viterbi pass: per state the least (cost, audit), and after each row one
   round of inserts (0 or s to u, a to u, u to a), which is all that can pay. Paths of one cost and state are never prefixes of
   each other, so the least string stays least whatever follows.
3. A conversation within one task is finished there. Of others, a task gives a *segment*: the least (cost, audit) from
   each state to each state. Few segments a conversation are put together in order.
4. Their texts are hashed along the audit, as a stream in order. SHA-256 has no other way; only rows of conversations
   that were split come here, and none is held longer than its batch.

A task holds at most ``HELD`` bytes of texts, and audits: a letter a row, for up to 16 pairs of states.

Defined results: a null role or text is one space, as is a null conv_id or turn in the checksum; a null conv_id is one
conversation; null turns come first, and count neither for gaps nor for distinct turns; rows of one turn are ordered by (role, text),
bytewise; an empty role has no legal initial; very long texts pass through whole; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only role that may be made up in a state, and the state that a kept initial leads to.
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Bytes of texts of a conversation that a task holds before it passes them on as a segment's.
HELD = 4 << 20
_BLANK = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of ``rows`` (conv_id, turn, role, text); copies 0: the row is dropped."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, text = F.col("kind"), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(named.cast("binary")) % 20).alias("kind"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faults(rows: DataFrame, scratch: store.Scratch) -> DataFrame:
    """conv_id, turn, role, text, copies, fault ('blank', 'duplicate', 'truncated' or ''): of the first copy of each row.

    Rows equal in all four columns, and copies, are only found to be duplicates when they are met in order.
    """
    rows = rows.where("copies > 0").select(F.struct("conv_id").alias("conv"), "turn", "role", "text", "copies", F.sha2("text", 256).alias("digest"))
    met = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
    again = scratch.keep(met.where("first <> last").drop("last"), "turns-again")
    rows = store.matching(rows, again, "conv", "role", "digest", how="left")
    seen = F.coalesce(F.struct("turn") != F.col("first"), F.lit(False))
    fault = F.when(~F.col("text").rlike(_BLANK), "blank").when(seen, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return rows.select("conv.conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


class Paths:
    """The least (cost, audit) from one state to each state over the rows so far."""

    def __init__(self, start: int) -> None:
        self.common: list[str] = []  # what all audits begin with
        self.best: dict[int, tuple[int, str]] = {start: (0, "")}
        if start == START:
            self._close()

    def _close(self) -> None:
        best = self.best
        for state, targets in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            options = [(best[x][0] + INSERT, best[x][1] + "I") for x in targets if x in best]
            if state in best:
                options.append(best[state])
            if options:
                best[state] = min(options)

    def row(self, initial: str, fault: str) -> None:
        after: dict[int, tuple[int, str]] = {}

        def to(state: int, cost: int, audit: str) -> None:
            if state not in after or (cost, audit) < after[state]:
                after[state] = cost, audit

        more, kept = (TRUNCATED if fault == "truncated" else 0), KEEPS.get(initial, {})
        for state, (cost, audit) in self.best.items():
            to(state, cost + DELETE, audit + "D")
            if fault not in ("blank", "duplicate"):
                to(FOLLOWS[state], cost + REROLE + more, audit + "R")
                if state in kept:
                    to(kept[state], cost + KEEP + more, audit + "K")
        self.best = after
        self._close()
        if len(after[next(iter(after))][1]) > 512:
            shared = len(os.path.commonprefix([audit for _, audit in after.values()]))
            if shared > 256:
                self.common.append(next(iter(after.values()))[1][:shared])
                self.best = {s: (cost, audit[shared:]) for s, (cost, audit) in after.items()}

    def ends(self) -> dict[int, tuple[int, str]]:
        common = "".join(self.common)
        return {state: (cost, common + audit) for state, (cost, audit) in self.best.items()}


def last_of(ends: dict[int, tuple]) -> tuple:
    """The least way to an accepting state; there is one, as inserts lead to it from any state."""
    return min(ends[state] for state in (START, ASSISTANT) if state in ends)


class Repaired:
    """Hashes ``role:text`` of the repaired rows, newline-joined, along an audit that comes in pieces."""

    def __init__(self) -> None:
        self.sha, self.state, self.any, self.audit, self.at = hashlib.sha256(), START, False, "", 0

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = FOLLOWS[self.state], self.at + 1
            self._put(NAMES[self.state], "")

    def follow(self, audit: str) -> None:
        self._inserts()
        self.audit, self.at = audit, 0

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = KEEPS[role[:1]][self.state]
            self._put(role, text)
        elif letter == "R":
            self.state = FOLLOWS[self.state]
            self._put(NAMES[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


class Stream:
    """The rows of one conversation that a task meets: paths, counts, and texts until they are hashed or passed on."""

    def __init__(self, conv_id, split: bool) -> None:
        self.conv_id, self.split, self.sequence, self.before = conv_id, split, 0, None
        self.paths = {s: Paths(s) for s in (range(4) if split else (START,))}
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last = 0, None, None
        self.rows: list[tuple[str, str]] = []
        self.bytes = 0

    def row(self, turn, role: str, text: str, copies: int, fault: str) -> None:
        for _ in range(copies):
            mine = (turn, role, text)
            fault = "duplicate" if fault != "blank" and mine == self.before else fault
            self.before, initial = mine, role[:1]
            if fault:
                self.count[fault] += 1
            if self.last is None:
                self.first = initial
            else:
                self.illegal += self.last + initial not in LEGAL
            self.last = initial
            for paths in self.paths.values():
                paths.row(initial, fault)
            # rows that will be deleted leave no text
            self.rows.append((role, "" if fault in ("blank", "duplicate") else text))
            self.bytes += 16 + len(self.rows[-1][1])

    def chunk(self, part: int) -> dict:
        self.sequence += 1
        rows, self.rows, self.bytes = self.rows, [], 0
        return {"conv_id": self.conv_id, "kind": "chunk", "part": part, "sequence": self.sequence, "rows": [{"role": r, "text": t} for r, t in rows]}

    def segment(self, part: int) -> dict:
        ways = [{"start": s, "end": e, "cost": cost, "audit": audit} for s, paths in self.paths.items() for e, (cost, audit) in paths.ends().items()]
        return {"conv_id": self.conv_id, "kind": "segment", "part": part, "ways": ways, "first": self.first, "last": self.last, "illegal": self.illegal} | self.count

    def whole(self, part: int) -> dict:
        cost, audit = last_of(self.paths[START].ends())
        repaired = Repaired()
        repaired.follow(audit)
        for role, text in self.rows:
            repaired.row(role, text)
        return {"conv_id": self.conv_id, "kind": "whole", "part": part, "illegal": self.illegal, "cost": cost, "audit": audit, "sha": repaired.digest()} | self.count


RESULT = "illegal long, blank long, duplicate long, truncated long, cost long, audit string, sha string"
PASSED = f"kind string, part long, sequence long, {RESULT}, first string, last string, ways array<struct<start: int, end: int, cost: long, audit: string>>, rows array<struct<role: string, text: string>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from batch.slice(i, 256).to_pylist()


def _out(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: chunks are long."""
    waiting: list[dict] = []
    for record in records:
        waiting.append(record)
        if len(waiting) >= 1000 or record.get("kind") == "chunk":
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    yield pa.RecordBatch.from_pylist(waiting, schema)


def _arrow(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """(DDL, Arrow schema) of a result that begins with the conv_id of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def streamed(rows: DataFrame) -> DataFrame:
    """What each task makes of the conversations whose rows it has: whole results, segments, and chunks of the latter's texts."""
    ddl, schema = _arrow(rows, PASSED)
    order = ["conv_id", "turn", "role", "text"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, now = TaskContext.get().partitionId(), None
        for row in _rows(batches):
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    if now.split:
                        yield now.chunk(part)
                        yield now.segment(part)
                    else:
                        yield now.whole(part)
                # the first conversation of a task may have begun in another one, so its start is open
                now = Stream(row["conv_id"], split=now is None)
            now.row(row["turn"], row["role"], row["text"], row["copies"], row["fault"])
            if now.bytes > HELD:
                now.split = True
                yield now.chunk(part)
        if now is not None:  # the last one may go on in another
            yield now.chunk(part)
            yield now.segment(part)

    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(lambda batches: _out(records(batches), schema), ddl)


def joined(segments: DataFrame) -> DataFrame:
    """The segments of each conversation in order: their slices of the audit (kind 'slice'), then its result (kind 'whole', without hash)."""
    ddl, schema = _arrow(segments, PASSED)

    def finished(conv_id, ends, parts, illegal) -> Iterator[dict]:
        cost, audit, cuts = last_of(ends)
        yield {"conv_id": conv_id, "kind": "whole", "cost": cost, "audit": audit, "illegal": illegal, "blank": 0, "duplicate": 0, "truncated": 0}
        for part, a, b in zip(parts, (0, *cuts[:-1]), cuts, strict=True):
            yield {"conv_id": conv_id, "kind": "slice", "part": part, "sequence": 0, "audit": audit[a:b]}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ends, conv_id, parts, last, illegal = None, None, [], None, 0
        for row in _rows(batches):
            if ends is None or row["conv_id"] != conv_id:
                if ends is not None:
                    yield from finished(conv_id, ends, parts, illegal)
                ends, conv_id, parts, last, illegal = {START: (0, "", ())}, row["conv_id"], [], None, 0
            after: dict[int, tuple] = {}
            for way in row["ways"]:
                if way["start"] in ends:
                    cost, audit, cuts = ends[way["start"]]
                    audit = audit + way["audit"]
                    mine = cost + way["cost"], audit, (*cuts, len(audit))
                    after[way["end"]] = min(after.get(way["end"], mine), mine)
            ends, illegal = after, illegal + (last is not None and last + row["first"] not in LEGAL)
            last = row["last"]
            parts.append(row["part"])
        if ends is not None:
            yield from finished(conv_id, ends, parts, illegal)

    columns = ["conv_id", "part", "ways", "first", "last"]
    ordered = segments.select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(lambda batches: _out(records(batches), schema), ddl)


def hashed(slices: DataFrame, chunks: DataFrame) -> DataFrame:
    """conv_id, sha: the texts of split conversations, in order, along their audits."""
    ddl, schema = _arrow(slices, "sha string")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, conv_id = None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if now is None or row["conv_id"] != conv_id:
                    if now is not None:
                        yield {"conv_id": conv_id, "sha": now.digest()}
                    now, conv_id = Repaired(), row["conv_id"]
                if row["rows"] is None:
                    now.follow(row["audit"])
                else:
                    for each in row["rows"]:
                        now.row(each["role"], each["text"])
        if now is not None:
            yield {"conv_id": conv_id, "sha": now.digest()}

    columns = ["conv_id", "part", "sequence", "audit", "rows"]
    both = slices.select(columns).union(chunks.select(columns))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "sequence").mapInArrow(lambda batches: _out(records(batches), schema), ddl)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of ``rows`` (conv_id, turn, role, text, copies)."""
    scratch = store.Scratch()
    passed = scratch.keep(streamed(faults(rows, scratch)), "turns-passed")
    segments = scratch.keep(joined(passed.where("kind = 'segment'")), "turns-joined")
    found = scratch.keep(hashed(segments.where("kind = 'slice'"), passed.where("kind = 'chunk'")), "turns-hashed")
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    counts = ["illegal", "blank", "duplicate", "truncated", "cost"]
    parts = gaps.unionByName(passed.where("kind <> 'chunk'").unionByName(segments.where("kind = 'whole'")).select("conv_id", *counts, "audit", "sha"), allowMissingColumns=True)
    parts = parts.unionByName(found, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    result = parts.groupBy("conv_id").agg(*(total(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    result = store.keep(result, "turns-repaired")
    scratch.clear()
    return result
