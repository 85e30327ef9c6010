"""Conversation structure repair: the cheapest edits after which a conversation's turns follow the grammar.

A conversation is its rows in order of turn (nulls first; rows of one turn by role, then by the
SHA-256 of the text). Role initials must read (s?(ua)+)?: nothing at all, or an optional system
turn and then user and assistant by turns. A row's first fault counts: blank (no character but
white space), duplicate (role and text stood earlier), truncated (its last character that is no
white space isn't one of . ! ?). Edits: K keep (0), R set the role to user or assistant (2), D delete
(3; the only one for blank and duplicate rows), I insert a user or assistant turn without text
(2); a truncated row that stays costs 1 more. Of edits that cost the same the ASCII-least line of
initials wins. Costs are found by Dijkstra on the implicit lattice of (rows done, grammar state)
with the key (cost, audit), up to the first popped end node in an accepting state.

Two edit lines of the same cost that lead to the same node are never one the beginning of the
other (the longer one would hold more inserts), so the order of two lines outlasts any
common continuation. For the same reason a long conversation is worked through BLOCK rows at
a time: what goes on from block to block is the cheapest line to each state just after
the block's last row. A conversation's rows pass one task in order, since their digest is one hash
over all of them, but no task holds more than a block of them and the edit line.

Nulls: a null role or text counts as one space, as does a null conv_id or turn where a row is
picked for damage; rows without conv_id are one conversation, whose conv_id stays null. Empty tables
give empty ones; a conversation without rows left keeps its report (zeros, no edits). A role whose first
character is none of s, u, a can't be kept. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one search spans.
BLOCK = 256
#: Bytes of text in a batch on its way out.
OUT_BYTES = 1 << 22

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: What edits cost, and what a truncated row that stays costs besides.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
STAYS_TRUNCATED = 1
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
ON = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a turn that is given the role the grammar asks for.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by the CRC-32 of conv_id:turn modulo 20: 0 drops the row, 1 empties it, 2 takes its . ! ? out, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    df = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way")).where("way <> 0")
    role, text = F.when(F.col("way") == 4, "user").otherwise(F.col("role")), F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(again).alias("again")).drop("again")


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest: nulls as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    return df.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _fault() -> Column:
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)


class Search:
    """The cheapest edits of one conversation, fed row by row."""

    def __init__(self) -> None:
        # by state just after the last row done: (cost, rank of the edit line, the line as a chain of pieces)
        self.front: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        self.rows: list[tuple[str, int]] = []

    def add(self, initial: str, fault: int) -> None:
        if len(self.rows) == BLOCK:
            self._block(False)
            self.rows = []
        self.rows.append((initial, fault))

    def end(self) -> tuple[int, str]:
        cost, line = self._block(True)
        pieces = []
        while line:
            line, piece = line
            pieces.append(piece)
        return cost, "".join(reversed(pieces))

    def _block(self, last: bool) -> tuple[int, tuple] | None:
        rows, n = self.rows, len(self.rows)
        lines = {rank: line for _, rank, line in self.front.values()}
        heap = [(cost, rank, "", 0, state) for state, (cost, rank, _) in self.front.items()]
        heapq.heapify(heap)
        done, found = set(), {}
        while heap:
            cost, rank, audit, i, state = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == n:
                if last and state in ENDS:
                    return cost, (lines[rank], audit)
                if not last:
                    found[state] = (cost, rank, audit)
                    continue
            heapq.heappush(heap, (cost + COST[INSERT], rank, audit + INSERT, i, NEXT[state]))
            if i == n:
                continue
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + COST[DELETE], rank, audit + DELETE, i + 1, state))
            if fault in (BLANK, DUPLICATE):
                continue
            more = cost + STAYS_TRUNCATED * (fault == TRUNCATED)
            heapq.heappush(heap, (more + COST[REROLE], rank, audit + REROLE, i + 1, NEXT[state]))
            to = ON.get((state, initial))
            if to is not None:
                heapq.heappush(heap, (more + COST[KEEP], rank, audit + KEEP, i + 1, to))
        order = {x: k for k, x in enumerate(sorted((rank, audit) for _, rank, audit in found.values()))}
        self.front = {state: (cost, order[rank, audit], (lines[rank], audit)) for state, (cost, rank, audit) in found.items()}
        return None


#: Of a conversation: faults by kind, gaps in the numbers of its turns, illegal neighbours, cost and initials of the edits.
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Told:
    """Report of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.search, self.faults, self.illegal, self.before = Search(), [0] * 4, 0, None
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.search.add(initial, fault)
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = turn
            self.first = turn if self.first is None else self.first

    def end(self) -> tuple:
        cost, audit = self.search.end()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, cost, audit


def audits(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, the columns of REPORT, audit: of each conversation of turns, and of those of conversations of which turns has no row.

    Only what tells faults and order is shuffled, not the texts.
    """
    df = _keyed(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "digest", _fault().alias("fault"))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    df = df.withColumn("again", F.row_number().over(same) > 1)
    # of equal rows of one turn the one that counts as the first stands first
    fault = F.when((F.col("fault") != BLANK) & F.col("again"), DUPLICATE).otherwise(F.col("fault"))
    df = df.select("conv_id", "turn", "role", "digest", "again", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    df = df.unionByName(ids.withColumn("fault", F.lit(-1)), allowMissingColumns=True)
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *REPORT, "audit"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, at, out = None, None, []
        for batch in batches:
            for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
                if told is None or conv != at:
                    if told:
                        out.append((at, *told.end()))
                    told, at = _Told(), conv
                if fault >= 0:
                    told.add(turn, initial, fault)
            if out:
                yield _batch(out, names, batch.schema.field("conv_id").type)
                out = []
        if told:
            yield _batch([(at, *told.end())], names, batch.schema.field("conv_id").type)

    order = [F.asc_nulls_first("conv_id"), "fault_row", F.asc_nulls_first("turn"), "role", "digest", "again"]
    sorted_ = df.withColumn("fault_row", F.col("fault") >= 0).repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions(*order)
    return sorted_.select("conv_id", "turn", "initial", "fault").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [kind, *([pa.int64()] * len(REPORT)), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class _Replay:
    """The turns that stay when a conversation's edits are carried out, fed row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _given(self) -> str:
        self.state = NEXT[self.state]
        return ROLE[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the inserts that come next."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield INSERT, self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = ON[self.state, role[:1]]
            yield edit, role, text
        elif edit == REROLE:
            yield edit, self._given(), text


def _replayed(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Per conversation its report (position null), then its repaired turns in order: no shuffle is needed to go through a conversation again."""
    rows = _keyed(turns).withColumn("turn", F.col("turn").cast("long"))
    both = reports.unionByName(rows, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest"]
    both = both.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions(*order)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, position long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, replay, at, n, types = [], 0, None, None, 0, None
        names = ["conv_id", *REPORT, "audit", "position", "edit", "role", "text"]
        empty = (None,) * (len(REPORT) + 1)

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *([pa.int64()] * len(REPORT)), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            report = [batch.column(c) for c in (*REPORT, "audit")]
            for k, (conv, role, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text"), strict=True)):
                if report[-1][k].is_valid:
                    made = [(e, r, t) for e, r, t in replay.inserted()] if replay else []
                    out += [(at, *empty, n + j, *m) for j, m in enumerate(made)]
                    replay, at, n = _Replay(report[-1][k].as_py()), conv, 0
                    out.append((conv, *(c[k].as_py() for c in report), None, None, None, None))
                    continue
                for m in replay.row(role.as_py(), text.as_py()):
                    out.append((at, *empty, n, *m))
                    n += 1
                    held += len(m[2])
                if held >= OUT_BYTES:
                    yield ready()
                    out, held = [], 0
            if out:
                yield ready()
                out, held = [], 0
        if replay:
            out = [(at, *empty, n + j, *m) for j, m in enumerate(replay.inserted())]
            if out:
                yield ready()

    return both.select("conv_id", *REPORT, "audit", "role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired): audits() of turns, and conv_id, position, edit, role, text of the turns that the edits leave."""
    reports = audits(turns, conversations)
    return reports, _replayed(turns, reports).where("position is not null").select("conv_id", "position", "edit", "role", "text")


def repaired_digests(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """audits() and repaired_sha256: of the repaired conversation's role:text, joined by newlines."""
    rows = _replayed(turns, audits(turns, conversations))
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, parts = None, None, []

        def ready() -> pa.RecordBatch:
            return head.append_column("repaired_sha256", pa.array([digest.hexdigest()], pa.string()))

        for batch in batches:
            positions, roles, texts = batch.column("position"), batch.column("role"), batch.column("text")
            for k in np.arange(len(batch)).tolist():
                if not positions[k].is_valid:
                    if head is not None:
                        parts.append(ready())
                    head, digest = batch.slice(k, 1).select(["conv_id", *REPORT, "audit"]), hashlib.sha256()
                    continue
                digest.update(b"\n" * (positions[k].as_py() > 0) + roles[k].as_py().encode() + b":")
                digest.update(memoryview(texts[k].as_buffer()))
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts = []
        if head is not None:
            yield ready()

    return rows.mapInArrow(run, schema)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged by rule: its faults, and what the cheapest repair does and gives."""
    return repaired_digests(damaged(conversations), conversations)
