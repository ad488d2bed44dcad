"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

The rows of a conversation in order of their turns are kept, given another role, deleted or
followed by inserted empty ones until they read ``(s?(ua)+)?`` in role initials; ``trails``
finds the cheapest edits. A conversation of any length is cut into segments of bounded rows
by a range sort. A segment tells, for each state it may begin in, the cost of each state it
may end in and the order of their edits, which is all that choosing between segments needs;
so a very long conversation is 32 numbers per segment in one task, and its rows are repaired
where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.llm import trails
from faultweave.llm.common import text_key
from faultweave.llm.trails import STATES, Step, Summary, Trails
from faultweave.session import materialise

SEGMENT_ROWS = 4096
SEGMENT_CHARS = 4_000_000
#: Characters of a text by which rows of one turn and role are dealt to tasks.
DEALT_CHARS = 64
WHITE = "\\x20\\x09-\\x0D"
NONE, BLANK, DUPLICATE, CUT = range(4)
ALTERNATING = frozenset({"su", "ua", "au"})

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_LONGS = T.ArrayType(T.LongType())
_STRINGS = T.ArrayType(T.StringType())
#: A segment: which task and place, whether it is a whole conversation, what to add up, its rows or its repair.
_SEGMENT = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in COUNTS[1:]],
        T.StructField("turns", _LONGS),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("costs", _LONGS),
        T.StructField("ranks", _LONGS),
        T.StructField("roles", _STRINGS),
        T.StructField("texts", _STRINGS),
        T.StructField("faults", _LONGS),
        T.StructField("copies", _LONGS),
        T.StructField("audit", T.StringType()),
        T.StructField("repaired", _REPAIRED),
    ]
)
_CHOICE = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("section", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("after", T.LongType()),
        T.StructField("missing", T.LongType()),
        T.StructField("more_illegal", T.LongType()),
        T.StructField("cost", T.LongType()),
        T.StructField("gaps", T.LongType()),
    ]
)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with seeded faults, a null counting as one space: by CRC-32 of ``conv:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the
    user's. Other columns are not kept.
    """
    ids = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)]
    draw = F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit(" ")), F.coalesce(F.col(f"`{role}`"), F.lit(" "))
    said = F.when(draw == 1, "").when(draw == 2, F.translate(said, ".!?", "")).otherwise(said)
    return (
        rows.where(draw != 0)
        .select(
            F.col(f"`{conv}`").alias(conv),
            F.col(f"`{turn}`").alias(turn),
            F.when(draw == 4, "user").otherwise(by).alias(role),
            said.alias(text),
            F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _steps(roles: list[str], faults: list[int], copies: list[int]) -> list[Step]:
    return [Step(r[:1], f in (BLANK, DUPLICATE), f == CUT, n - 1) for r, f, n in zip(roles, faults, copies)]


def _illegal(roles: list[str], copies: list[int]) -> int:
    pairs = sum(a[:1] + b[:1] not in ALTERNATING for a, b in zip(roles, roles[1:]))
    return pairs + sum(n - 1 for n in copies)


def _counts(faults: list[int], copies: list[int]) -> tuple[int, int, int]:
    blank = sum(n for f, n in zip(faults, copies) if f == BLANK)
    doubled = sum(n if f == DUPLICATE else n - 1 for f, n in zip(faults, copies) if f != BLANK)
    return blank, doubled, faults.count(CUT)


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else high - low + 1 - n


class _Run:
    """Rows of one conversation that lie together in a task, up to a segment."""

    def __init__(self) -> None:
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.copies: list[int] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.copies.append(copies)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def record(self, part: int, segment: int, whole: bool, begins: bool) -> dict[str, Any]:
        steps = _steps(self.roles, self.faults, self.copies)
        known = [t for t in self.turns if t is not None]
        blank, duplicate, truncated = _counts(self.faults, self.copies)
        row: dict[str, Any] = dict.fromkeys(_SEGMENT.names)
        row |= {
            "part": part,
            "segment": segment,
            "whole": whole,
            "blank": blank,
            "duplicate": duplicate,
            "truncated": truncated,
            "illegal": _illegal(self.roles, self.copies),
            # the least and greatest turn and how many different ones
            "turns": [known[0], known[-1], len(set(known))] if known else None,
            "first": self.roles[0][:1],
            "last": self.roles[-1][:1],
        }
        if whole:
            paths = Trails()
            ends = trails.run(steps, trails.START, paths)
            costs = [-1 if e is None else e[0] for e in ends]
            end, missing = trails.best_end(costs, trails.ranks(ends, paths))
            edits = paths.text(ends[end][1])
            row["cost"] = costs[end] + trails.INSERT * missing
            row["audit"] = trails.spell(edits, steps, missing)
            row["repaired"] = trails.apply(edits, missing, trails.START, self.roles, self.texts)
        else:
            summary = trails.summarise(steps, [trails.START] if begins else range(STATES))
            row |= {"costs": summary.costs, "ranks": summary.ranks, "roles": self.roles, "texts": self.texts}
            row |= {"faults": self.faults, "copies": self.copies}
        return row


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[kind]


class _Writer:
    """Collects rows, each with a value of the conversation's column, into batches of bounded size."""

    def __init__(self, schema: T.StructType, names: list[str], kind: pa.DataType | None = None) -> None:
        self.types = [kind] * (kind is not None) + [_arrow(f.dataType) for f in schema]
        self.names = names
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> bool:
        self.rows.append(row)
        self.chars += chars
        return len(self.rows) >= 5000 or self.chars >= SEGMENT_CHARS

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*self.rows), self.types)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, self.names)


def _segments(rows: DataFrame, conv: str) -> DataFrame:
    """The segments of sorted rows (conv, turn, role, text, fault, n) as ``_SEGMENT`` beside ``conv``."""
    names = [conv, *_SEGMENT.names]
    schema = T.StructType([rows.schema[conv], *_SEGMENT.fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: _Writer | None = None
        run, count, runs, at = _Run(), 0, 0, object()  # rows held; segments of this conversation; conversations; which
        value: Any = None

        def close(ends: bool, last: bool) -> tuple[tuple, int]:
            # the first and the last conversation of a task may go on in others
            whole = ends and not last and count == 0 and runs > 1
            record = run.record(part, runs * (1 << 40) + count, whole, count == 0 and runs > 1)
            return (value, *[record[n] for n in _SEGMENT.names]), run.chars

        for batch in batches:
            if out is None:
                out = _Writer(_SEGMENT, names, batch.schema.field(conv).type)
            columns = [batch.column(c).to_pylist() for c in (conv, "_turn", "_role", "_text", "_fault", "_n")]
            for c, turn, role, text, fault, n in zip(*columns):
                if c != at:
                    if run.roles and out.add(*close(True, False)):
                        yield out.batch()
                    run, count, runs, at, value = _Run(), 0, runs + 1, c, c
                elif run.full():
                    if out.add(*close(False, False)):
                        yield out.batch()
                    run, count = _Run(), count + 1
                run.add(turn, role, text, fault, n)
        if out is not None:
            if run.roles:
                out.add(*close(True, True))
            yield out.batch()

    return rows.mapInArrow(cut, schema)


def _choices(segments: DataFrame) -> DataFrame:
    """For each segment of the cut conversations the states between which its cheapest edits run.

    The segments of a conversation come in order to one task, without their rows; it keeps
    the states before each segment and its place.
    """
    kept = segments.select("_key", "part", "segment", "costs", "ranks", "turns", "first", "last")
    dealt = kept.repartition("_key").sortWithinPartitions("_key", "part", "segment")

    def choose(rows: list[tuple]) -> Iterator[tuple]:
        costs, rank, backs = [0, -1, -1, -1], [0] * STATES, []
        low = high = None
        n_turns, last, extra = 0, None, []
        for _, _, _, part_costs, part_ranks, turns, first, end in rows:
            costs, rank, back = trails.compose(costs, rank, Summary(part_costs, part_ranks))
            backs.append(back)
            extra.append(0 if last is None else int(last + first not in ALTERNATING))
            last = end
            if turns:
                n_turns += turns[2] - (turns[0] == high)
                low, high = turns[0] if low is None else low, turns[1]
        state, missing = trails.best_end(costs, rank)
        total, gaps = costs[state] + trails.INSERT * missing, _gaps(low, high, n_turns)
        for k in range(len(rows) - 1, -1, -1):
            before, end = backs[k][state], k == len(rows) - 1
            values = (total, gaps) if k == 0 else (0, 0)
            yield (*rows[k][1:3], k, before, state, missing if end else 0, extra[k], *values)
            state = before

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, at = _Writer(_CHOICE, _CHOICE.names), [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != at and held:
                    for choice in choose(held):
                        if out.add(choice):
                            yield out.batch()
                    held = []
                at = row[0]
                held.append(row)
        for choice in choose(held) if held else ():
            if out.add(choice):
                yield out.batch()
        if out.rows:
            yield out.batch()

    return dealt.mapInArrow(walk, _CHOICE)


def _resolve(segments: DataFrame, keep: list[str]) -> DataFrame:
    """The edits and rows of each segment between its states; columns ``keep`` stay."""
    asked = ["before", "after", "missing", "roles", "texts", "faults", "copies"]
    schema = T.StructType(
        [*[segments.schema[c] for c in keep], T.StructField("audit", T.StringType()), T.StructField("repaired", _REPAIRED)]
    )

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                before, after, missing, roles, texts, faults, copies = (part.column(c)[0].as_py() for c in asked)
                steps, paths = _steps(roles, faults, copies), Trails()
                edits = paths.text(trails.run(steps, before, paths)[after][1])
                columns = [part.column(c) for c in keep]
                columns.append(pa.array([trails.spell(edits, steps, missing)], pa.string()))
                columns.append(pa.array([trails.apply(edits, missing, before, roles, texts)], _arrow(_REPAIRED)))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "audit", "repaired"])

    return segments.select(*keep, *asked).mapInArrow(spell, schema)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(``conv``, section, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    One row per section of a conversation, which is one section if it is short; counts and
    costs of the sections add up, ``audit`` (K, R, D, I for each edit) and ``repaired`` (role
    and text of the rows that are left) follow each other by ``section``. Rows go by turn,
    nulls first, then role and text. A row's first fault counts: blank, duplicate (of a row
    before it), truncated. Roles other than ``s…``, ``u…`` and ``a…`` cannot be kept, empty ones
    included. Null roles and texts count as one space; a null conversation is one of its own;
    equal rows travel as one with a count. Columns other than the four are ignored. An empty
    table gives no rows.
    """
    counted = (
        rows.select(
            F.col(f"`{conv}`").alias(conv),
            F.col(f"`{turn}`").cast("long").alias("_turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("_role"),
            F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("_text"),
        )
        .groupBy(conv, "_turn", "_role", "_text")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hash", F.md5("_text"))
    )
    counted = materialise(counted, "conversation_rows")
    again = (
        counted.groupBy(conv, "_role", "_hash")
        .agg(F.count(F.lit(1)).alias("_turns"), F.count("_turn").alias("_known"), F.min("_turn").alias("_least"))
        .where("_turns > 1")
        .select(
            F.col(conv).alias("_conv"),
            F.col("_role").alias("_by"),
            F.col("_hash").alias("_what"),
            F.when(F.col("_known") == F.col("_turns"), F.col("_least")).alias("_first"),
        )
    )
    again = materialise(again, "conversation_repeats")
    same = F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("_role") == F.col("_by")) & (F.col("_hash") == F.col("_what"))
    later = F.col("_by").isNotNull() & ~F.col("_turn").eqNullSafe(F.col("_first"))
    fault = (
        F.when(~F.col("_text").rlike(f"[^{WHITE}]"), BLANK)
        .when(later, DUPLICATE)
        .when(~F.col("_text").rlike(rf"[.!?][{WHITE}]*\z"), CUT)
        .otherwise(NONE)
    )
    order: list[Column] = [F.col(conv), F.col("_turn"), F.col("_role")]
    judged = (
        counted.join(again, same, "left")
        .select(conv, "_turn", "_role", "_text", "_n", fault.cast("long").alias("_fault"))
        .repartitionByRange(*order, F.substring("_text", 1, DEALT_CHARS))
        .sortWithinPartitions(*order, "_text")
    )
    segments = materialise(_segments(judged, conv), "conversation_segments")
    gaps = F.coalesce(F.expr("turns[1] - turns[0] + 1 - turns[2]"), F.lit(0).cast("long"))
    columns = [conv, "section", "whole", *COUNTS, "audit", "repaired"]
    short = segments.where("whole").withColumns({"gaps": gaps, "section": F.lit(0).cast("long")}).select(*columns)

    key = text_key(F.col(conv).cast("string"))
    open_ = segments.where("not whole").withColumn("_key", key).drop("cost")
    choices = materialise(_choices(open_), "conversation_choices")
    chosen = open_.drop("audit", "repaired").join(choices, ["part", "segment"])
    chosen = chosen.withColumn("illegal", F.col("illegal") + F.col("more_illegal"))
    return short.unionByName(_resolve(chosen, columns[:-2]))


def digest(sections: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(``conv``, counts, audit, repaired_sha256) of whole conversations from ``repair_conversations``.

    The hash is that of the lines ``role:text`` joined by newlines. A conversation in several
    sections is hashed section by section in their order, so no task holds its texts.
    """
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    lined = sections.withColumn("lines", F.array_join(line, "\n")).withColumn("kept", F.size("repaired") > 0)
    short = lined.where("whole").withColumn("repaired_sha256", F.sha2(F.col("lines"), 256))
    columns = [conv, *COUNTS, "audit", "repaired_sha256"]
    cut = lined.where("not whole").withColumn("_key", text_key(F.col(conv).cast("string")))
    cut = cut.select("_key", conv, "section", *COUNTS, "audit", "kept", "lines")
    cut = cut.repartition("_key").sortWithinPartitions("_key", "section")
    schema = T.StructType([sections.schema[conv], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    schema = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in columns[-2:]]])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, held = None, None, None

        def row() -> pa.RecordBatch:
            value, sums, audits, sha, _ = held
            values = [value, *sums, "".join(audits), sha.hexdigest()]
            kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], columns)

        for batch in batches:
            kind = batch.schema.field(conv).type
            for k in range(batch.num_rows):
                key, value, _, *counts, audit, kept, lines = (c[k].as_py() for c in batch.columns)
                if key != at:
                    if held:
                        yield row()
                    at, held = key, [value, [0] * len(COUNTS), [], hashlib.sha256(), False]
                held[1] = [a + b for a, b in zip(held[1], counts)]
                held[2].append(audit)
                if kept:
                    held[3].update((b"\n" if held[4] else b"") + lines.encode())
                    held[4] = True
        if held:
            yield row()

    return short.select(*columns).unionByName(cut.mapInArrow(join, schema))
