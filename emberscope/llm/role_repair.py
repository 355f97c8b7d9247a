"""Chat formatting by minimum-cost role repair over an automaton of legal turns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.shared import stage

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
CODES = {n: c for c, n in NAMES.items()}
#: A conversation may open with a system turn; then user and assistant take turns, the user first.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 40
MARKER = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Costs:
    """What a change costs; ``closed`` asks for an assistant turn at the end.  An unknown role fits any turn at ``unknown``."""

    merge: int = 2
    relabel: int = 3
    insert: int = 4
    unknown: int = 1
    closed: bool = True


def steps(role: int, costs: Costs) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """All ways to place one turn: (state before, state after, cost, action, empty turns put before it).

    A turn opens the next legal turn, possibly after one empty turn, or is merged into the turn before it.
    """
    out = []
    for before in (START, SYSTEM, USER, ASSISTANT):
        for after in (SYSTEM, USER, ASSISTANT):
            change = 0 if after == role else costs.relabel if role in NAMES else costs.unknown
            kind = "keep" if after == role else "relabel"
            if after == before:
                out.append((before, after, costs.merge + change, "merge" if after == role else "relabel+merge", ()))
            if after in NEXT[before]:
                out.append((before, after, change, kind, ()))
            else:
                for between in NEXT[before]:
                    if after in NEXT[between] and between != SYSTEM:
                        out.append((before, after, costs.insert + change, f"{kind}+insert", (between,)))
    return out


class Machine:
    def __init__(self, costs: Costs):
        self.steps = {role: steps(role, costs) for role in (START, SYSTEM, USER, ASSISTANT)}
        close = {START: (0, ()), SYSTEM: (2 * costs.insert, (USER, ASSISTANT)), USER: (costs.insert, (ASSISTANT,)), ASSISTANT: (0, ())}
        self.close = close if costs.closed else {s: (0, ()) for s in close}

    def transfer(self, roles: list[int]) -> list[list[int]]:
        """Least cost of a segment of turns from each state to each state."""
        return [self._forward(roles, s)[-1] for s in range(4)]

    def _forward(self, roles: list[int], entry: int) -> list[list[int]]:
        row = [NEVER] * 4
        row[entry] = 0
        rows = [row]
        for role in roles:
            now = [NEVER] * 4
            for before, after, cost, _, _ in self.steps[role]:
                if row[before] + cost < now[after]:
                    now[after] = row[before] + cost
            rows.append(now)
            row = now
        return rows

    def repair(self, roles: list[int], entry: int, leave: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
        """The cheapest steps of a segment from its entry to its exit state; of equal costs, the first listed."""
        rows = self._forward(roles, entry)
        out, state = [], leave
        for i in range(len(roles) - 1, -1, -1):
            for step in self.steps[roles[i]]:
                if step[1] == state and rows[i][step[0]] + step[2] == rows[i + 1][state]:
                    out.append(step)
                    state = step[0]
                    break
        return out[::-1]

    def route(self, tables: list[list[list[int]]]) -> list[tuple[int, int]]:
        """Entry and exit state of each segment on the cheapest way through all of them."""
        row, rows = [0, NEVER, NEVER, NEVER], []
        for table in tables:
            rows.append(row)
            row = [min(row[a] + table[a][b] for a in range(4)) for b in range(4)]
        state = min(range(4), key=lambda s: (row[s] + self.close[s][0], -s))
        out = []
        for table, before in zip(tables[::-1], rows[::-1]):
            entry = min(range(4), key=lambda a: (before[a] + table[a][state], -a))
            out.append((entry, state))
            state = entry
        return out[::-1]


def turn_markup(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


END = "<|end|>\n"


def escaped(text: str) -> str:
    """A text in which no marker can be read: ``<`` before a bar gets a backslash after it, and one more where there are some.

    Taking one backslash away between ``<`` and ``|`` gives the text back.
    """
    return MARKER.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one segment."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and (run[-1]["conv_id"], run[-1]["part"]) != (row["conv_id"], row["part"]):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _transfers(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    machine = Machine(costs)
    known: dict[tuple[int, ...], list[int]] = {}
    rows = []
    for run in _runs(batches):
        roles = tuple(r["role"] for r in run)
        if roles not in known:
            if len(known) > 10_000:
                known.clear()
            known[roles] = [c for row in machine.transfer(list(roles)) for c in row]
        rows.append({"conv_id": run[0]["conv_id"], "part": run[0]["part"], "costs": known[roles]})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _routes(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    machine = Machine(costs)
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            tables = [[s["costs"][4 * a : 4 * a + 4] for a in range(4)] for s in row["segments"]]
            for k, (segment, (entry, leave)) in enumerate(zip(row["segments"], machine.route(tables))):
                rows.append({"conv_id": row["conv_id"], "part": segment["part"], "entry": entry, "leave": leave, "last": k == len(tables) - 1})
        yield pa.RecordBatch.from_pylist(rows, schema)


REPAIRED = "conv_id long, position long, turn long, action string, role string, cost long, rendered string"


def _render(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    machine = Machine(costs)
    schema = pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in REPAIRED.split(", ")])
    rows, size = [], 0
    for run in _runs(batches):
        for row, (before, after, cost, action, added) in zip(run, machine.repair([r["role"] for r in run], run[0]["entry"], run[0]["leave"])):
            text = escaped(row["text"] or "")
            if "merge" in action:
                shown = "\n\n" + text
            else:
                empty = "".join(turn_markup(a) + END for a in added)
                shown = (END if before != START else "") + empty + turn_markup(after) + text
            if row is run[-1] and row["last"]:
                extra, closing = machine.close[after]
                cost += extra
                shown += END + "".join(turn_markup(a) + END for a in closing)
            rows.append((row["conv_id"], row["at"], row["turn"], action, NAMES[after], cost, shown))
            size += len(shown)
        if size > 1 << 20 or len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per turn: conv_id, position, turn, action, role, cost and ``rendered``, its part of the repaired text.

    The parts of a conversation, in the order of ``position``, make up its text; empty turns stand in the
    part of the turn they come before, those at the end in the last one.  A conversation may be of any length:
    its turns are dealt by range into segments, each segment is summed up by its least cost from state to
    state, the few segments of a conversation are chained, and each is then repaired on its own.

    Markers inside a text are escaped (see ``escaped``), so no text can pass for a turn; ``unescaped`` undoes it.

    Turns are ordered by turn (nulls last), role and text.  Roles count without case and outer spaces; null and
    other ones are unknown and fit any turn at a small cost.  Null text is empty; a null conv_id is a
    conversation like another; equal rows are equal turns; other columns are ignored; no rows give no rows.
    """
    name = F.lower(F.trim(F.col("role").cast("string")))
    code = F.coalesce(*[F.when(name == n, F.lit(c)) for n, c in CODES.items()], F.lit(START))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("role"), F.col("text").cast("string").alias("text")
    )
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = stage(ordered.withColumn("at", number).withColumn("part", F.shiftright("at", 33)), "turns")
    keys = ["conv_id", "part"]
    slim = placed.select(*keys, "at", "role").repartition(*keys).sortWithinPartitions(*keys, "at")
    costs_of = slim.mapInArrow(lambda b: _transfers(b, costs), "conv_id long, part long, costs array<long>")
    chained = costs_of.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("segments"))
    states = chained.mapInArrow(lambda b: _routes(b, costs), "conv_id long, part long, entry int, leave int, last boolean")
    states = stage(states, "segment-states").withColumnsRenamed({"conv_id": "c", "part": "p"})
    rows = placed.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "at")
    return rows.mapInArrow(lambda b: _render(b, costs), REPAIRED)


def conversation_texts(repaired: DataFrame) -> DataFrame:
    """conv_id, cost and the whole rendered text, for conversations short enough to be one value."""
    parts = F.sort_array(F.collect_list(F.struct("position", "rendered")))
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))
