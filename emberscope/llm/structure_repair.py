"""Repair of conversation structure with edits of least cost, solved once per shared suffix of all conversations.

Each row becomes one letter that says its role's initial and its first fault, so a conversation is a word and
its edits depend on that word alone.  The words of all conversations are put into an automaton minimised from
the end: sorted by their reversed spelling, words with a common ending follow one another and share its nodes.
Every node holds, for each state of the grammar, the least cost to the end and the edits that reach it.

Conversations of any length are cut into blocks of bounded length.  A block that another one follows is solved
for each state it may leave; the blocks of a conversation are then chained from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.shared import stage

BLOCK_ROWS = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of rows: by role initial (s, u, a, other), without a fault, truncated, blank, duplicate.
SOUND, CUT_OFF, BLANK, DUPLICATE = "suao", "SUAO", "1234", "5678"
#: To the grammar all rows that must go are alike.
GONE = "x"
END, OPEN = "$", "+"
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = (START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT)
NEXT_ROLE = {START: "u", AFTER_SYSTEM: "u", AFTER_USER: "a", AFTER_ASSISTANT: "u"}
REACHED = {"s": AFTER_SYSTEM, "u": AFTER_USER, "a": AFTER_ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
MOST_LONG = (1 << 63) - 1

#: Per grammar state, for each exit: (cost, edits).  Exits are the states a block may end in, or END.
Table = dict[int, dict[object, tuple[int, str]]]


def better(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or b < a else a


def with_inserts(table: Table) -> Table:
    """Let an empty turn come first wherever that is cheaper; a second one may follow, a third never pays."""
    for _ in range(2):
        for state in STATES:
            for exit_, (cost, edits) in list(table[REACHED[NEXT_ROLE[state]]].items()):
                table[state][exit_] = better(table[state].get(exit_), (INSERT + cost, "I" + edits))
    return table


def last_node(marker: str) -> Table:
    """What is left after the last row: at the end only inserts, in an open block nothing, as its successor may insert."""
    if marker == OPEN:
        return {state: {state: (0, "")} for state in STATES}
    return with_inserts({START: {END: (0, "")}, AFTER_SYSTEM: {}, AFTER_USER: {}, AFTER_ASSISTANT: {END: (0, "")}})


def node(letter: str, rest: Table) -> Table:
    """The table of a row's node from that of the node after it."""
    table: Table = {state: {} for state in STATES}

    def offer(state: int, cost: int, edit: str, to: int) -> None:
        for exit_, (more, edits) in rest[to].items():
            table[state][exit_] = better(table[state].get(exit_), (cost + more, edit + edits))

    role, extra = letter.lower(), TRUNCATED if letter in CUT_OFF else 0
    for state in STATES:
        offer(state, DELETE, "D", state)
        if letter == GONE:
            continue
        wanted = NEXT_ROLE[state]
        if role == wanted or (role == "s" and state == START):
            offer(state, KEEP + extra, "K", REACHED[role])
        offer(state, REROLE + extra, "R", REACHED[wanted])
    return with_inserts(table)


def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted reversed words; the path of the word before is kept, so each shared suffix is solved once."""
    path: list[tuple[str, Table]] = []
    for batch in batches:
        rows = []
        for tail in batch.column("tail").to_pylist():
            depth = 0
            while depth < min(len(path), len(tail)) and path[depth][0] == tail[depth]:
                depth += 1
            del path[depth:]
            for letter in tail[depth:]:
                path.append((letter, node(letter, path[-1][1]) if path else last_node(letter)))
            table = path[-1][1]
            best = [{"state": s, "leave": -1 if e == END else e, "cost": c, "edits": x} for s in STATES for e, (c, x) in table[s].items()]
            rows.append({"solved_tail": tail, "best": best})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SOLVED)


BEST = pa.list_(pa.struct([("state", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
SOLVED = pa.schema([("solved_tail", pa.string()), ("best", BEST)])
SOLVED_TYPE = "solved_tail string, best array<struct<state: int, leave: int, cost: long, edits: string>>"


def spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``n`` (how often the row stands there) after the damage that its key draws."""
    key = F.concat(spaced(conversations["conv_id"]), F.lit(":"), spaced(conversations["turn"]))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        spaced(conversations["role"]).alias("role"), spaced(conversations["text"]).alias("text"), (F.crc32(key) % 20).alias("draw"),
    ).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def whole(conversations: DataFrame) -> DataFrame:
    """The same columns without damage."""
    return conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        spaced(conversations["role"]).alias("role"), spaced(conversations["text"]).alias("text"), F.lit(1).cast("long").alias("n"),
    )


ORDER = ["conv_id", "turn", "role", "digest"]  # ascending, nulls first


def letters(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text), without the text: digest, letter of its first row, letter of
    the other ``n - 1``.  Equal rows are counted before they move, so no group of copies meets in a task.
    """
    shown = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn(
        "fault", F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    )
    counted = shown.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("n").alias("n"))
    firsts = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min("turn").alias("least"), (F.count("turn") < F.count("*")).alias("has_null")
    )
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    known = counted.join(firsts, on)
    first = F.when(F.col("has_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    at = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(4)

    def of(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), at, F.lit(1))

    sound = F.when(F.col("fault") == 1, of(CUT_OFF)).otherwise(of(SOUND))
    again = F.when(F.col("fault") == 2, of(BLANK)).otherwise(of(DUPLICATE))
    letter = F.when((F.col("fault") == 2) | ~first, again).otherwise(sound)
    return known.select("conv_id", "turn", "role", "digest", "n", letter.alias("letter"), again.alias("again"))


BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("word", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
])
BLOCKS_TYPE = "conv_id long, at long, word string, first_turn long, last_turn long, turns long"


def cut(batches: Iterable[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows: word, first and last turn and how many different turns; ``at`` rises within a task."""
    out: list[tuple] = []
    conv: object = None
    word: list[str] = []
    first = last = None
    turns = size = at = 0

    def close() -> None:
        nonlocal word, first, last, turns, size
        if word:
            out.append((conv, at, "".join(word), first, last, turns))
        word, first, last, turns, size = [], None, None, 0, 0

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                close()
                conv = row["conv_id"]
            rest, piece = row["n"] - 1, row["letter"]
            while piece:
                if size >= block_rows:
                    close()
                if not size:
                    at += 1
                if row["turn"] is not None and row["turn"] != last:
                    turns, last = turns + 1, row["turn"]
                    first = row["turn"] if first is None else first
                word.append(piece)
                size += len(piece)
                piece = row["again"] * min(rest, block_rows - size if size < block_rows else block_rows)
                rest -= len(piece)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOCKS.types)], schema=BLOCKS)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOCKS.types)], schema=BLOCKS)


def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block of long conversations; blocks come sorted from a conversation's last to its first.

    Of a block only the choice per state is kept, a few bytes for its rows, until the conversation's start is
    known.  Equal costs are settled by the blocks' own edits: none of them starts with another, as each ends
    with the block's last row.
    """
    names = ["conv_id", "at", "state", "leave"]
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("state", pa.int32()), ("leave", pa.int32())])
    rows = (row for batch in batches for row in batch.to_pylist())
    for conv_id, blocks in groupby(rows, key=lambda r: r["conv_id"]):
        to_go: dict[int, int] = {}
        places: list[int] = []
        choices = bytearray()
        for block in blocks:
            best: dict[int, tuple[int, str, int]] = {}
            for way in block["best"]:
                if way["leave"] < 0 or way["leave"] in to_go:
                    option = (way["cost"] + to_go.get(way["leave"], 0), way["edits"], way["leave"])
                    if way["state"] not in best or option < best[way["state"]]:
                        best[way["state"]] = option
            to_go = {state: option[0] for state, option in best.items()}
            places.append(block["at"])
            choices += bytes(best[s][2] % 256 if s in best else 254 for s in STATES)
        state = START
        found = []
        for k in range(len(places) - 1, -1, -1):
            leave = choices[4 * k + state]
            found.append((conv_id, places[k], state, -1 if leave == 255 else leave))
            state = leave
            if len(found) >= 10_000 or k == 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], names=names)
                found = []


FINAL_TYPE = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
FINAL = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FINAL_TYPE.split(", ")])


class Report:
    """Takes a conversation's blocks and then the texts of its rows that may stay, all in order, and sums them up."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.words: list[str] = []
        self.edits: list[str] = []
        self.cost = self.turns = 0
        self.least = self.most = None
        self.sha, self.lines = hashlib.sha256(), 0
        self.waiting: Iterator[str] | None = None

    def block(self, row: dict) -> None:
        self.words.append(row["word"])
        self.edits.append(row["edits"])
        self.cost += row["cost"]
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (row["first_turn"] == self.most)
            self.least = row["first_turn"] if self.least is None else self.least
            self.most = row["last_turn"]

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def actions(self) -> Iterator[str]:
        """What becomes of each text row that comes in: K, R or D; writes inserted turns and new roles on the way."""
        letters_, state = (x for word in self.words for x in word), START
        for edit in (x for piece in self.edits for x in piece):
            if edit == "I":
                role = NEXT_ROLE[state]
                self.line(ROLES[role], "")
                state = REACHED[role]
                continue
            letter = next(letters_)
            if letter in BLANK or letter in DUPLICATE:
                continue
            yield edit if edit != "R" else NEXT_ROLE[state]
            if edit != "D":
                state = REACHED[letter.lower() if edit == "K" else NEXT_ROLE[state]]

    def text(self, row: dict) -> None:
        self.waiting = self.waiting or self.actions()
        action = next(self.waiting)
        if action != "D":
            self.line(row["role"] if action == "K" else ROLES[action], row["text"])

    def result(self) -> tuple:
        for _ in self.waiting or self.actions():
            raise ValueError(f"conversation {self.conv_id}: a row has no text")
        word = "".join(self.words)
        roles = word.translate(str.maketrans(CUT_OFF + BLANK + DUPLICATE, SOUND * 3))
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, MOST_LONG)
        return (
            self.conv_id, gaps, sum(map(word.count, BLANK)), sum(map(word.count, DUPLICATE)), sum(map(word.count, CUT_OFF)),
            sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])), self.cost, "".join(self.edits), self.sha.hexdigest(),
        )


def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now: Report | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    out.append(now.result())
                now = Report(row["conv_id"])
            if row["kind"] == 1:
                now.block(row)
            elif row["kind"] == 2:
                now.text(row)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FINAL.types)], schema=FINAL)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FINAL.types)], schema=FINAL)


def solved_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, at, word, first_turn, last_turn, turns, edits and cost of every block; ``at`` gives their order."""
    ordered = stage(letters(rows), "turn-letters").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    blocks = ordered.mapInArrow(lambda b: cut(b, block_rows), BLOCKS_TYPE).withColumn(
        "at", F.shiftleft(F.spark_partition_id().cast("long"), 36) + F.col("at")
    )
    blocks = stage(blocks, "turn-blocks")
    by_place = Window.partitionBy("conv_id").orderBy("at")
    last = F.lead("at").over(by_place).isNull()
    word = F.translate("word", BLANK + DUPLICATE, GONE * 8)
    blocks = blocks.withColumn("alone", last & F.lag("at").over(by_place).isNull()).withColumn(
        "tail", F.concat(F.when(last, END).otherwise(OPEN), F.reverse(word))
    )
    blocks = stage(blocks, "turn-words")
    words = blocks.select("tail").distinct().repartitionByRange("tail").sortWithinPartitions("tail")
    solved = stage(words.mapInArrow(solve, SOLVED_TYPE), "solved-words")
    joined = blocks.join(solved, F.col("tail") == F.col("solved_tail")).drop("tail", "solved_tail")
    alone = joined.where("alone").withColumns({"state": F.lit(START), "leave": F.lit(-1)})
    several = joined.where("NOT alone")
    chained = several.select("conv_id", "at", "best").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    routes = stage(chained.mapInArrow(chain, "conv_id long, at long, state int, leave int"), "block-routes")
    routes = routes.withColumnsRenamed({"conv_id": "c", "at": "p"})
    long_ = several.join(routes, F.col("at") == F.col("p")).drop("c", "p")
    way = F.filter("best", lambda b: (b["state"] == F.col("state")) & (b["leave"] == F.col("leave")))[0]
    return alone.unionByName(long_).select("conv_id", "at", "word", "first_turn", "last_turn", "turns", way["edits"].alias("edits"), way["cost"].alias("cost"))


def repair(conversations: DataFrame, damaged: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``damaged`` applies the damage of ``damage`` first.  Rows are ordered by turn (nulls first), role and the
    SHA-256 of their text; equal rows stand next to each other, and all but the first are duplicates.  Null roles
    and texts are one space, so such texts are blank; a role counts by its first character, and an empty or other
    one fits no turn; a null conv_id is a conversation like another; conversations that lose all rows have
    zeros, no audit and the hash of nothing; other columns are ignored; no rows give no rows.  Numbers of gaps
    beyond a long are the greatest long.

    Texts of equal rows, blank rows and later duplicates stay where they are read.  The hash of a conversation
    is one SHA-256, so its remaining texts pass through one task, in order and in a stream; audit is one value
    by contract.  Everything else is done on rows or blocks dealt by range.
    """
    rows = damage(conversations) if damaged else whole(conversations)
    blocks = solved_blocks(rows, block_rows)
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    texts = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("conv_id", "role", "text").agg(
        F.min("turn").alias("least"), (F.count("turn") < F.count("*")).alias("has_null")
    )
    texts = texts.select(
        "conv_id", F.lit(2).alias("kind"), F.when(~F.col("has_null"), F.col("least")).alias("turn"), "role",
        F.unhex(F.sha2("text", 256)).alias("digest"), "text",
    )
    stream = (
        ids.withColumn("kind", F.lit(0))
        .unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(texts, allowMissingColumns=True)
    )
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at", *ORDER[1:]).mapInArrow(report, FINAL_TYPE)
