"""Cheapest repair of conversations, solved once for every shared suffix of their signatures.

A row's signature is one letter for its role's initial and its fault; a conversation's signature is cut, from its
end, into blocks of at most ``BLOCK`` letters, so that one with very many rows lies in many small rows. All different
blocks of all conversations, sorted from their ends, form the automaton: two blocks that end alike share the nodes of
that end. A node is made once, from the node behind it, and keeps for each of the four states of the grammar
``(s?(ua)+)?`` (nothing yet, after s, after u, after a) the cost to go, the best edits to go and the state they leave.
Sorted input needs only the nodes of the block at hand; a range of the sort is a task of its own.

What a block costs depends on what follows it only through the costs to go at its end, its border. The last block's
border is the grammar's. For conversations of several blocks the automaton first gives each block's costs between
states; a scan from the end then yields the borders, the automaton solves each (block, border), and a scan from the
start picks the state. Of equal costs the edits that are least as text win: different options of a node begin with
different letters (Delete, Insert, Keep, Rerole), so the first letter decides.

Texts are read in one sorted stream for each conversation, because the SHA-256 of its repaired text is one stream.
The stream holds the conversation's edits, one letter each (they are a cell of the result), and one row.

Cases: a null role or text is one space (the text is blank); a null conv_id is a conversation; rows are taken by
turn, null turns first, and rows of one turn by role, then by the hash of their text, which also puts repeated rows
next to each other; empty texts are blank, very long ones are read whole; conversations that ``all_ids`` names and
that have no row get zeros, no edits and the hash of nothing; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.running import by_range, scan
from quillmark.functions.shared import materialise
from quillmark.llm.common import hinted

BLOCK = 1024
SMALL = 200_000  # solved blocks up to which they are sent to every task
SPACE = " \t\n\x0b\x0c\r"
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
NEVER = 1 << 40
#: For each state (nothing yet, s, u, a): the letter an assistant or user row must have, and the state after it.
WANTED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
FULL = {"u": "user", "a": "assistant"}
#: Costs to go, edits to go and state at the end of a conversation.
END = ((0, "", 0), (6, "II", 3), (3, "I", 3), (0, "", 3))
_SOLVED = "border string, tail string, states array<struct<cost: long, edits: string, state: int>>"


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the faults that a checksum of conversation and turn calls for."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text, role = spaced("text"), spaced("role")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind != 0")
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), hurt.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def read_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text")).withColumn(
        "sha", F.unhex(F.sha2("text", 256)))


def judged(rows: DataFrame) -> DataFrame:
    """Narrow rows with ``behind`` (rows after it), their first fault, and whether the next role may follow."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    key, order = ["conv_id"], ["turn", "role", "sha", "tie"]
    narrow = read_rows(rows).select(
        "conv_id", "turn", "role", "sha", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("tie"))
    placed = materialise(scan(
        by_range(narrow, key, order), key, order,
        {"behind": ("sum", F.lit(1)), "following": ("last", F.col("initial"))}, inclusive=False, backward=True), "turns")
    same = placed.groupBy("conv_id", "role", "sha").agg(F.count("*").alias("times"), F.max("behind").alias("first"))
    again = hinted(materialise(same.filter("times > 1").select(
        F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "first"), "said-again"), SMALL)
    both = placed.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (
        F.col("sha") == F.col("_s")), "left")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("behind") < F.col("first"), "duplicate")
        .when(F.col("cut"), "truncated"))
    pair = F.concat("initial", "following")
    return both.select(
        "conv_id", "turn", "initial", "behind", fault.alias("fault"),
        (F.col("following").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"))


def counts(rows: DataFrame) -> DataFrame:
    def faults(name: str) -> Column:
        return F.count(F.when(F.col("fault") == name, 1)).alias(name)

    names = ("blank", "duplicate", "truncated")
    turns = rows.groupBy("conv_id", F.col("turn").cast("long").alias("turn")).agg(
        *map(faults, names), F.count(F.when(F.col("illegal"), 1)).alias("illegal"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(n).alias(n) for n in (*names, "illegal")])


def signatures(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, tail): the letters of each block from its end; block 0 is a conversation's last."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    own = F.floor(F.col("behind") / block).cast("long")
    gathered = F.array_sort(F.collect_list(F.struct("behind", letter.alias("letter"))))
    return rows.groupBy("conv_id", own.alias("block")).agg(F.array_join(gathered["letter"], "").alias("tail"))


def before(node: tuple, letter: str) -> tuple:
    """The node of a suffix with one more row in front: for each state the cheapest, then least, edits."""
    kind = letter.lower()
    extra = TRUNCATED if letter != kind else 0
    out = []
    for state, (wanted, after) in enumerate(WANTED):
        options = [(COSTS["D"], "D", state)]
        if kind != "d":
            options.append((COSTS["R"] + extra, "R", after))
            if kind == wanted:
                options.append((extra, "K", after))
            elif kind == "s" and state == 0:
                options.append((extra, "K", 1))
        out.append(min((cost + node[to][0], edit + node[to][1], node[to][2]) for cost, edit, to in options))
    return with_inserts(out)


def with_inserts(out: list[tuple]) -> tuple:
    for _ in range(3):  # after three inserts a state would come back
        for state, (_, after) in enumerate(WANTED):
            cost, edits, to = out[after]
            out[state] = min(out[state], (cost + COSTS["I"], "I" + edits, to))
    return tuple(out)


def border_node(border: str) -> tuple:
    """The node behind a block: the grammar's end, or nothing more to do at the given costs."""
    return END if border == "end" else tuple((int(c), "", state) for state, c in enumerate(border.split(",")))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry nodes of blocks sorted by (border, tail): only the nodes behind the first new letter are made anew."""
    last, tail, nodes = None, "", []
    for batch in batches:
        borders, tails = (c.to_pylist() for c in batch.columns)
        states = []
        for border, now in zip(borders, tails, strict=True):
            if border != last:
                last, tail, nodes = border, "", [border_node(border)]
            shared = len(os.path.commonprefix((tail, now)))
            del nodes[shared + 1 :]
            for letter in now[shared:]:
                nodes.append(before(nodes[-1], letter))
            tail = now
            states.append([{"cost": c, "edits": e, "state": s} for c, e, s in nodes[-1]])
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(borders, pa.string()), pa.array(tails, pa.string()), pa.array(states, kind)],
            ["border", "tail", "states"])


def automaton(blocks: DataFrame) -> DataFrame:
    return materialise(
        blocks.select("border", "tail").distinct().repartitionByRange("border", "tail")
        .sortWithinPartitions("border", "tail").mapInArrow(solve, _SOLVED), "automaton")


def scan_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The border of each block, from the end of a conversation, and what it leaves out (its least cost)."""
    border, offset = [], 0
    for batch in batches:
        found = []
        for block, costs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if block == 0:
                border, offset = [c for c, _, _ in END], 0
            found.append(("end" if block == 0 else ",".join(map(str, border)), offset))
            if costs:  # there is an earlier block
                border = [min(m + b for m, b in zip(costs[s], border, strict=True)) for s in range(4)]
                low = min(border)
                border, offset = [b - low for b in border], offset + low
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([b for b, _ in found], pa.string()), pa.array([o for _, o in found], pa.int64())],
            ["conv_id", "block", "tail", "border", "offset"])


def scan_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block, from the start of a conversation; its first block also says what all of them cost."""
    state, left = 0, 0
    for batch in batches:
        edits, costs = [], []
        for block, offset, states in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            first = left == 0  # block 0 ended the conversation before
            here = states[0 if first else state]
            costs.append(here["cost"] + offset if first else None)
            edits.append(here["edits"])
            state, left = here["state"], block
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(edits, pa.string()), pa.array(costs, pa.int64())],
            ["conv_id", "block", "edits", "cost"])


def _cost_from(state: int):
    return lambda way: way["states"][state]["cost"]


def plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, edits, cost) of judged rows; the cost stands in a conversation's first block."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = materialise(signatures(rows, block), "blocks")
    later = materialise(blocks.filter("block > 0").select(
        F.col("conv_id").alias("_c"), (F.col("block") - 1).alias("_b")), "later-blocks")
    if later.isEmpty():
        bordered = blocks.withColumns({"border": F.lit("end"), "offset": F.lit(0).cast("long")})
    else:  # costs from state to state of the blocks that have one in front
        on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
        marked = blocks.join(later, on, "left").select("conv_id", "block", "tail", F.col("_b").isNotNull().alias("inner"))
        # one border for each state the block may be left in, in the order of the states
        leave = [",".join("0" if i == j else str(NEVER) for i in range(4)) for j in range(4)]
        ways = automaton(marked.filter("inner").select("tail", F.explode(F.array(*map(F.lit, leave))).alias("border")))
        by_exit = F.array_sort(F.collect_list(F.struct("border", "states")))
        lines = ways.groupBy("tail").agg(by_exit.alias("ways")).select(
            "tail", F.array(*[F.transform("ways", _cost_from(state)) for state in range(4)]).alias("costs"))
        joined = marked.join(hinted(materialise(lines, "block-costs"), SMALL), "tail", "left").select(
            "conv_id", "block", "tail", F.when(F.col("inner"), F.col("costs")).alias("costs"))
        bordered = materialise(
            joined.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
                scan_borders, f"conv_id {kind}, block long, tail string, border string, offset long"), "borders")
    solved = automaton(bordered)
    return bordered.join(hinted(solved, SMALL), ["border", "tail"]).select("conv_id", "block", "offset", "states").repartition(
        "conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(
        scan_states, f"conv_id {kind}, block long, edits string, cost long")


class _Mending:
    """One conversation: its edits, the state of the grammar and the running hash of its repaired lines."""

    def __init__(self, conv: object):
        self.conv, self.edits, self.at, self.state, self.lines, self.hash = conv, [], 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: bytes, after: int) -> None:
        self.hash.update(b"\n" * (self.lines > 0) + role.encode() + b":")
        self.hash.update(text)
        self.lines, self.state = self.lines + 1, after

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            wanted, after = WANTED[self.state]
            self.line(FULL[wanted], b"", after)
            self.at += 1

    def row(self, role: str, text: bytes) -> None:
        if not self.at:
            self.edits = "".join(self.edits)
        self.inserts()
        edit, (wanted, after) = self.edits[self.at], WANTED[self.state]
        self.at += 1
        if edit == "K":
            self.line(role, text, 1 if role[0] == "s" else after)
        elif edit == "R":
            self.line(FULL[wanted], text, after)

    def close(self) -> tuple:
        self.inserts()
        return self.conv, self.edits, self.hash.hexdigest()


def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from sorted rows: its edits first, then its turns."""
    now, reading, kind = None, False, None
    for batch in batches:
        done, kind = [], batch.schema.field(0).type
        for conv, edits, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if edits is None:
                now.row(role, text)
                reading = True
                continue
            if reading or now is None:
                if now:
                    done.append(now.close())
                now, reading = _Mending(conv), False
            now.edits.append(edits)
        yield _mended(done, kind)
    if now:
        yield _mended([now.close()], kind)


def _mended(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d[i] for d in done], t) for i, t in enumerate((kind, pa.string(), pa.string()))],
        ["conv_id", "audit", "repaired_sha256"])


def mended(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the edits of ``plans`` applied to the rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = read_rows(rows).select(
        "conv_id", F.lit(1).alias("step"), F.lit(0).cast("long").alias("place"), "turn", "role", "sha",
        F.lit(None).cast("string").alias("edits"), F.col("text").cast("binary").alias("text"))
    ahead = edits.select(
        "conv_id", F.lit(0).alias("step"), F.negative("block").alias("place"),
        *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "sha")], "edits",
        F.lit(None).cast("binary").alias("text"))
    return turns.unionByName(ahead).repartition("conv_id").sortWithinPartitions(
        "conv_id", "step", "place", "turn", "role", "sha").select("conv_id", "edits", "role", "text").mapInArrow(
        mend, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, all_ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    narrow = materialise(judged(rows), "judged-turns")
    edits = materialise(plans(narrow, block), "edits")
    found = counts(narrow).withColumnRenamed("conv_id", "_a")
    cost = edits.groupBy(F.col("conv_id").alias("_b")).agg(F.sum("cost").alias("cost"))
    text = mended(rows, edits).withColumnRenamed("conv_id", "_c")
    ids = (all_ids if all_ids is not None else rows).select("conv_id").distinct()
    joined = ids
    for part, name in ((found, "_a"), (cost, "_b"), (text, "_c")):
        joined = joined.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    return joined.select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
