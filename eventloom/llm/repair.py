"""Repairs the structure of logged conversations with the fewest edits.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Rows are kept, given another role,
deleted, or empty turns are inserted; the cheapest edits are found by a dynamic program over four states (before the first
turn, after system, after user, after assistant):

1.  Rows are shuffled by conversation and sorted in turn order. Some thousand rows of whole conversations are taken at a
    time and bucketed by length, so that a bucket is one tensor (turn, conversation, state) without much padding.
2.  From the last turn back, the costs of all conversations of a bucket are updated at once, and the costs of every turn are kept.
3.  From the first turn on, the edits of all conversations are traced at once: where several edits are cheapest, that of the least letter.

A conversation of over ``LONG_ROWS`` rows isn't one tensor: it is cut by ranges of turn numbers, each range gives the costs from every
state to every other, these 4 x 4 tables are joined up for the conversation, and then each range is traced by itself. Rows
seen in an earlier range are found by a join. Only the hash of the repaired text, which is sequential by its
nature, reads the edits of one conversation in one stream, of which no more than a row is held.

Defined results: rows are ordered by (turn, role, text), null turns first; null roles and texts count as one space; rows with a
null conversation id form a conversation of their own; a row that repeats all of another is a duplicate; an empty table gives
no rows; other columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

SPACES = "\t\n\x0b\x0c\r "
LONG_ROWS = RANGE_TURNS = 1 << 16
BLOCK_ROWS = 8192

START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = np.array([USER, USER, ASSISTANT, USER])  # the state after an inserted or renamed turn
BIG = 1 << 50
ACCEPT = np.array([0, BIG, BIG, 0])
DELETE_COST, OTHER_ROLE_COST, INSERT_COST, CUT_COST = 4, 3, 3, 3

# A row's kind: its initial (s, u, a, other), 4 more if it is truncated; 8 must go; 9 is no row.
GONE, NONE = 8, 9
FOLLOWS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
DROP = np.array([DELETE_COST] * 9 + [0])
RENAME = np.array([OTHER_ROLE_COST] * 4 + [OTHER_ROLE_COST + CUT_COST] * 4 + [BIG] * 2)
KEEP, KEEP_TO = np.full((10, 4), BIG), np.zeros((10, 4), np.int64)
for (_state, _initial), _next in FOLLOWS.items():
    KEEP[_initial, _state], KEEP[_initial + 4, _state] = 0, CUT_COST
    KEEP_TO[_initial, _state] = KEEP_TO[_initial + 4, _state] = _next

NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by a hash of conversation and turn, and ``lost`` for rows that are dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("code")
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("lost"), "code")
    return rows.withColumn("_copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "code")


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs where turns may be inserted first."""
    out = costs.copy()
    out[..., USER] = np.minimum(costs[..., USER], INSERT_COST + costs[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(costs[..., ASSISTANT], INSERT_COST + costs[..., USER])
    for state in (START, SYSTEM):
        out[..., state] = np.minimum(costs[..., state], INSERT_COST + out[..., USER])
    return out


def backward_costs(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs (turn, conversation, state) to the end, of rows (turn, conversation), given those after the last turn."""
    costs = np.empty((len(kinds) + 1, *ends.shape), np.int64)
    costs[-1] = closed(ends)
    for t in range(len(kinds) - 1, -1, -1):
        k, after = kinds[t], costs[t + 1]
        kept = KEEP[k] + np.take_along_axis(after, KEEP_TO[k], 1)
        costs[t] = closed(np.minimum(np.minimum(DROP[k][:, None] + after, kept), RENAME[k][:, None] + after[:, ADDED]))
    return costs


def traced(kinds: np.ndarray, costs: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least cheapest edits: states after up to two insertions before each turn and at the end (-1: none), a letter for
    each row (0 for none), the state after each row, and the last state."""
    turns, n = kinds.shape
    at, inserted = np.arange(n), np.full((turns + 1, 2, n), -1, np.int8)
    edits, states = np.zeros((turns, n), np.uint8), np.zeros((turns, n), np.int8)
    for t in range(turns + 1):
        stays = ends if t == turns else DROP[kinds[t]][:, None] + costs[t + 1]
        for j in range(2):
            here, to = costs[t][at, state], ADDED[state]
            new = (stays[at, state] != here) & (INSERT_COST + costs[t][at, to] == here)
            inserted[t, j] = np.where(new, to, -1)
            state = np.where(new, to, state)
        if t < turns:
            k, here = kinds[t], costs[t][at, state]
            dropped = stays[at, state] == here
            kept = ~dropped & (KEEP[k, state] + costs[t + 1][at, KEEP_TO[k, state]] == here)
            edits[t] = np.where(k == NONE, 0, np.where(dropped, ord("D"), np.where(kept, ord("K"), ord("R"))))
            state = np.where(dropped, state, np.where(kept, KEEP_TO[k, state], ADDED[state]))
            states[t] = state
    return inserted, edits, states, state


def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of conversations: the turns of the tensor, a power of two, and their places."""
    classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for c in np.unique(classes):
        yield 1 << int(c), np.flatnonzero(classes == c)


def tensor(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, turns: int) -> np.ndarray:
    steps = np.arange(turns)[:, None]
    return np.where(steps < lengths, kinds[np.minimum(starts + steps, len(kinds) - 1)], NONE)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """conv, range (0 but for long conversations), turn, role, text and what can be told from the row: whether it is blank or
    truncated, and its initial."""
    text = F.rtrim("text", F.lit(SPACES))
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.left("role", F.lit(1))).cast("int")
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text",
        (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(initial == 0, 3).otherwise(initial - 1).alias("initial"),
    )


class Block:
    """Whole conversations (or ranges of long ones), one after the other: their rows' kinds and faults."""

    def __init__(self, table: pa.Table):
        self.keys = list(zip(table["conv"].to_pylist(), table["range"].to_pylist(), strict=True))
        n = len(self.keys)
        edges = [i for i in range(n) if not i or self.keys[i] != self.keys[i - 1]]
        self.starts = np.array(edges, np.int64)
        self.lengths = np.diff(np.append(self.starts, n))
        self.roles, self.texts = table["role"].to_pylist(), table["text"].to_pylist()
        again = table["again"].to_pylist()
        seen: set = set()
        new = set(edges)
        for i, row in enumerate(zip(self.roles, self.texts, strict=True)):
            if i in new:
                seen = set()
            again[i] = again[i] or row in seen
            seen.add(row)
        blank, cut = (np.array(table[c].to_pylist(), bool) for c in ("blank", "cut"))
        self.faults = np.where(blank, BLANK, np.where(np.array(again, bool), DUPLICATE, np.where(cut, TRUNCATED, NO_FAULT)))
        self.kinds = np.where((self.faults == BLANK) | (self.faults == DUPLICATE), GONE, np.array(table["initial"].to_pylist(), np.int64) + 4 * (self.faults == TRUNCATED))
        heads = table.take(self.starts)
        self.ends = np.array([ACCEPT if e is None else e for e in heads["ends"].to_pylist()], np.int64).reshape(-1, 4)
        self.begins = np.array([START if b is None else b for b in heads["begin"].to_pylist()], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, part = batch.column("conv"), batch.column("range")
        i = batch.num_rows - 1
        last = (conv[i].as_py(), part[i].as_py())
        while i and (conv[i - 1].as_py(), part[i - 1].as_py()) == last:
            i -= 1
        goes_on = i == 0 and held and (held[-1].column("conv")[-1].as_py(), held[-1].column("range")[-1].as_py()) == last
        if rows + i >= BLOCK_ROWS and rows + i and not goes_on:
            yield Block(pa.Table.from_batches([*held, batch.slice(0, i)]))
            held, rows, batch = [], 0, batch.slice(i)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield Block(pa.Table.from_batches(held))


ROW_COLUMNS = ("conv", "range", "turn", "role", "text", "blank", "cut", "initial", "again", "ends", "begin")
EDITS = "range long, seq long, edit string, fault int, was string, role string, text string"
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW_COLUMNS).repartition("conv", "range").sortWithinPartitions("conv", "range", "turn", "role", "text")


def _edits(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            out: dict[int, list] = {}
            for turns, chosen in by_length(block.lengths):
                starts, lengths, ends = block.starts[chosen], block.lengths[chosen], block.ends[chosen]
                kinds = tensor(block.kinds, starts, lengths, turns)
                inserted, edits, states, _ = traced(kinds, backward_costs(kinds, ends), ends, block.begins[chosen])
                for i, (unit, start, n) in enumerate(zip(chosen.tolist(), starts.tolist(), lengths.tolist(), strict=True)):
                    own = out[unit] = []
                    before, letters, after = inserted[:, :, i].tolist(), edits[:n, i].tobytes().decode(), states[:n, i].tolist()
                    for t in range(n):
                        own += [("I", NO_FAULT, None, ROLES[s], "") for s in before[t] if s >= 0]
                        at, letter = start + t, letters[t]
                        role = None if letter == "D" else block.roles[at] if letter == "K" else ROLES[after[t]]
                        own.append((letter, int(block.faults[at]), block.roles[at], role, None if letter == "D" else block.texts[at]))
                    own += [("I", NO_FAULT, None, ROLES[s], "") for t in range(n, turns + 1) for s in before[t] if s >= 0]
            rows = [(*block.keys[block.starts[unit]], seq, *e) for unit in range(len(block.starts)) for seq, e in enumerate(out[unit])]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema["conv"].dataType), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["conv", *(f.split()[0] for f in EDITS.split(", "))]
    return _in_order(rows).mapInArrow(fix, f"conv {kind}, {EDITS}")


def _through(rows: DataFrame, field: str, of_block) -> DataFrame:
    """``of_block`` (a list of numbers for each range) over ranges of long conversations."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, key = rows.schema["conv"].dataType.simpleString(), to_arrow_type(rows.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = np.zeros((len(block.starts), 16), np.int64)
            for turns, chosen in by_length(block.lengths):
                found[chosen] = of_block(tensor(block.kinds, block.starts[chosen], block.lengths[chosen], turns), block.ends[chosen])
            keys = [block.keys[i] for i in block.starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], key), pa.array([k[1] for k in keys], pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["conv", "range", field])

    return _in_order(rows).mapInArrow(run, f"conv {kind}, range long, {field} array<long>")


def _crossings(kinds: np.ndarray, _ends: np.ndarray) -> np.ndarray:
    """Costs from each state to each other, row by row."""
    n = kinds.shape[1]
    only = [np.where(np.arange(4) == j, 0, BIG) for j in range(4)]
    return np.stack([backward_costs(kinds, np.tile(v, (n, 1)))[0] for v in only], 2).reshape(n, 16)


def _arrivals(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last state for each first one."""
    costs, n = backward_costs(kinds, ends), kinds.shape[1]
    last = [traced(kinds, costs, ends, np.full(n, s))[3] for s in range(4)]
    return np.concatenate([np.stack(last, 1), np.zeros((n, 12), np.int64)], 1)


def _over_ranges(table: DataFrame, field: str, out: str, result: str, step) -> DataFrame:
    """``step`` over the ranges of each conversation, of which there is one row for ``RANGE_TURNS`` turn numbers."""
    kind = table.schema["conv"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range")
        return pd.DataFrame({"conv": pdf["conv"], "range": pdf["range"], out: step([np.array(v) for v in pdf[field]])})

    return table.groupBy("conv").applyInPandas(run, f"conv {kind}, range long, {out} {result}")


def _ends(crossings: list[np.ndarray]) -> list[list[int]]:
    out, after = [], ACCEPT
    for table in reversed(crossings):
        out.append(after.tolist())
        after = np.minimum((table.reshape(4, 4) + after).min(1), BIG)
    return out[::-1]


def _begins(arrivals: list[np.ndarray]) -> list[int]:
    out, state = [], START
    for last in arrivals:
        out.append(state)
        state = int(last[state])
    return out


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on equal keys, null being equal to null."""
    right = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(right, on, "left").drop(*(f"_{k}" for k in keys))


def edited_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of short and of long conversations: conv, range, seq, edit (K, R, D or I), fault, the role that was, and
    role and text after repair (null where deleted). Those of short conversations are in order in their partitions."""
    rows = numbered_rows(rows)
    none = {"again": F.lit(False), "ends": F.lit(None).cast("array<long>"), "begin": F.lit(None).cast("long")}
    long = stored(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_ROWS).select("conv", F.lit(True).alias("_long")), "repair-long")
    short = rows.withColumns({"range": F.lit(0).cast("long"), **none})
    if long.isEmpty():
        return _edits(short), _edits(short.limit(0))
    marked = _joined(rows, long, ["conv"])
    short = marked.where("_long is null").drop("_long").withColumns({"range": F.lit(0).cast("long"), **none})
    cut = marked.where("_long").drop("_long").withColumns({"range": F.coalesce(F.floor(F.col("turn") / RANGE_TURNS), F.lit(-(2**62))), "h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text")})
    places = cut.select("conv", "range", "h1", "h2").distinct()
    later = _joined(places, places.groupBy("conv", "h1", "h2").agg(F.min("range").alias("least")), ["conv", "h1", "h2"]).where("range > least")
    again = _joined(cut, later.drop("least").withColumn("_again", F.lit(True)), ["conv", "range", "h1", "h2"])
    cut = stored(again.select("conv", "range", "turn", "role", "text", "blank", "cut", "initial", F.coalesce("_again", F.lit(False)).alias("again")), "repair-cut")
    empty = {k: v for k, v in none.items() if k != "again"}
    ends = stored(_over_ranges(_through(cut.withColumns(empty), "costs", _crossings), "costs", "ends", "array<long>", _ends), "repair-ends")
    begins = stored(_over_ranges(_through(_joined(cut, ends, ["conv", "range"]).withColumn("begin", empty["begin"]), "states", _arrivals), "states", "begin", "long", _begins), "repair-begins")
    return _edits(short), _edits(_joined(_joined(cut, ends, ["conv", "range"]), begins, ["conv", "range"]))


def _reports(edits: DataFrame) -> DataFrame:
    """Counts, cost, edits and hash of each conversation, whose edits come in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = edits.schema["conv"].dataType.simpleString()
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv", to_arrow_type(edits.schema["conv"].dataType)), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    price = {"K": 0, "R": OTHER_ROLE_COST, "D": DELETE_COST, "I": INSERT_COST}

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def closed_row() -> dict:
            return {"conv": conv, **dict(zip(numbers, state["n"], strict=True)), "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()}

        for batch in batches:
            for name, edit, fault, was, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "fault", "was", "role", "text")), strict=True):
                if state is None or name != conv:
                    if state is not None:
                        done.append(closed_row())
                    conv, state = name, {"n": [0] * 5, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
                n = state["n"]
                if fault:
                    n[fault - 1] += 1
                n[4] += price[edit] + (CUT_COST if fault == TRUNCATED and edit != "D" else 0)
                state["audit"].append(edit)
                if was is not None:
                    if state["last"] is not None and state["last"] + was[:1] not in ("su", "ua", "au"):
                        n[3] += 1
                    state["last"] = was[:1]
                if edit != "D":
                    state["sha"].update((b"\n" if state["any"] else b"") + f"{role}:{text}".encode())
                    state["any"] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed_row()], schema)

    return edits.mapInArrow(report, f"conv {kind}, " + ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, seq, role and text of the repaired conversations. ``rows``: conv_id, turn, role, text without nulls in the last two."""
    short, long = edited_turns(rows)
    return short.unionByName(long).where("edit <> 'D'").select(F.col("conv").alias("conv_id"), "range", "seq", "role", "text")


def repair_reports(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """What was wrong with each conversation and how it was repaired. Rows that are ``lost`` only name their conversation."""
    lost = F.lit(False) if lost is None else lost
    kept = rows.where(~lost).select("conv_id", "turn", "role", "text")
    short, long = edited_turns(kept)
    ordered = long.repartition("conv").sortWithinPartitions("conv", "range", "seq")
    turns = rows.select(F.col("conv_id").alias("conv"), F.when(~lost, F.col("turn").cast("decimal(20,0)")).alias("turn")).distinct()
    gaps = turns.groupBy("conv").agg(F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count("turn")).try_cast("long"), F.lit(0).cast("long")).alias("gaps"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = gaps.unionByName(_reports(short).unionByName(_reports(ordered)), allowMissingColumns=True)
    whole = both.groupBy("conv").agg(*(F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return whole.withColumnRenamed("conv", "conv_id")


def repair_query(conversations: DataFrame) -> DataFrame:
    bounded_batches(conversations.sparkSession)
    return repair_reports(damaged(conversations), F.col("lost"))
