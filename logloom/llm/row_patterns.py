"""Row pattern matching: A (D|U)*? P over each key's rows, in chunks that a tree of summaries ties together.

All rows lie in one order (key, time, id) and are range-split into chunks, so that a huge key
spans many of them. A chunk is summarised as a function of who comes in from the left: whether a
walk of D and U gets through it (state transition) and which rows may end the walk, by the
amount they ask for (goal staircase). Summaries compose, whatever the bracketing, so trees of
small groups give each chunk what lies before and after it. With that, starts whose walk
leaves the chunk are resolved, and each place where a match may end is an entry position whose
chain of resumed searches is followed to the chunk's end; doubling these pointers tells which
entries the search really takes. Nothing but a group of summaries, or one chunk, meets in a task.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, materialise, tidy

#: A chunk has about this many rows; a group of the tree has at most FAN summaries.
CHUNK_ROWS, FAN = 131_072, 64
#: A row follows the one before if it comes at most this many microseconds later.
GAP = 600_000_000
STEPS, GOAL, FILLED = 1, 2, 4


def micros(df: DataFrame, column: str) -> str:
    """SQL for microseconds since 1970 of a time with or without a zone."""
    name = f"`{column}`"
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})" if isinstance(df.schema[column].dataType, T.TimestampNTZType) else f"unix_micros({name})"


def ordered(events: DataFrame, key: str, time: str, row_id: str, kind: str, value: str, chunk_rows: int) -> DataFrame:
    """Distinct rows with key and time, range-split in the order of key, time and id: (key, us, id, cents, flags)."""
    amount = F.floor(F.lit(100.0) * F.col(value).cast("double") + F.lit(0.5))
    filled = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    flags = F.when(F.coalesce(F.col(kind) != "error", F.lit(False)), STEPS).otherwise(0) + F.when(F.coalesce(F.col(kind) == "purchase", F.lit(False)), GOAL).otherwise(0) + F.when(filled, FILLED).otherwise(0)
    plain = [F.to_json(F.col(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in events.schema]
    # Rows that agree in key, time, id and the hash of all columns are equal; a third of all rows may be copies of one, so partial results come before the shuffle.
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("key"), F.expr(micros(events, time)).alias("us"), F.col(row_id).alias("id"), F.xxhash64(*plain).alias("row_hash"), F.when(filled, amount.cast("long")).otherwise(0).alias("cents"), flags.cast("byte").alias("flags")
    )
    order = ["key", "us", "id", "row_hash"]
    return rows.distinct().repartitionByRange(max(1, -(-events.count() // chunk_rows)), *order).sortWithinPartitions(*order).drop("row_hash")


class Chunk:
    """The rows of a chunk, how each follows the one before, and where walks from each end."""

    def __init__(self, keys: list, sizes: np.ndarray, us: np.ndarray, cents: np.ndarray, flags: np.ndarray) -> None:
        self.keys, self.us, self.cents, self.flags, self.n = keys, us, cents, flags, len(us)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        near = np.zeros(self.n, bool)
        near[1:] = (np.diff(us) <= GAP) & (flags[1:] & FILLED > 0) & (flags[:-1] & FILLED > 0)
        near[self.starts] = False
        self.link, self.goal = near & (flags & STEPS > 0), near & (flags & GOAL > 0)
        self.link[1:] &= cents[1:] != cents[:-1]

    def first(self) -> list:
        return [self.keys[0], int(self.us[0]), int(self.cents[0]), int(self.flags[0])]

    def last(self) -> list:
        return [self.keys[-1], int(self.us[-1]), int(self.cents[-1]), int(self.flags[-1])]

    def staircase(self) -> tuple[bool, list[int], list[int]]:
        """For a walk that has taken the first row as a step: whether it gets through, and the goals it meets that ask for more than any before (rows, amounts)."""
        breaks = np.flatnonzero(~self.link[1:])
        stop = int(breaks[0]) + 1 if len(breaks) else self.n - 1  # the last row that the walk can look at
        rows, amounts = [], []
        for k in (np.flatnonzero(self.goal[1 : stop + 1]) + 1).tolist():
            if not amounts or self.cents[k] > amounts[-1]:
                rows.append(k)
                amounts.append(int(self.cents[k]))
        return not len(breaks), rows, amounts

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: the row where a match from it ends (-1: none here), and whether its walk leaves the chunk without one."""
        end = np.full(self.n, -1, np.int64)
        joined = np.flatnonzero(~(self.link | self.goal))  # rows that nothing can be matched across
        edges = np.append(joined, self.n)
        filled = self.flags & FILLED > 0
        goals = np.flatnonzero(self.goal)
        segments = np.unique(np.searchsorted(joined, goals, "right") - 1)
        link, goal, cents = self.link, self.goal, self.cents
        for s in segments.tolist():
            a, b = int(edges[s]), int(edges[s + 1])
            # From right to left, the goals in reach: nearer ones ask for less, as a goal hides later ones that ask for no more.
            asks: list[int] = []
            places: list[int] = []
            for k, linked, is_goal, amount, before in zip(range(b - 1, a, -1), link[a + 1 : b][::-1].tolist(), goal[a + 1 : b][::-1].tolist(), cents[a + 1 : b][::-1].tolist(), cents[a : b - 1][::-1].tolist(), strict=True):
                if not linked:
                    asks.clear()
                    places.clear()
                if is_goal:
                    while asks and -asks[-1] <= amount:
                        asks.pop()
                        places.pop()
                    asks.append(-amount)
                    places.append(k)
                at = bisect_right(asks, -before) - 1
                if at >= 0:
                    end[k - 1] = places[at]
        breaks = np.flatnonzero(~self.link)
        alive = np.arange(self.n) >= (breaks[-1] if len(breaks) else 0)
        return end, alive & filled & (end < 0)

    def labels(self, low: int, high: int, before: int | None) -> str:
        """Letters of the rows low to high of a match; before: the amount of the row before low, None where low is its first row. A last P is the caller's."""
        steps = np.where(np.diff(self.cents[low : high + 1]) < 0, "D", "U")
        head = "A" if before is None else "D" if self.cents[low] < before else "U"
        return head + "".join(steps.tolist())


def meets(left: list, right: list) -> tuple[int | None, bool]:
    """What a walk that has taken the row left finds at the next row: the amount it asks for if it is a goal, and whether it is a step."""
    near = left[0] == right[0] and right[1] - left[1] <= GAP and left[3] & FILLED and right[3] & FILLED
    return right[2] if near and right[3] & GOAL else None, bool(near and right[3] & STEPS and right[2] != left[2])


def top_of(front: list | None, state: dict | None) -> tuple[int | None, bool]:
    """For a walk whose last row is front: the most that a goal in reach asks for, and whether it gets through."""
    if front is None or state is None:
        return None, False
    ask, step = meets(front, state["first"])
    tops = [x for x in (ask, state["top"] if step else None) if x is not None]
    return max(tops, default=None), step and state["through"]


def composed(left: dict | None, right: dict | None) -> dict | None:
    """The summary of two neighbours. Of the staircase only its highest step is needed above the chunks."""
    if left is None or right is None:
        return left or right
    top, through = top_of(left["last"], right) if left["through"] else (None, False)
    tops = [x for x in (left["top"], top) if x is not None]
    return {"at": left["at"], "first": left["first"], "last": right["last"], "through": through, "top": max(tops, default=None)}


def counted(left: dict | None, right: dict | None) -> dict | None:
    """Two neighbours' matches of their last key; one: whether all rows have one key."""
    if left is None or right is None:
        return left or right
    on = right["one"] and right["first"] == left["last"]
    return {"first": left["first"], "last": right["last"], "n": right["n"] + (left["n"] if on else 0), "one": left["one"] and on}


Combine = Callable[[dict | None, dict | None], dict | None]


def load(text: str | None) -> dict | None:
    return json.loads(text) if text else None


def dump(state: dict | None) -> str | None:
    return json.dumps(state) if state is not None else None


def levels(states: DataFrame, combine: Combine, fan: int) -> list[DataFrame]:
    """(at, state) of the chunks, of groups of fan of them, of groups of groups, until one group holds all."""

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        out = None
        for state in [load(x) for _, x in sorted(zip(table["at"].to_pylist(), table["state"].to_pylist(), strict=True))]:
            out = combine(out, state)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([dump(out)], pa.string())})

    found, top = [states], states.agg(F.max("at")).first()[0] or 0
    while top >= fan:
        found.append(materialise(found[-1].groupBy(F.expr(f"at DIV {fan}").alias("g")).applyInArrow(fold, "at long, state string"), "pattern-level"))
        top //= fan
    return found


def scanned(found: list[DataFrame], combine: Combine, fan: int) -> DataFrame:
    """(at, before, after): what all earlier and all later states combine to, null where there are none."""

    def spread(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["at", "state", "before", "after"]).to_pylist(), key=lambda r: r["at"])
        left, right = load(rows[0]["before"]), load(rows[0]["after"])
        befores, afters = [], []
        for row in rows:
            befores.append(dump(left))
            left = combine(left, load(row["state"]))
        for row in reversed(rows):
            afters.append(dump(right))
            right = combine(load(row["state"]), right)
        return pa.table({"at": pa.array([r["at"] for r in rows], pa.int64()), "before": pa.array(befores, pa.string()), "after": pa.array(afters[::-1], pa.string())})

    above = None
    for level in reversed(found):
        level = level.withColumn("g", F.expr(f"at DIV {fan}"))
        level = level.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")}) if above is None else level.join(above.select(F.col("at").alias("g"), "before", "after").hint("shuffle_hash"), "g")
        above = materialise(level.groupBy("g").applyInArrow(spread, "at long, before string, after string"), "pattern-scan")
    return above


def located(queries: DataFrame, found: list[DataFrame], fan: int) -> DataFrame:
    """queries (at, start, cents, front): in which later chunk the walk whose last row is front ends, as (from_at, start, cents, at, front).

    A walk asks its own group first, then the groups of the level above, and so on; where a group
    is known to hold the goal, it asks that group's members from the left.
    """
    schema = "from_at long, start long, cents long, at long, front string, state string"

    def ask(key: tuple, nodes: pa.Table, walks: pa.Table) -> pa.Table:
        rows = sorted(((r["at"], load(r["state"])) for r in nodes.to_pylist()), key=lambda r: r[0])
        out = []
        for walk in walks.to_pylist():
            front, found_at = load(walk["front"]), None
            for at, state in rows:
                if walk["at"] is not None and at <= walk["at"]:
                    continue
                top, _ = top_of(front, state)
                if top is not None and top >= walk["cents"]:
                    found_at = at
                    break
                front = state["last"]
            out.append({**walk, "at": found_at, "front": json.dumps(front), "state": "found" if found_at is not None else "beyond"} | {"g": None})
        columns = {f: [r[f] for r in out] for f in ("from_at", "start", "cents", "at", "front", "state", "g")}
        columns["at"] = [r["at"] if r["state"] == "found" else key[0].as_py() for r in out]
        return pa.table({k: pa.array(columns[k], pa.string() if k in ("front", "state") else pa.int64()) for k in ("from_at", "start", "cents", "at", "front", "state")})

    def asked(level: DataFrame, walks: DataFrame, group: str) -> DataFrame:
        nodes = level.withColumn("g", F.expr(f"at DIV {fan}")).groupBy("g")
        return materialise(walks.withColumn("g", F.expr(group)).groupBy("g").cogroup(nodes).applyInArrow(lambda k, w, n: ask(k, n, w), schema), "pattern-walks")

    done, open_walks, hits = None, queries.select(F.col("at").alias("from_at"), "start", "cents", "at", "front"), []
    for k, level in enumerate(found):  # up: past the groups that hold no goal
        answers = asked(level, open_walks, f"at DIV {fan}")
        hits.append(answers.where("state = 'found'").drop("state"))
        open_walks = answers.where("state = 'beyond'").drop("state")
    for k in range(len(found) - 1, -1, -1):  # down: into the groups that hold one
        here = hits[k] if done is None else hits[k].unionByName(done)
        if k == 0:
            return here
        inner = here.withColumn("g0", F.col("at")).withColumn("at", F.lit(None).cast("long"))
        done = asked(found[k - 1], inner, "g0").drop("state")
    raise AssertionError("no level")


def blob(array: np.ndarray) -> pa.Array:
    return pa.array([array.tobytes()], pa.binary())


def pack(key_kind: pa.DataType, id_kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a partition: its rows in arrays, and its summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        whole = pa.Table.from_batches(kept).combine_chunks()
        runs = pa.compute.run_end_encode(whole["key"].combine_chunks())
        runs = runs if isinstance(runs, pa.RunEndEncodedArray) else runs.chunk(0)
        keys, sizes = runs.values, np.diff(runs.run_ends.to_numpy(), prepend=0).astype(np.int64)
        us, cents, flags = (whole[c].to_numpy().astype(t) for c, t in (("us", np.int64), ("cents", np.int64), ("flags", np.int8)))
        chunk = Chunk(keys.to_pylist(), sizes, us, cents, flags)
        at = TaskContext.get().partitionId()
        through, rows, amounts = chunk.staircase()
        state = {"at": at, "first": chunk.first(), "last": chunk.last(), "through": through, "top": amounts[-1] if amounts else None}
        ids = whole["id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        one = lambda array, kind: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array.cast(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([json.dumps(state)]), one(keys, key_kind), one(ids, id_kind), blob(sizes), blob(us), blob(cents), blob(flags), pa.array([rows], pa.list_(pa.int64())), pa.array([amounts], pa.list_(pa.int64()))],
            names=["at", "state", "keys", "ids", "sizes", "us", "cents", "flags", "stair_rows", "stair_amounts"],
        )

    return run


def unpack(row: dict) -> Chunk:
    kind = {"sizes": np.int64, "us": np.int64, "cents": np.int64, "flags": np.int8}
    return Chunk(row["keys"], *(np.frombuffer(row[c], t) for c, t in kind.items()))


def entrances(front: list | None, chunk_first: list, rows: list[int], amounts: list[int]) -> tuple[list[int], list[int]]:
    """The staircase of a walk whose last row is front, its first row included."""
    if front is None:
        return [], []
    ask, step = meets(front, chunk_first)
    if not step:
        rows, amounts = [], []
    if ask is None:
        return rows, amounts
    skip = bisect_right(amounts, ask)
    return [0, *rows[skip:]], [ask, *amounts[skip:]]


CHAINS = "at long, entry long, to_at long, start long, cents long, front string"


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry position of a chunk: the start whose match leaves the chunk (start, cents), or else the next chunk (to_at) if the key goes on there."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk, before, after = unpack(row), load(row["before"]), load(row["after"])
            goes_on = after is not None and after["first"][0] == chunk.keys[-1]
            entries = [0, *(k + 1 for k in entrances(before and before["last"], chunk.first(), row["stair_rows"], row["stair_amounts"])[0])]
            out = []
            if goes_on:
                top, _ = top_of(chunk.last(), after)
                end, leaves = chunk.ends()
                spans = leaves & (chunk.cents <= top) if top is not None else np.zeros(chunk.n, bool)
                low = int(chunk.starts[-1])  # the search always comes by a key's first row
                where = [-1] * (chunk.n - low + 1)
                for i, e, span in zip(range(chunk.n - 1, low - 1, -1), end[low:][::-1].tolist(), spans[low:][::-1].tolist(), strict=True):
                    where[i - low] = i if span else where[(e if e >= 0 else i) + 1 - low]
                for entry in entries:
                    start = where[max(entry, low) - low]
                    out.append((row["at"], entry, after["at"] if start < 0 else None, start if start >= 0 else None, int(chunk.cents[start]) if start >= 0 else None, json.dumps(chunk.last())))
            else:
                out = [(row["at"], entry, None, None, None, None) for entry in entries]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.string()], strict=True)], names=[x.split()[0] for x in CHAINS.split(", ")])


def emit(key_kind: pa.DataType, id_kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk: its matches, the parts it has of matches that span chunks (span_at, span_start), and one row with its count (state)."""
    names = ["at", "key", "nth", "first_id", "last_id", "n_rows", "sum_cents", "labels", "span_at", "span_start", "state"]
    kinds = [pa.int64(), key_kind, pa.int64(), id_kind, id_kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def each(row: dict) -> list[tuple]:
        chunk, before, after, out, at, ids = unpack(row), load(row["before"]), load(row["after"]), [], row["at"], row["ids"]
        key_of = lambda i: int(np.searchsorted(chunk.starts, i, "right")) - 1
        total = lambda a, b: int(chunk.cents[a : b + 1].sum())
        if row["cover_at"] is not None:  # the middle or the end of a match that began earlier
            last = row["cover_to"] if row["cover_to"] >= 0 else chunk.n - 1
            letters = chunk.labels(0, last, before["last"][2])
            letters = letters[:-1] + "P" if row["cover_to"] >= 0 else letters
            out.append((at, chunk.keys[0], None, None, ids[last] if row["cover_to"] >= 0 else None, last + 1, total(0, last), letters, row["cover_at"], row["cover_start"], None))
        end, leaves = chunk.ends()
        top, _ = top_of(chunk.last(), after)
        inner, spans = np.flatnonzero(end >= 0).tolist(), np.flatnonzero(leaves & (chunk.cents <= top)).tolist() if top is not None else []
        at_row = row["entry"] if row["entry"] is not None else int(chunk.starts[1]) if len(chunk.starts) > 1 else chunk.n
        nth, owner = 0, -1
        while at_row < chunk.n:
            i, j = bisect_left(inner, at_row), bisect_left(spans, at_row)
            a, b = inner[i] if i < len(inner) else chunk.n, spans[j] if j < len(spans) else chunk.n
            start = min(a, b)
            if start == chunk.n:
                break
            nth, owner = (nth + 1 if key_of(start) == owner else 1), key_of(start)
            stop = int(end[start]) if a < b else chunk.n - 1
            letters = chunk.labels(start, stop, None)
            spanning = a > b
            out.append((at, chunk.keys[owner], nth, ids[start], None if spanning else ids[stop], stop - start + 1, total(start, stop), letters if spanning else letters[:-1] + "P", at if spanning else None, start if spanning else None, None))
            at_row = stop + 1
        state = {"first": chunk.keys[0], "last": chunk.keys[-1], "n": nth if owner == len(chunk.keys) - 1 else 0, "one": len(chunk.keys) == 1}
        return [*out, (at, None, None, None, None, None, None, None, None, None, json.dumps(state))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*each(row), strict=True), kinds, strict=True)], names=names)

    return run


def taken_entries(nodes: DataFrame, rounds: int) -> DataFrame:
    """(at, entry) that the search really takes: reachable over (at, entry) -> (to_at, to_entry) from the nodes marked root, by pointer doubling."""
    reached = nodes.where("root").select("at", "entry")
    jump = nodes.where("to_at IS NOT NULL").select("at", "entry", "to_at", "to_entry")
    for k in range(rounds):
        ahead = jump.join(reached.hint("shuffle_hash"), ["at", "entry"], "left_semi").select(F.col("to_at").alias("at"), F.col("to_entry").alias("entry"))
        reached = materialise(reached.unionByName(ahead).distinct(), "pattern-reached")
        if k + 1 < rounds:
            onward = jump.select(F.col("at").alias("to_at"), F.col("entry").alias("to_entry"), F.col("to_at").alias("far_at"), F.col("to_entry").alias("far_entry"))
            jump = materialise(jump.join(onward.hint("shuffle_hash"), ["to_at", "to_entry"]).select("at", "entry", F.col("far_at").alias("to_at"), F.col("far_entry").alias("to_entry")), "pattern-jumps")
    return reached


def find_pattern(events: DataFrame, key: str = "client_id", time: str = "ts", row_id: str = "click_id", kind: str = "kind", value: str = "value", chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Per match of A (D|U)*? P: key, match_no (from 1 a key), first_id, last_id, n_rows, sum_cents, labels (a letter a row).

    A key's distinct rows are taken in the order of time and id; the amount is floor(100 * value
    + 0.5). A takes any row with a value; D and U ones below and above the row before, of a kind
    that isn't null or error; P a purchase of at least A's amount; all but A come at most ten
    minutes after the row before. A match ends at the first P that its D and U lead to. The
    search goes on after a match's last row, else one row further.

    Rows without a key or a time are left out; a null or NaN value fits no letter. Equal rows
    count once; rows that tie in time and id are ordered by a hash of all columns. An empty
    table gives no rows; other columns only tell rows apart, whatever their names.
    """
    key_type, ids_type = id_type(events, key), id_type(events, row_id)
    sorted_rows = ordered(events, key, time, row_id, kind, value, chunk_rows)
    to_arrow = lambda kind: pa.string() if isinstance(kind, T.StringType) else {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind.simpleString()]
    key_kind, id_kind = to_arrow(events.schema[key].dataType), to_arrow(events.schema[row_id].dataType)
    packed = materialise(sorted_rows.mapInArrow(tidy(pack(key_kind, id_kind)), f"at long, state string, keys array<{key_type}>, ids array<{ids_type}>, sizes binary, us binary, cents binary, flags binary, stair_rows array<long>, stair_amounts array<long>"), "pattern-chunks")
    states = packed.select("at", "state")
    tree = levels(states, composed, fan)
    around = scanned(tree, composed, fan)
    chain = materialise(packed.drop("state", "ids").join(around.hint("shuffle_hash"), "at").mapInArrow(tidy(chains), CHAINS), "pattern-chains")
    # Starts whose match ends in a later chunk: which chunk, then which row of its staircase.
    walks = chain.where("start IS NOT NULL").select("at", "start", "cents", "front").distinct()
    stairs = packed.select("at", F.get_json_object("state", "$.first").alias("head"), "stair_rows", "stair_amounts")

    def landing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows, amounts = entrances(json.loads(r["front"]), json.loads(r["head"]), r["stair_rows"], r["stair_amounts"])
                out.append((r["from_at"], r["start"], r["at"], rows[bisect_left(amounts, r["cents"])] + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["at", "start", "goal_at", "goal_entry"])

    landed = materialise(stairs.join(located(walks, tree, fan).hint("shuffle_hash"), "at").mapInArrow(landing, "at long, start long, goal_at long, goal_entry long"), "pattern-landed")
    # A goal that is its chunk's last row lets the search go on in the next chunk: that entry leads there by itself.
    nodes = chain.join(landed.hint("shuffle_hash"), ["at", "start"], "left").join(around.select("at", F.get_json_object("before", "$.last[0]").alias("before_key")).hint("shuffle_hash"), "at").join(states.select("at", F.get_json_object("state", "$.first[0]").alias("first_key"), F.get_json_object("state", "$.last[0]").alias("last_key")).hint("shuffle_hash"), "at")
    # A root is where a key begins: as its chunk's first row, or inside, by which every search of the chunk comes. So no chain to follow is longer than a key.
    begins = ~F.col("before_key").eqNullSafe(F.col("first_key")) | (F.col("first_key") != F.col("last_key"))
    nodes = materialise(nodes.select("at", "entry", "start", "goal_at", "goal_entry", F.coalesce("goal_at", "to_at").alias("to_at"), F.when(F.col("goal_at").isNotNull(), F.col("goal_entry")).when(F.col("to_at").isNotNull(), 0).alias("to_entry"), ((F.col("entry") == 0) & begins).alias("root")), "pattern-nodes")
    longest = states.groupBy(F.get_json_object("state", "$.last[0]").alias("k")).count().agg(F.max("count")).first()[0] or 1
    reached = taken_entries(nodes, int(longest + 1).bit_length())
    spans = nodes.join(reached.hint("shuffle_hash"), ["at", "entry"], "left_semi").where("goal_at IS NOT NULL").select("at", "start", "goal_at", "goal_entry").distinct()
    covers = spans.select(F.col("at").alias("cover_at"), F.col("start").alias("cover_start"), "goal_at", "goal_entry", F.explode(F.sequence(F.col("at") + 1, "goal_at")).alias("at"))
    covers = covers.select("at", "cover_at", "cover_start", F.when(F.col("at") == F.col("goal_at"), F.col("goal_entry") - 1).otherwise(-1).alias("cover_to"))
    # A chunk is entered once, at a goal or at 0; where a key begins inside, 0 is a root too, and the goal counts.
    around = around.join(reached.groupBy("at").agg(F.max("entry").alias("entry")).hint("shuffle_hash"), "at", "left").join(covers.hint("shuffle_hash"), "at", "left")
    schema = f"at long, key {key_type}, nth long, first_id {ids_type}, last_id {ids_type}, n_rows long, sum_cents long, labels string, span_at long, span_start long, state string"
    parts = materialise(packed.drop("state", "stair_rows", "stair_amounts").join(materialise(around, "pattern-around").hint("shuffle_hash"), "at").mapInArrow(tidy(emit(key_kind, id_kind)), schema), "pattern-parts")
    found = parts.where("state IS NULL")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "labels"))), lambda x: x.labels)
    spanning = found.where("span_at IS NOT NULL").groupBy("span_at", "span_start").agg(F.first("key").alias("key"), F.max("nth").alias("nth"), F.max("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"), F.array_join(pieces, "").alias("labels"))
    columns = ["at", "key", "nth", "first_id", "last_id", "n_rows", "sum_cents", "labels"]
    found = found.where("span_at IS NULL").select(columns).unionByName(spanning.select(F.col("span_at").alias("at"), *columns[1:]))
    earlier = scanned(levels(parts.where("state IS NOT NULL").select("at", "state"), counted, fan), counted, fan)
    earlier = earlier.select("at", F.get_json_object("before", "$.last").alias("last_key"), F.get_json_object("before", "$.n").cast("long").alias("n"))
    offset = F.when(F.col("last_key") == F.col("key").cast("string"), F.col("n")).otherwise(0)
    return found.join(earlier.hint("shuffle_hash"), "at").select(F.col("key").alias(key), (F.col("nth") + offset).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")


def pattern_digest(matches: DataFrame) -> DataFrame:
    """The same with the SHA-256 of the labels in their place."""
    return matches.withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")
