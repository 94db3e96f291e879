"""Suffix-array dedup: repeated byte strings found by a hash-compared suffix sort.

Every string of the given length has one anchor, its k-gram with the smallest hash, so equal
strings have equal anchors at equal offsets and only occurrences of one anchor are compared.
The suffixes that start at an anchor are sorted by a mergesort in which two suffixes are
compared through prefix polynomial hashes: a binary search finds their common extension, so a
comparison takes a logarithmic number of steps. Runs of common extensions in suffix order,
joined with hashes of what stands left of the anchor, give the equal strings, whose bytes are
then compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hot_keys, id_type, in_sample, joined_by, map_arrow, materialise, materialise_parts, one_of, shuffles_dropped, tidy
from .jaccard_join import M1, M3, mix

LENGTH, GRAM = 100, 24
#: Long texts are searched in blocks of this many bytes (overlapping by a string's length); at most 2**20.
BLOCK = 1 << 19
#: Suffixes are sorted in batches of about this many, and crowds of one anchor are dealt in parts of about CROWD.
BATCH, CROWD = 40_000, 1_000
#: Texts and contexts go through shuffles in up to SLICES slices, one after the other, of so many bytes and rows at least: that bounds the disk.
SLICES, SLICE_BYTES, SLICE_ROWS = 4, 128 * 1024 * 1024, 1_000_000
LOW = np.uint64((1 << 20) - 1)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * M1)


@lru_cache(2)
def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base = int(M3) | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(count, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(key, packed) of the anchors of all strings of the length: packed holds the anchor's place and how far before it its first and last strings start."""
    keys, packed = [], []
    up, down = powers(BLOCK + length)
    width = length - gram + 1
    for at in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        n = len(block)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[block] * up[:n], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        place = np.arange(len(h), dtype=np.uint64)
        least = (h & ~LOW) | (LOW - place)  # the last of equal ones
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        chosen = (LOW - (least & LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        pos = chosen[first]
        keys.append(h[pos])
        packed.append((pos + at) << 16 | (pos - first) << 8 | (pos - last))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(packed)


def text_hash(seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")))


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with node, a number for each text, and the hashes of docs, written.

    A 64-bit hash that stands for several texts, as next to none do, is replaced by another one
    of theirs; a second hash finds it.
    """
    hashed = docs.select("id", text_hash().alias("node"), text_hash(1).alias("check"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    hashed = materialise(hashed, "suffix-texts")
    clash = [r.node for r in hashed.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node").collect()]  # of 2**64 values
    other = lambda node, check: F.when(node.isin(clash), check).otherwise(node) if clash else node
    return docs.withColumn("node", other(text_hash(), text_hash(1))), hashed.withColumn("node", other(F.col("node"), F.col("check"))).drop("check")


def meeting_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, node, packed) of the anchors that occur at two places or more in distinct texts.

    They are streamed in key order. Very frequent ones, as a sample shows them, do not go through
    that shuffle but are counted after partial aggregation; which these are changes no result.
    """
    rows = docs.where(F.octet_length("text") >= length)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [anchors(x.encode(), length, gram) for x in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), [len(k) for k, _ in found])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(node, pa.int64()), pa.array(np.concatenate([p for _, p in found]))], names=["key", "node", "packed"])

        return each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = np.zeros((3, 0), np.int64), False

        def several(rows: np.ndarray, end: bool) -> pa.RecordBatch:
            nonlocal held, met
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)  # copies of a text have equal rows
            rows = rows[:, new]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.zeros(rows.shape[1], bool)
            keep[1:] |= same
            keep[:-1] |= same
            if met:
                keep[0] = True
            if not end:
                met, held, rows, keep = bool(keep[-1]), rows[:, -1:], rows[:, :-1], keep[:-1]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, keep]], names=["key", "node", "packed"])

        for batch in batches:
            if batch.num_rows:
                yield several(np.concatenate([held, np.array([batch.column(k).to_numpy() for k in range(3)])], axis=1), False)
        if held.shape[1]:
            yield several(held, True)

    schema = "key long, node long, packed long"
    hot = hot_keys(map_arrow(rows.where(in_sample("id", "node")).select("node", "text"), make, schema))
    found = map_arrow(rows.select("node", "text"), make, schema)
    often = materialise(found.where(hot).distinct(), "suffix-often")
    met_often = one_of("key", [r.key for r in often.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").collect()])  # of at most HOT_KEYS
    seldom = found.where(~hot).repartition("key").sortWithinPartitions("key", "node", "packed").mapInArrow(tidy(run), schema)
    return seldom.unionByName(often.where(met_often))


class Suffixes:
    """Suffixes that start at anchors, in groups, with what stands left of them; rows of a matrix of bytes.

    Column left is the anchor; a row is filled from reach[0] bytes before it to reach[1] bytes after.
    """

    def __init__(self, group: np.ndarray, content: pa.Array, before: np.ndarray, after: np.ndarray, left: int, right: int) -> None:
        self.group, self.after, self.left = group, after, left
        flat, offsets = np.frombuffer(content.buffers()[2], np.uint8), np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content)].astype(np.int64)
        column = np.arange(left + right)
        index = offsets[:, None] + column - (left - before)[:, None]
        inside = (column >= (left - before)[:, None]) & (column < (left + after)[:, None])
        self.bytes = np.where(inside, flat[np.clip(index, 0, max(len(flat) - 1, 0))], 0).astype(np.uint8) if len(flat) else np.zeros((len(group), left + right), np.uint8)
        up = powers(BLOCK + LENGTH)[0]
        value = BYTES[self.bytes]
        n = len(group)
        self.prefix = np.zeros((n, right + 1), np.uint64)
        np.cumsum(value[:, left:] * up[:right], axis=1, out=self.prefix[:, 1:])
        self.suffix = np.zeros((n, left + 1), np.uint64)  # hash of the bytes left of the anchor, by how many
        np.cumsum((value[:, :left] * up[1 : left + 1][::-1])[:, ::-1], axis=1, out=self.suffix[:, 1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y: binary search over equal prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.after[x], self.after[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.prefix[x, middle] == self.prefix[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Is suffix x before y (or equal, where told so)?"""
        k = self.extension(x, y)
        x_ends, y_ends = k >= self.after[x], k >= self.after[y]
        last = self.bytes.shape[1] - 1
        by_byte = self.bytes[x, np.minimum(self.left + k, last)] < self.bytes[y, np.minimum(self.left + k, last)]
        return np.where(x_ends, np.where(y_ends, or_equal, True), np.where(y_ends, False, by_byte))

    def sort(self) -> np.ndarray:
        """Order of the suffixes within their groups: bottom-up mergesort of all groups at once.

        In a merge every suffix finds its rank in the sibling run by binary search; group must
        be ascending.
        """
        n = len(self.group)
        order = np.arange(n)
        if not n:
            return order
        starts = np.flatnonzero(np.diff(self.group, prepend=self.group[0] - 1))
        size = np.diff(np.append(starts, n))
        base, many = np.repeat(starts, size), np.repeat(size, size)
        local = np.arange(n) - base
        width = 1
        while width < size.max():
            at = np.flatnonzero(many > width)  # groups with more than one run left
            run, inside = local[at] // width, local[at] % width
            sibling = (run ^ 1) * width
            length = np.clip(many[at] - sibling, 0, width)
            low, high = np.zeros(len(at), np.int64), length.copy()
            right = run % 2 == 1
            for _ in range(int(width).bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                other = order[base[at[open_]] + sibling[open_] + middle]
                before = self.less(other, order[at[open_]], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = base[at] + np.minimum(run, run ^ 1) * width + inside + low
            merged = order.copy()
            merged[target] = order[at]
            order = merged
            width *= 2
        return order


    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and how many bytes each suffix has in common with the one before it in its group (-1: the first); both by the bytes themselves.

        Where hashes have misled the sort, the suffixes are sorted once more, by their bytes.
        """
        for again in (False, True):
            x, y = order[:-1], order[1:]
            a, b = self.bytes[x, self.left :], self.bytes[y, self.left :]
            column = np.arange(a.shape[1])
            differ = (a != b) | (column >= np.minimum(self.after[x], self.after[y])[:, None])
            k = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
            inner = self.group[x] == self.group[y]
            at = np.minimum(k, a.shape[1] - 1)[:, None]
            ends = k >= self.after[x]
            sorted_ = ends | (~(k >= self.after[y]) & (np.take_along_axis(a, at, 1) < np.take_along_axis(b, at, 1))[:, 0])
            if again or (sorted_ | ~inner).all():
                break
            rows = range(len(order))
            order = np.array(sorted(rows, key=lambda i: (self.group[i], self.bytes[i, self.left : self.left + self.after[i]].tobytes(), i)), np.int64)
        return order, np.concatenate([[-1], np.where(inner, k, -1)])


def repeated(s: Suffixes, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """repeated[i, o]: an earlier row of the group holds the same string that starts o bytes before the anchor.

    Rows stand in order of appearance. Row i's strings start from last[i] (fewest) to first[i]
    bytes before its anchor.
    """
    n, most = len(first), s.left
    out = np.zeros((n, most + 1), bool)
    if not n:
        return out
    order, common = s.neighbours(s.sort())
    for o in range(most + 1):
        run = np.cumsum(common < length - o)
        here = (last[order] <= o) & (o <= first[order])
        rows = order[here]
        if len(rows) < 2:
            continue
        mark = mix(s.suffix[rows, o] + mix(run[here].astype(np.uint64) * M1 + M3))
        by = np.lexsort((rows, mark))
        rows, mark = rows[by], mark[by]
        start = np.flatnonzero(np.diff(mark, prepend=~mark[0]))
        earliest = np.repeat(rows[start], np.diff(np.append(start, len(rows))))
        again = rows != earliest
        rows, earliest = rows[again], earliest[again]
        window = slice(s.left - o, s.left - o + length)
        true = (s.bytes[rows, window] == s.bytes[earliest, window]).all(axis=1) & (s.group[rows] == s.group[earliest])
        out[rows[true], o] = True
        for i in rows[~true]:  # a hash stood for two strings: look at the bytes of all earlier rows
            mine = np.flatnonzero((s.group == s.group[i]) & (last <= o) & (o <= first))
            mine = mine[mine < i]
            out[i, o] = (s.bytes[mine, window] == s.bytes[i, window]).all(axis=1).any()
    return out


def intervals(pos: np.ndarray, flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that flagged strings cover, one for each run of flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, pos[row] - (high - 1), pos[row] - low + length


def sliced(rows: DataFrame, column: str, size: int, least: int) -> list[DataFrame]:
    """rows in slices by a number column: as many as size holds least, at least one and at most SLICES."""
    many = max(1, min(SLICES, -(-size // least)))
    return [rows.where(F.pmod(F.col(column), F.lit(many)) == k) for k in range(many)] if many > 1 else [rows]


def with_texts(docs: DataFrame, sizes: DataFrame, names: DataFrame, found: DataFrame, length: int) -> list[DataFrame]:
    """found (node, id and more) with text, in slices; names are its nodes and sizes (node, n_bytes) those of all rows.

    Texts without a node among names don't go through the shuffle, where names can be broadcast; else one shuffle is all there is.
    """
    rows, few = docs.where(F.octet_length("text") >= length), bounded(names)
    if few is not names:
        rows, sizes = rows.join(few, "node", "left_semi"), sizes.join(few, "node", "left_semi")
    size = sizes.where(F.col("n_bytes") >= length).agg(F.sum("n_bytes")).first()[0] or 0
    more = [F.col(f"l.{c}") for c in found.columns if c not in ("node", "id")]
    return [part.alias("d").join(found.alias("l"), (F.col("d.node") == F.col("l.node")) & F.col("d.id").eqNullSafe(F.col("l.id"))).select("d.id", "d.node", "d.text", *more) for part in sliced(rows, "node", size, SLICE_BYTES)]


def anchor_lists(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, found, id) of the texts with meeting anchors: found lists (key, part, packed), where part is over 0 parts of crowds."""
    crowd = bounded(materialise(met.groupBy("key").agg(F.ceil(F.count("*") / CROWD).alias("parts")).where("parts > 2"), "suffix-crowds"))
    dealt = met.join(crowd, "key", "left").select("key", "node", "packed", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node", "packed"), F.col("parts"))).cast("int").alias("part"))
    return dealt.groupBy("node").agg(F.collect_list(F.struct("key", "part", "packed")).alias("found")).join(classes.select("node", "id"), "node")


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """(key, part, id, node, packed, content) of each meeting anchor in rows (id, node, text, found): the bytes of all its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one document at a time: its strings are several times its size
                found = batch.column(3).slice(i, 1).flatten()
                packed = found.field("packed").to_numpy()
                text = batch.column(2)[i].as_py().encode()
                pos = packed >> 16
                low, high = (pos - (packed >> 8 & 255)).tolist(), (pos - (packed & 255) + length).tolist()
                for at in range(0, len(found), BATCH):
                    piece = slice(at, at + BATCH)
                    take = pa.array([i] * len(low[piece]), pa.int32())
                    yield pa.RecordBatch.from_arrays([found.field("key").slice(at, BATCH), found.field("part").slice(at, BATCH), batch.column(0).take(take), batch.column(1).take(take), pa.array(packed[piece]), pa.array([text[a:b] for a, b in zip(low[piece], high[piece], strict=True)], pa.binary())], names=["key", "part", "id", "node", "packed", "content"])

    return rows.mapInArrow(tidy(run), f"key long, part int, id {id_type(rows, 'id')}, node long, packed long, content binary")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.Table]:
    """Rows in batches that end where (key, part) changes."""
    pending: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if pending and rows >= most:
            change = np.flatnonzero((key != pending[-1].column(0)[-1].as_py()) | (part != pending[-1].column(1)[-1].as_py()))
            cut = int(change[0]) if len(change) else len(key)
            pending.append(batch.slice(0, cut))
            if cut < len(key):
                yield pa.Table.from_batches(pending)
                pending, rows = [], 0
            batch = batch.slice(cut)
        while batch.num_rows > most:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((key[most:] != key[most - 1 : -1]) | (part[most:] != part[most - 1 : -1]))
            if not len(change):
                break
            cut = most + int(change[0])
            yield pa.Table.from_batches([*pending, batch.slice(0, cut)])
            pending, rows, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            pending.append(batch)
            rows += batch.num_rows
    if pending:
        yield pa.Table.from_batches(pending)


def compare(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (node, start, end, id, string): bytes to remove (string null), or strings of crowds that are first in their part."""
    left, kind = length - gram, rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            table = table.combine_chunks()
            key, part, node, packed = (table.column(c).to_numpy() for c in ("key", "part", "node", "packed"))
            fresh = np.ones(len(key), bool)  # repeated rows of a document
            fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1]) | (packed[1:] != packed[:-1])
            if not fresh.all():
                table = table.filter(pa.array(fresh)).combine_chunks()
                key, part, node, packed = key[fresh], part[fresh], node[fresh], packed[fresh]
            content = table.column("content").chunk(0)
            pos, first, last = packed >> 16, packed >> 8 & 255, packed & 255
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            # Equal contexts hold equal strings: the first stays for the sort, the others go whole.
            same = table.select(["key", "part", "content"]).append_column("off", pa.array(first)).append_column("row", pa.array(np.arange(len(key))))
            lead = same.group_by(["key", "part", "off", "content"]).aggregate([("row", "min")]).column("row_min").to_numpy()
            is_lead = np.zeros(len(key), bool)
            is_lead[lead] = True
            copies = np.flatnonzero(~is_lead)
            ids = table.column("id").chunk(0)
            out = [(node[copies], (pos - first)[copies], (pos - last)[copies] + length)]
            # A group of one context needs no sort, unless it is part of a crowd.
            rest = np.flatnonzero(is_lead & ((np.bincount(group, is_lead)[group] > 1) | (part >= 0)))
            if len(rest):
                suffixes = Suffixes(group[rest], content.take(pa.array(rest)), first[rest], length - last[rest], left, length)
                flags = repeated(suffixes, first[rest], last[rest], length)
                row, start, end = intervals(pos[rest], flags, length)
                out.append((node[rest][row], start, end))
            nodes, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(starts), pa.array(ends), pa.nulls(len(nodes), ids.type), pa.nulls(len(nodes), pa.binary())], names=["node", "start", "end", "id", "string"])
            if len(rest) and (crowd := part[rest] >= 0).any():
                offset = np.arange(left + 1)
                lone = ~flags & (offset >= last[rest][:, None]) & (offset <= first[rest][:, None]) & crowd[:, None]
                row, off = np.nonzero(lone)
                for at in range(0, len(row), BATCH):
                    r, o = row[at : at + BATCH], off[at : at + BATCH]
                    strings = [suffixes.bytes[a, left - b : left - b + length].tobytes() for a, b in zip(r, o, strict=True)]
                    start = pos[rest][r] - o
                    yield pa.RecordBatch.from_arrays([pa.array(node[rest][r]), pa.array(start), pa.array(start + length), ids.take(pa.array(rest[r])), pa.array(strings, pa.binary())], names=["node", "start", "end", "id", "string"])

    order = [F.col("key"), F.col("part"), F.col("id").asc_nulls_last(), F.col("node"), F.col("packed")]
    return rows.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(tidy(run), f"node long, start long, end long, id {kind}, string binary")


def crowd_repeats(found: DataFrame) -> DataFrame:
    """Of strings that are first in parts of crowds, (node, start, end) of those that are not first of all."""
    strings = found.where("string IS NOT NULL").select("node", "start", "end", "string", F.struct(F.col("id").isNull().alias("no_id"), "id", "node", "start").alias("place"))
    first = strings.groupBy("string").agg(F.min("place").alias("first"), F.count("*").alias("many")).where("many > 1")
    return strings.join(first, "string").where("place > first").select("node", "start", "end")


def removed_spans(docs: DataFrame, hashed: DataFrame, classes: DataFrame, length: int, gram: int) -> DataFrame:
    """(node, spans): for texts in which strings are repeated from earlier, the intervals to remove, not merged."""
    met = materialise(meeting_anchors(docs, length, gram), "suffix-anchors")
    lists = materialise(anchor_lists(met, classes), "suffix-lists")
    places = materialise_parts([contexts(rows, length) for rows in with_texts(docs, hashed.select("node", "n_bytes"), lists.select("node"), lists, length)], "suffix-contexts")
    found = materialise_parts([compare(rows, length, gram) for rows in sliced(places, "key", met.count(), SLICE_ROWS)], "suffix-repeats")
    spans = found.where("string IS NULL").select("node", "start", "end").unionByName(crowd_repeats(found))
    return spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def removed_facts(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hashes of docs (id, text), their classes (node, id, copies), and (node, removed, kept, cut) of texts of which bytes go; all written."""
    docs, hashed = told_apart(docs)
    classes = materialise(hashed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "suffix-classes")
    spans = materialise(removed_spans(docs, hashed, classes, length, gram), "suffix-spans")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            removed, kept, cut = [], [], []
            for i in range(batch.num_rows):
                text, found = batch.column(1)[i].as_py().encode(), batch.column(2).slice(i, 1).flatten()
                spans, digest, at = merged(found.field("start").to_numpy(), found.field("end").to_numpy()), hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                removed.append(sum(b - a for a, b in spans))
                kept.append(digest.hexdigest())
                cut.append([{"start": a, "end": b} for a, b in spans])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["node", "removed", "kept", "cut"])

        return each

    rows = with_texts(docs, hashed.select("node", "n_bytes"), spans.select("node"), spans.join(classes.drop("copies"), "node"), length)
    facts = [map_arrow(part.select("node", "text", "spans"), make, "node long, removed long, kept string, cut array<struct<start:long,end:long>>").dropDuplicates(["node"]) for part in rows]
    return hashed, classes, materialise_parts(facts, "suffix-facts")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_spans: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with_spans: spans (start, end) of the bytes removed.

    A byte goes if a string of length bytes that covers it also starts earlier: in a row with a
    smaller id (nulls are the largest; of one id, the text with the smaller hash is first), or
    earlier in the same text. Null and empty texts have no bytes; rows equal in id and text are
    one document and have equal results; an empty table gives none; other columns are ignored.
    length - gram must be at most 255.
    """
    with shuffles_dropped(docs.sparkSession):
        hashed, classes, facts = removed_facts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), length, gram)
        out = joined_by(hashed, classes.withColumnRenamed("id", "first").join(facts, "node", "left"), "node", "copies")
    whole = (F.col("n_bytes") >= length) & ~F.col("id").eqNullSafe(F.col("first"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = out.select(F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, all_of_it).otherwise(F.coalesce("cut", none)).alias("spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
    out = out.withColumn("n_spans", F.size("spans").cast("long"))
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans"] if with_spans else []))
