"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of hashes of its word shingles; documents with equal sets form one class.
Classes that can link at all are found first, by prefixes of the sets in the order of the hashes
and then, among what is left, in the order of the tokens' frequencies. These classes are points:
tokens are hashed into groups, and a point is the vector of its group counts. Points are packed
into leaves and leaves into homes, whose boxes hold the largest count of each group. Homes meet
through rare tokens that they share; summed minima of the coordinates bound the overlap of two
homes, then of two leaves, then of two points, and what survives is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, hot_keys, id_type, in_sample, joined_by, map_arrow, materialise, tidy

#: Coordinates of a point: counts of the tokens in this many groups.
AXES = 64
#: A leaf holds about this many points, and fewer if they have more tokens than that.
LEAF, LEAF_TOKENS = 160, 400_000
#: Prefixes are longer than they must be by a share of the set, so that a link shares more than one of their tokens.
SPARE = 16

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words, of the whole sequence; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(h))
    out = h[: len(h) - width + 1] ^ np.uint64(width)
    for k in range(1, width):
        out = mix(out) * M1 + h[k : len(h) - width + 1 + k]
    return np.unique(mix(out))


def class_hashes(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit hashes of a set, null if it is empty."""
    if not len(tokens):
        return None, None
    return int(mix(tokens).sum(dtype=np.uint64).astype(np.int64)), int(mix(tokens ^ M3).sum(dtype=np.uint64).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first tokens are its keys.

    A set of n tokens shares all but at most (100 - percent) % of them with a set that it links
    with. Of two that link, take the one whose prefix ends first: the tokens of its prefix that
    the other set has are in the other's prefix too, and these are all but that share.
    """
    return min(n, (100 - percent) * n // 100 + 1 + n // SPARE)


def least_shared(n: int, percent: int) -> int:
    """The least number of keys that a set of n tokens shares with a set that it links with, whatever that one's size."""
    least = -(-percent * n // 100)  # the smallest set that it can link with
    return max(1, min(1 + least // SPARE, -(-percent * least // 100)))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h, the hash of the text, tells rows without an id apart; with one it is null."""
    return docs.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("h"), F.col(text_col).alias("text"))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Per row: id, h (hash of the text where the id is null), node (hash of the set; null if empty), check (a second hash), n, least, keys."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(text, shingle) for text in batch.column(2).to_pylist()]
            node, check = zip(*map(class_hashes, sets), strict=True)
            keys = [s[: prefix_length(len(s), percent)].astype(np.int64) for s in sets]
            columns = [pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([least_shared(len(s), percent) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "h", "node", "check", "n", "least", "keys"])

        return each

    return map_arrow(identified(docs, id_col, text_col), make, f"id {id_type(docs, id_col)}, h long, node long, check long, n long, least long, keys array<long>")


def shared_keys(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """(key, node, df) of pairs (key, node) whose key df nodes have, two or more.

    One shuffle by key, streamed in its order. Keys that a sample of the rows shows to be very
    frequent do not go through it: they are counted after partial aggregation, and the counts, of
    at most HOT_KEYS keys, go with the function. Any choice of such keys gives the same result.
    """
    hot = hot_keys(sample.select("key"))
    often = pairs.where(hot).distinct()
    counted = sorted((r.key, r.df) for r in often.groupBy("key").agg(F.count("*").alias("df")).collect())  # of at most HOT_KEYS
    hot_key, hot_df = (np.array([r[k] for r in counted], np.int64) for k in range(2))
    seldom = pairs.where(~hot).repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the rows of the last key, which may go on

        def several(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
            many = np.diff(starts, append=len(key))
            df = np.repeat(many, many)
            keep = df > 1
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(df[keep].astype(np.int64))], names=["key", "node", "df"])

        for batch in batches:
            if len(hot_key) and batch.num_rows:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                counted_apart = hot_key[at] == key
                if counted_apart.any():
                    yield batch.append_column("df", pa.array(hot_df[at])).filter(pa.array(counted_apart & (hot_df[at] > 1)))
                    batch = batch.filter(pa.array(~counted_apart))
            if batch.num_rows:
                key, node = (np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest))
                end = int(np.searchsorted(key, key[-1]))
                rest = (key[end:], node[end:])
                if end:
                    yield several(key[:end], node[:end])
        if len(rest[0]):
            yield several(*rest)

    return seldom.unionByName(often).mapInArrow(tidy(run), "key long, node long, df long")


def points(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, check, n, tokens, axes) of the documents in wanted (id, and h if that is null)."""
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & F.col("d.h").eqNullSafe(F.col("w.h"))
    chosen = identified(docs, id_col, text_col).alias("d").join(bounded(wanted.select("id", "h").distinct()).alias("w"), same, "left_semi").select("text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            axes = [np.bincount((s % np.uint64(AXES)).astype(np.int64), minlength=AXES).astype(np.int32) for s in sets]
            node, check = zip(*map(class_hashes, sets), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(axes, pa.list_(pa.int32()))], names=["node", "check", "n", "tokens", "axes"])

        return each

    return map_arrow(chosen, make, "node long, check long, n long, tokens array<long>, axes array<int>")


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the two leaves of a visit, and whether they are one leaf."""
    side = table.column("side").to_numpy()
    alone = table.column("one")[0].as_py() == table.column("two")[0].as_py()
    first = np.flatnonzero(side == 0)
    return first, first if alone else np.flatnonzero(side == 1), alone


def open_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the points of two leaves that may link: summed minima of the counts bound the overlap. Points of one label are passed over."""
    first, second, alone = sides(table)
    n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
    axes = table.column("axes").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    found = []
    for at, a in enumerate(first):
        others = second[at + 1 :] if alone else second
        small, large = np.minimum(n[a], n[others]), np.maximum(n[a], n[others])
        others = others[(100 * small >= percent * large) & (label[a] != label[others])]
        if len(others):
            bound = np.minimum(axes[a], axes[others]).sum(axis=1)
            others = others[bound >= needed(n[a], n[others], percent)]
            found.append((np.full(len(others), a), others))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def leaf_links(table: pa.Table, percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links between the points of a pair of leaves: edges from the smallest node of each component to its others, and how many links each node has."""
    i, j = open_pairs(table, percent)
    if not len(i):
        return [], {}
    node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
    used = np.union1d(i, j)
    tokens = table.column("tokens").take(pa.array(used)).combine_chunks()
    owner = np.repeat(np.arange(len(used)), n[used])
    _, token, many = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = many > 1  # a token of one set only is in no overlap
    column = np.cumsum(shared) - 1
    keep = shared[token]
    owner, token = owner[keep], column[token[keep]]
    by_token = np.argsort(token, kind="stable")
    owner, token = owner[by_token], token[by_token]
    overlap = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, int(shared.sum()), 8_192):  # the sets as columns of 0 and 1, in blocks
        low, high = np.searchsorted(token, [start, start + 8_192])
        rows, at = np.unique(owner[low:high], return_inverse=True)
        block = np.zeros((len(rows), 8_192), np.float32)
        block[at, token[low:high] - start] = 1
        overlap[np.ix_(rows, rows)] += block @ block.T
    a, b = np.searchsorted(used, i), np.searchsorted(used, j)
    common = overlap[a, b].astype(np.int64)
    linked = 100 * common >= percent * (n[i] + n[j] - common)
    counts, parent = {}, list(range(len(used)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        for z in (x, y):
            counts[int(node[used[z]])] = counts.get(int(node[used[z]]), 0) + 1
        parent[root(x)] = root(y)
    groups: dict[int, list[int]] = {}
    for x in range(len(used)):
        groups.setdefault(root(x), []).append(int(node[used[x]]))
    forest = [(hub, x) for group in groups.values() for hub in [min(group)] for x in group if x != hub]
    return forest, counts


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, as one table each, from batches in the order of the keys."""
    pending: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if pending and now != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
            last = now
    if pending:
        yield pa.Table.from_batches(pending)


def rare_keys(point: DataFrame, percent: int) -> DataFrame:
    """(node, n, home, keys) of the points that can link with another.

    The tokens of a set are ordered by how many points have them, and only as many of the rarest
    as a prefix needs become keys; those that no other point has need not be looked for. The home
    is named by the smallest token that is not much more frequent than most of its set, which
    near copies have in common, and the size.
    """
    tokens = point.select(F.explode("tokens").alias("key"), "node")
    met = shared_keys(tokens, tokens.where(in_sample("node")))
    each = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("met")).join(point.select("node", "n"), "node")
    length = F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("n") + F.size("met")
    usual = F.col("met")[F.floor(F.size("met") / 2).cast("int")]["df"] * 4
    of = F.array_min(F.transform(F.filter("met", lambda x: x["df"] <= usual), lambda x: x["key"]))
    each = each.withColumn("length", length.cast("int")).where("length > 0")
    return each.select("node", "n", F.xxhash64(of, F.floor(F.log2("n") * 3)).alias("home"), F.transform(F.slice("met", F.lit(1), F.col("length")), lambda x: x["key"]).alias("keys"))


def packed(point: DataFrame, rare: DataFrame) -> DataFrame:
    """(node, n, axes, home, leaf): each home's points are dealt into leaves of bounded points and tokens."""
    parts = rare.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / LEAF), F.ceil(F.sum("n") / LEAF_TOKENS)).alias("parts"))
    leaf = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("leaf")
    return rare.join(parts, "home").select("node", "home", leaf).join(point.select("node", "n", "axes"), "node").select("node", "n", "axes", "home", "leaf")


def boxes(members: DataFrame, of: str, *more: str) -> DataFrame:
    """(of, more, least, box, low, high): of each leaf or home the smallest size, the largest count on each axis and the range of its points' labels."""
    return members.groupBy(of, *more).agg(F.min("n").alias("least"), F.array(*[F.max(F.col("axes")[k]) for k in range(AXES)]).alias("box"), F.min("label").alias("low"), F.max("label").alias("high"))


def near(percent: int):
    """Whether boxes x and y allow a link that is still looked for: the bound by summed minima, and labels that are not one."""
    reach = F.aggregate(F.zip_with("x.box", "y.box", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    settled = (F.least("x.low", "y.low") == F.greatest("x.high", "y.high"))
    return ~settled & (reach * (100 + percent) >= percent * (F.col("x.least") + F.col("y.least")))


def leaf_pairs(members: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """(one, two): leaves whose points may link, found from the homes down; a leaf is not paired with itself."""
    leaf, home = materialise(boxes(members, "leaf", "home"), "join-leaf-boxes"), materialise(boxes(members, "home"), "join-home-boxes")
    own = leaf.join(home.where("low <> high").select("home"), "home", "left_semi")
    inner = own.alias("x").join(own.alias("y"), (F.col("x.home") == F.col("y.home")) & (F.col("x.leaf") < F.col("y.leaf")) & near(percent)).select(F.col("x.leaf").alias("one"), F.col("y.leaf").alias("two"))
    at = members.select("node", "home", "label").join(rare.select("node", F.explode("keys").alias("key")), "node")
    at = at.groupBy("key", "home").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    apart = at.groupBy("key").agg(F.count("*").alias("homes"), F.min("low").alias("low"), F.max("high").alias("high")).where("homes > 1 AND low <> high").select("key")
    at = materialise(at.join(apart, "key", "left_semi"), "join-keys")
    # Homes whose points with a key are of one component already don't meet by it: a crowd of near copies has many such homes.
    open_ = F.least("a.low", "b.low") != F.greatest("a.high", "b.high")
    homes = at.alias("a").join(at.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.home") < F.col("b.home")) & open_).select(F.col("a.home").alias("one"), F.col("b.home").alias("two")).distinct()
    homes = homes.join(home.alias("x"), F.col("one") == F.col("x.home")).join(home.alias("y"), F.col("two") == F.col("y.home")).where(near(percent)).select("one", "two")
    across = homes.join(leaf.alias("x"), F.col("one") == F.col("x.home")).join(leaf.alias("y"), F.col("two") == F.col("y.home")).where(near(percent)).select(F.col("x.leaf").alias("one"), F.col("y.leaf").alias("two"))
    return inner.unionByName(across)


def candidates(pair: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(one, two, side, node, label): the points that, by their counts alone, may link with a point of the other leaf."""
    of = lambda side, leaf: F.struct(F.lit(side).alias("side"), F.col(leaf).alias("leaf"))
    visits = pair.select("one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array(of(0, "one"))).otherwise(F.array(of(0, "one"), of(1, "two")))).alias("v")).select("one", "two", "v.side", "v.leaf")
    visits = visits.join(members, "leaf").select("one", "two", "side", "node", "n", "axes", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["one", "two"]):
            used = np.unique(np.concatenate(open_pairs(table, percent)))
            if len(used):
                yield from table.select(["one", "two", "side", "node", "label"]).take(pa.array(used)).to_batches()

    return visits.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(tidy(run), "one long, two long, side int, node long, label long")


def verified(chosen: DataFrame, point: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, links): two nodes of one component of two leaves (links 0), or how many links node a has in them (b null)."""
    visits = chosen.join(point.select("node", "n", "tokens", "axes"), "node").select("one", "two", "side", "node", "n", "tokens", "axes", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["one", "two"]):
            forest, counts = leaf_links(table, percent)
            if forest:
                a, b = [x for x, _ in forest] + list(counts), [y for _, y in forest] + [None] * len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(forest) + list(counts.values()), pa.int64())], names=["a", "b", "links"])

    return visits.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(tidy(run), "a long, b long, links long")


def tree_links(members: DataFrame, rare: DataFrame, point: DataFrame, percent: int, count_links: bool) -> DataFrame:
    """Rows (a, b, links) as in verified(): all counts if count_links, else no more than joins each component.

    Without counts a crowd of near copies costs no more than its points: leaves are settled on
    their own, one point of each, that with the most links, is compared with that of its home,
    and leaves are paired only where the components found so far leave something open.
    """
    members = members.withColumn("label", F.col("node"))
    alone = members.select(F.col("leaf").alias("one"), F.col("leaf").alias("two")).distinct()
    found = verified(candidates(alone, members, percent), point, percent)
    if count_links:
        apart = verified(candidates(leaf_pairs(members, rare, percent), members, percent), point, percent)
        return materialise(found.unionByName(apart), "join-links")
    found = materialise(found, "join-inner-links")
    many = found.where("b IS NULL").select(F.col("a").alias("node"), "links")
    first = members.join(many, "node", "left").select("home", "leaf", F.struct(F.coalesce("links", F.lit(0)).alias("links"), "n", "node").alias("best"))
    first = materialise(first.groupBy("home", "leaf").agg(F.max("best").alias("best")), "join-firsts")
    hub = first.groupBy("home").agg(F.max_by("leaf", "best").alias("one"), F.max("best").alias("hub"), F.count("*").alias("leaves")).where("leaves > 1")
    star = first.join(hub, "home").where("leaf <> one").select("one", F.col("leaf").alias("two"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("hub.node")), F.struct(F.lit(1).alias("side"), F.col("best.node")))).alias("v"))
    star = verified(star.select("one", "two", "v.side", "v.node", F.col("v.node").alias("label")), point, percent)
    found = materialise(found.unionByName(star).where("b IS NOT NULL"), "join-star-links")
    labels = components(found)
    members = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    members = materialise(members, "join-labelled")
    rest = verified(candidates(leaf_pairs(members, rare, percent), members, percent), point, percent)
    return materialise(found.unionByName(rest), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each can reach.

    Every round takes the smallest label among neighbours and then the label of the label, and
    ends when nothing changes; tables are written between rounds.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "join-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "join-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.next") == F.col("l.node"), "left").select("s.node", "s.label", F.least("s.next", F.coalesce("l.label", "s.next")).alias("next"))
        jump = materialise(jump, "join-labels")
        changed = jump.where("next <> label").count()
        labels = jump.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows whose node, where several sets have one, is made of both hashes of the set."""
    if clashes is None:
        return rows
    both = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(F.broadcast(clashes.withColumn("clash", F.lit(True))), "node", "left").withColumn("node", both).drop("clash")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """Per row: id, n_shingles, class_id (smallest id with the same set), n_links (other classes that its class links to; null without count_links), component_id (smallest id reachable).

    Rows link when 100 * shared >= percent * all distinct shingles. Rows without words link with
    nothing and have null class_id and 0 shingles. Null ids take part, but name a class or
    component only if all its ids are null; repeated rows fall into one class; an empty table
    gives none; other columns are ignored. Counting the links of a crowd of m distinct near
    copies visits each pair of its leaves; without count_links the cost grows with m.
    """
    rows = materialise(described(docs, id_col, text_col, shingle, percent), "join-sets")
    filled = rows.where("node IS NOT NULL")
    same = materialise(filled.groupBy("node", "check").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("least").alias("least"), F.count("*").alias("copies")), "join-classes")
    clashes = materialise(same.groupBy("node").agg(F.count("*").alias("sets")).where("sets > 1").select("node"), "join-clashes")  # of 2**64 values: next to none
    clashes = clashes if clashes.count() else None
    classes = told_apart(same, clashes).withColumn("h", F.when(F.col("id").isNull(), F.col("h")))
    keys = told_apart(filled, clashes).select("id", "h", "node", F.explode("keys").alias("key"))
    met = shared_keys(keys.select("key", "node"), keys.where(in_sample("id", "h")))
    alive = met.groupBy("node").agg(F.count("*").alias("met")).join(classes, "node").where("met >= least").select("node", "id", "h")
    alive = materialise(alive, "join-alive")
    point = told_apart(points(docs, alive, id_col, text_col, shingle), clashes).join(alive.select("node"), "node", "left_semi").dropDuplicates(["node"])
    point = materialise(point.select("node", "n", "tokens", "axes"), "join-points")
    rare = materialise(rare_keys(point, percent), "join-rare")
    members = materialise(packed(point, rare), "join-members")
    found = tree_links(members, rare, point, percent, count_links)
    labels = components(found.where("b IS NOT NULL"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    # Only linked classes have labels: the others are components of their own.
    linked = labels.join(classes.select("node", "id"), "node").join(counts, "node", "left")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = materialise(linked.join(least, "component").select("node", "component_id", "n_links"), "join-components")
    named = materialise(classes.join(linked, "node", "left").where("copies > 1 OR component_id IS NOT NULL").select("node", F.col("id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"), "join-named")
    # A class of its own names itself; of the others, those with very many copies are broadcast.
    out = joined_by(told_apart(rows, clashes).select("id", "node", F.col("n").alias("n_shingles")), named, "node", "copies")
    own = F.when(F.col("node").isNotNull(), F.col("id"))
    links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("class_id", own).alias("class_id"), links.cast("long").alias("n_links"), F.coalesce("component_id", "class_id", "id").alias("component_id"))
