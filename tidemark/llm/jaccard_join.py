"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct word shingles. Hashing shingles into groups and counting each
group's members makes the set a point; the overlap of two sets is at most the sum over groups of
the smaller count, so an R-tree over the points finds all pairs that may overlap enough, and the
surviving pairs are verified on their sets.

One tree over all points would not spread over machines, nor prune much: in many dimensions most
points are about equally far apart. So sets first meet by the prefix principle, which loses no
pair: in any fixed order of shingles, two sets of similarity t share one of the first
n - ceil(t n) + 1 of each. Trees are built over those that meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays, components, shared

#: Words to a shingle; similarity as a fraction of integers, so that the comparison is exact.
WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
#: A count vector has 2**k groups, about half of the set's size; k lies in this range.
LEAST_BITS, MOST_BITS = 6, 12
#: Points of a leaf.
LEAF = 32
#: Places where no more sets meet than this are leaves by themselves, of which all pairs are bounded.
SMALL = 16
#: Ids up to this many (16 MB) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Shingles that this many texts of one Arrow batch hold are noted as frequent, and so many of the
#: most frequent ones order the prefixes. Any order gives the same links; this one keeps shingles
#: that many documents share out of the prefixes.
FREQUENT_IN_BATCH, FREQUENT_KEPT = 8, 50_000
#: Sets that meet in one place are compared in blocks of this many, each pair of blocks by itself.
BLOCK = 2048
#: Before all pairs of a larger place are bounded, its sets are compared with so many others of it, in so many rounds.
HUBS, ROUNDS = 3, 3
#: Names that different sets may share before the join gives up.
MOST_RENAMED = 10_000
#: Pairs that a task holds back to pass each on once.
HELD_PAIRS = 1 << 20


def least_overlap(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest overlap of two sets that are similar enough, from their sizes, rounded up."""
    return -((-NUMERATOR * (size + other)) // (NUMERATOR + DENOMINATOR))


class CountTree:
    """An R-tree over count vectors, packed by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points.astype(np.int32), sizes.astype(np.int64)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        points = self.points[rows]
        top = points.max(axis=0)
        low_size, high_size = self.sizes[rows].min(), self.sizes[rows].max()
        if len(rows) <= LEAF:
            return top, low_size, high_size, rows, ()
        if high_size - low_size > (top - points.min(axis=0)).max():
            key = self.sizes[rows]
        else:
            key = points[:, (top - points.min(axis=0)).argmax()]
        order = np.argsort(key, kind="stable")
        half = len(rows) // 2
        return top, low_size, high_size, None, (self._build(rows[order[:half]]), self._build(rows[order[half:]]))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, point) whose bound reaches the least overlap of their sizes."""
        points, sizes = points.astype(np.int32), sizes.astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            (top, low, high, rows, parts), active = stack.pop()
            size = sizes[active]
            fits = (DENOMINATOR * size >= NUMERATOR * low) & (NUMERATOR * size <= DENOMINATOR * high)
            active = active[fits]
            if not len(active):
                continue
            size = sizes[active]
            nearest = np.maximum(low, -(-NUMERATOR * size // DENOMINATOR))
            active = active[np.minimum(points[active], top).sum(axis=1) >= least_overlap(size, nearest)]
            if not len(active):
                continue
            if parts:
                stack += [(part, active) for part in parts]
                continue
            bound = np.minimum(points[active][:, None, :], self.points[rows][None, :, :]).sum(axis=2)
            q, p = np.nonzero(bound >= least_overlap(sizes[active][:, None], self.sizes[rows][None, :]))
            found.append((active[q], rows[p]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes begin with each pattern of k bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (len(hashes) // 2).bit_length()))
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """A vector with fewer groups: neighbours' counts added up."""
    return vector.reshape(groups, -1).sum(axis=1)


def _packed(vector: np.ndarray) -> bytes:
    """A vector as bytes: the width of its counts, then the counts."""
    width = 1 if vector.max() < 256 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def overlap_bound(one: np.ndarray, other: np.ndarray) -> int:
    """The most that two sets can overlap: the sum of the smaller counts, in the coarser of both groupings."""
    groups = min(len(one), len(other))
    return int(np.minimum(folded(one, groups), folded(other, groups)).sum())


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a null or wordless one."""
    for _, _, data, offsets in arrays.blocks(texts):
        hashes, at = arrays.text_shingles(data, offsets, WIDTH)
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            yield np.unique(hashes[a:b])


def names_of(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set of sorted hashes, of BLAKE2b; equal sets share both."""
    both = hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(both, "<i8").tolist())


def node_of(hashes: np.ndarray, renamed: frozenset[int] = frozenset()) -> int:
    """The name that stands for a set: its first one, or its second where different sets share the first."""
    first, second = names_of(hashes)
    return second if first in renamed else first


def text_hash() -> Column:
    """A 64-bit name of a row's text, the same wherever it is computed."""
    return F.xxhash64(F.col("text").cast("string"))


#: A row of a text, or of a shingle that many texts of a batch hold.
_MADE = "doc_id long, text_hash long, n_shingles long, node long, other long, counts binary, h long, n long"


def _members(docs: DataFrame) -> tuple[DataFrame, frozenset[int], tuple[np.ndarray, np.ndarray]]:
    """(doc_id, text_hash, n_shingles, node, other, counts) of every row, the names that different sets share, and the frequent shingles: one pass over the texts.

    Sets are told apart by both names, 128 bits; those whose node is shared, which hardly happens
    below 10**9 texts, go by their second name. The list is as short as that, and its length is checked.
    """
    renamed: frozenset[int] = frozenset()
    while True:
        made = shared.written(_named(docs, renamed), "members")
        members = made.where(F.col("h").isNull()).drop("h", "n")
        clashes = members.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").limit(MOST_RENAMED + 1).collect()
        if not clashes:
            return members, renamed, _frequent(made.where(F.col("h").isNotNull()).select("h", "n"))
        renamed |= {r.node for r in clashes}
        if len(renamed) > MOST_RENAMED:
            raise ArithmeticError("too many sets share a 64-bit name")


def _named(docs: DataFrame, renamed: frozenset[int]) -> DataFrame:
    names = [f.split(" ")[0] for f in _MADE.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen, every = [], set(), [np.zeros(0, np.uint64)]
            for s in text_sets(batch.column(1)):
                first, second = names_of(s)
                rows.append((len(s), second if first in renamed else first, first ^ second, _packed(count_vector(s))))
                if len(s) and first not in seen:  # a shared name only hides a count
                    seen.add(first)
                    every.append(s)
            own = [batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], kinds[2 + i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(rows), pa.int64()) for _ in range(2))], names)
            value, count = np.unique(np.concatenate(every), return_counts=True)
            often = count >= FREQUENT_IN_BATCH
            hints = [value[often].astype(np.int64), count[often].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(hints[0]), k) for k in kinds[:6]), *map(pa.array, hints)], names)

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(arrays.lean(run), _MADE)


def _frequent(hints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, sorted, and how frequent: an ordering hint of bounded size."""
    top = hints.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(FREQUENT_KEPT).toPandas()
    value = top["h"].to_numpy().astype(np.int64).astype(np.uint64)
    order = np.argsort(value)
    return value[order], top["n"].to_numpy().astype(np.int64)[order]


def _prefixes(docs: DataFrame, renamed: frozenset[int], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, node): the shingles of each set's prefix, frequent ones last."""
    value, count = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            nodes, parts = [], []
            for s in text_sets(batch.column(0)):
                if not len(s) or (node := node_of(s, renamed)) in seen:
                    continue
                seen.add(node)
                n = len(s)
                length = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                if len(value):
                    at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                    often = np.where(value[at] == s, count[at], 0)
                    s = s[np.argsort(often, kind="stable")]
                parts.append(s[:length])
                nodes.append(node)
            h = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.array(nodes, np.int64), [len(p) for p in parts]))], ["h", "node"])

    return docs.select("text").mapInArrow(arrays.lean(run), "h long, node long")


def _sets(docs: DataFrame, members: DataFrame, renamed: frozenset[int], nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes, each from the text of one document that has it."""
    ids = members.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("__id")).select("__id").distinct()
    ids = shared.written(ids, "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = list(text_sets(batch.column(0).slice(start, 500)))
                rows = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s, renamed) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(rows), pa.array(np.concatenate(sets).astype(np.int64)))], ["node", "hashes"])

    made = chosen.mapInArrow(arrays.lean(run), "node long, hashes array<long>").join(nodes, "node", "left_semi")
    return shared.written(made.dropDuplicates(["node"]), "sets")


def similar(overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of sizes n and m with this overlap are similar enough; exact in integers."""
    return DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap)


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sizes and then count vectors allow enough overlap, with their sizes."""
    size = lambda x: points.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").where(similar(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")))
    vector = lambda x: points.select(F.col("node").alias(x), F.col("counts").alias(f"counts_{x}"))
    full = sized.join(vector("a"), "a").join(vector("b"), "b").select("a", "b", "n_a", "n_b", "counts_a", "counts_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.array([overlap_bound(_vector(x), _vector(y)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            enough = bound >= least_overlap(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select([0, 1, 2, 3]).filter(pa.array(enough))

    return full.mapInArrow(arrays.lean(run), "a long, b long, n_a long, n_b long")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, renamed: frozenset[int], points: DataFrame) -> DataFrame:
    """Of pairs (a, b) the similar ones: bounded by count vectors first, then by their sets."""
    near = shared.written(_bounded(pairs, points), "near")
    sets = _sets(docs, members, renamed, near.select(F.col("a").alias("node")).distinct().unionByName(near.select(F.col("b").alias("node")).distinct()).distinct())
    whole = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    full = near.join(whole("a"), "a").join(whole("b"), "b")
    overlap = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    return full.where(similar(overlap, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _apart(meeting: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, node, component, __n, low) of the places where sets of different components meet; low: the smallest one there.

    Of places where the very same sets meet (by 128 bits of hash) one is enough.
    """
    labelled = meeting.select("h", "node").join(labels, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    part = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "node"), 16))
    places = labelled.groupBy("h").agg(F.count(F.lit(1)).alias("__n"), F.min("component").alias("low"), F.max("component").alias("high"), part(1).alias("x"), part(2).alias("y"))
    distinct = places.where("low <> high").groupBy("__n", "x", "y").agg(F.min("h").alias("h"), F.first("low").alias("low")).select("h", "__n", "low")
    return labelled.join(distinct, "h").select("h", "node", "component", "__n", "low")


def _hub_pairs(apart: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of the sets of larger places with a few of the same place that are in other components."""
    large = apart.where(F.col("__n") > SMALL)
    draw = Window.partitionBy("h").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    hubs = large.withColumn("__nth", F.row_number().over(draw)).where(F.col("__nth") <= HUBS).select("h", F.col("node").alias("hub"), F.col("component").alias("of"))
    pairs = large.join(hubs, "h").where("component <> of")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _leaf_pairs(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in places that are leaves by themselves."""
    leaves = apart.where(F.col("__n") <= SMALL).groupBy("h").agg(F.collect_list(F.struct("node", "component")).alias("all"))
    one = leaves.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    return one.where("x.node < y.node AND x.component <> y.component").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _tree_pairs(apart: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in larger places that pass the bound of a tree.

    Places where very many sets meet are cut into blocks, and each pair of blocks is searched by
    itself. The same sets often meet in many places, mostly with the same smallest component:
    those go to one task, which passes each pair on once.
    """
    placed = apart.where(F.col("__n") > SMALL).withColumn("__blocks", F.ceil(F.col("__n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int")
    spread = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    spread = spread.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "low")
    ready = spread.join(points.select("node", "n_shingles", "counts"), "node").select("h", "i", "j", "low", "own", "node", "component", "n_shingles", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        for own, node, component, n, counts in _runs(batches):
            sizes = np.array([len(c) for c in counts])
            first, second = own == own.min(), own == own.max()
            for groups in np.unique(sizes).tolist():
                # linked sets differ in size by a quarter at most, so their vectors by one halving
                fits = (sizes == groups) | (sizes == 2 * groups)
                left, right = np.flatnonzero(first & fits), np.flatnonzero(second & fits)
                if not len(left) or not len(right):
                    continue
                tree = CountTree(np.stack([folded(counts[i], groups) for i in left]), n[left])
                q, p = tree.search(np.stack([folded(counts[i], groups) for i in right]), n[right])
                a, b = right[q], left[p]
                some = (component[a] != component[b]) & ((node[a] < node[b]) | (own[a] != own[b])) & ((sizes[a] == groups) | (sizes[b] == groups))
                a, b = node[a[some]], node[b[some]]
                made.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if sum(m.shape[1] for m in made) > 2 * HELD_PAIRS:
                made = [np.unique(np.concatenate(made, axis=1), axis=1)]
                if made[0].shape[1] > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(made[0][0]), pa.array(made[0][1])], ["a", "b"])
                    made = []
        if made:
            rest = np.unique(np.concatenate(made, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1])], ["a", "b"])

    dealt = ready.repartition(shared.partitions(apart.sparkSession), "low", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(arrays.lean(run), "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Groups of equal (h, i, j), of which a block pair's two sides bound the size, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def columns() -> tuple:
        table = pa.Table.from_batches(held)
        return (*(table.column(c).to_numpy() for c in ("own", "node", "component", "n_shingles")), [_vector(c) for c in table.column("counts").to_pylist()])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield columns()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield columns()


def _linked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component) of every row; linked sets share a component.

    Equal sets are one node from the start, so groups of copies cost one set. Where sets meet,
    each is first compared with the smallest of them only, and in larger places then with a few
    others; what that links is one component, and only sets of different components that still
    meet go through the trees. Any two similar sets meet somewhere, so they end in one component.
    """
    plain = shared.texts(docs)
    spark = docs.sparkSession
    members, renamed, frequent = _members(plain)
    # one shuffle by shingle serves the distinct, the count and the smallest node; rows are two numbers wide
    prefixes = _prefixes(plain, renamed, frequent).repartition(shared.partitions(spark), "h").groupBy("h", "node").agg(F.lit(1).alias("one"))
    place = Window.partitionBy("h")
    hubs = prefixes.withColumn("hub", F.min("node").over(place)).withColumn("__n", F.count(F.lit(1)).over(place)).where("__n > 1")
    meeting = shared.written(hubs.select("h", "hub", "node"), "meeting")
    points = members.join(meeting.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n_shingles", "counts")
    points = shared.written(points, "points")
    stars = meeting.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = shared.written(_verified(stars, plain, members, renamed, points), "links")
    found, links, tried = components.components(first), first, stars
    for seed in range(ROUNDS):
        apart = shared.written(_apart(meeting, found), "apart")
        pairs = shared.written(_hub_pairs(apart, seed).join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        more = shared.written(_verified(pairs, plain, members, renamed, points), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components.components(links)
    apart = shared.written(_apart(meeting, found), "apart")
    pairs = _leaf_pairs(apart).unionByName(_tree_pairs(apart, points)).distinct().join(tried, ["a", "b"], "left_anti")
    more = shared.written(_verified(pairs, plain, members, renamed, points), "links")
    if not more.isEmpty():
        found = components.components(links.unionByName(more))
    labelled = members.join(found, "node", "left")
    return labelled.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component"))


def link_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked doc_id, itself included) of every row.

    A null, empty or wordless text has no shingles and links with nothing; null ids link like
    others but never name a component; rows that repeat an id and a text share a component; ties of
    size or hash have no effect on links. A very long text is one row and one set. Other columns
    are not read, so their names cannot clash. An empty table gives an empty result.
    """
    linked = _linked(docs)
    least = linked.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = linked.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class of linked ones, with its own columns, whatever their names: the one of the smallest id.

    A document is an id with a text, so of an id's texts each is judged by itself. Where the
    smallest id has several linked texts, or all ids are null, the smallest hash of a text decides.
    Documents without shingles (null, empty or wordless) stay. Rows that repeat the id and text of a
    kept document stay with it. A very long text is one row. An empty table gives an empty result.
    """
    linked = _linked(docs).where("n_shingles > 0").drop("n_shingles")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    of, by = (shared.unused(docs.columns, c) for c in ("gone_id", "gone_text"))
    gone = linked.join(first, "component").where(~kept).select(F.col("doc_id").alias(of), F.col("text_hash").alias(by)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (text_hash() == F.col(by)), "left_anti")
