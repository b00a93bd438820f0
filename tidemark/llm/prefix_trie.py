"""Prefix trie of conversations by distributed radix partitioning, most significant turn first.

Turns become numbers of a dictionary. Conversations are dealt into buckets by their next turns, from
the root down; a bucket with more than a partition's share of the turns is dealt again, round by
round, by as many turns as it takes, until its parts are small. Small buckets are each finished in
one task, by multikey quicksort, whose recursion emits their nodes.

Buckets that are dealt again are the trie's spine: fewer than the partitions at each depth, so the
driver keeps them and adds up what lies beneath. A conversation that is alone in a bucket of such a
size is a chain, and is emitted turn by turn where its turns lie. No conversation is ever one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, shared

#: Turns of the first round's digit; later rounds double it, up to the most.
DIGIT, MOST_DIGIT = 4, 64
#: Buckets with no more turns and conversations than this are local, whatever a partition's share.
LOCAL = 256
#: Turns that a task sorts at once (and what is left of the last bucket).
SLICE_ROWS = 1 << 15
#: Ids that are joined to one piece of text before the pieces of a node meet.
PIECE_IDS = 512
#: Conversations c take their first turns from c - c % FAMILY: crc32(c) % TURNS of them.
FAMILY, TURNS = 20, 4

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()


def inherited(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return F.crc32(conv.cast("string")) % TURNS


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv, part, idx, tid, words): turns with their place among a conversation's turns in one of many sorted parts, and their number in the dictionary of all (role, text).

    The dictionary's keys are 128 bits of SHA-256 of role and text.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))
    turns = shared.written(rows, "trie-turns")
    counted = turns.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    dictionary = shared.written(counted.withColumn("tid", F.monotonically_increasing_id()), "trie-dictionary")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            at = np.arange(len(conv))
            idx = at - np.maximum.accumulate(np.where(new, at, 0))
            if conv[0] == last:
                same = len(conv) if len(first := np.flatnonzero(new[1:])) == 0 else first[0] + 1
                idx[:same] += held
            last, held = conv[-1], int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(idx.astype(np.int64)), batch.column(1), batch.column(2)], ["conv", "part", "idx", "digest", "words"])

    # the last key lets equal rows of one turn lie in several parts
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("any")]
    spread = turns.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(shared.partitions(spark), *order)
    placed = spread.sortWithinPartitions(*order).select("conv", "digest", "words").mapInArrow(arrays.lean(numbered), "conv long, part int, idx long, digest binary, words int")
    return shared.looked_up(shared.written(placed, "trie-places"), dictionary, ["digest"], "n").select("conv", "part", "idx", "tid", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, tid, words) of the rebuilt conversations, and (conv, n, start): their number and the first one's pos."""
    spark = conversations.sparkSession
    rows = shared.written(encoded(conversations), "trie-encoded")
    spans = shared.written(rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), "trie-spans")
    # conversations over the border of parts: each part begins with one of them at most
    first = spans.groupBy("part").agg(F.min("conv").alias("conv")).select("conv").distinct()
    offsets, so_far = [], {}
    for r in sorted(spans.join(F.broadcast(first), "conv").collect(), key=lambda r: (r.conv, r.part)):
        if so_far.get(r.conv):
            offsets.append((r.conv, r.part, so_far[r.conv]))
        so_far[r.conv] = so_far.get(r.conv, 0) + r.n
    before = spark.createDataFrame(offsets, "conv long, part int, before long")
    turns = rows.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("idx") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "words")

    heir, h = F.col("conv") % FAMILY != 0, inherited(F.col("conv"))
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < TURNS - 1)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("head"))
    lengths = spans.groupBy("conv").agg(F.sum("n").alias("len")).withColumn("h", F.when(heir, h).otherwise(0)).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    with_head = lengths.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,tid:long,words:int>>")), F.lit(1), F.col("h").cast("int")))
    sequences = shared.written(
        with_head.select("conv", "head", (F.size("head") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("n"), (F.col("h") - F.size("head")).alias("start")), "trie-sequences"
    )
    taken = sequences.select("conv", "start", F.explode("head").alias("t")).select("conv", (F.col("start") + F.col("t.pos")).alias("pos"), "t.tid", "t.words")
    own = turns.where(~heir | (F.col("pos") >= h))
    return shared.written(own.unionByName(taken), "trie-rebuilt"), sequences.select("conv", "n", "start")


class Spine:
    """The nodes whose buckets are dealt again; by (conv_id, depth)."""

    def __init__(self) -> None:
        self.parent: dict[tuple[int, int], int | None] = {}
        self.size: dict[tuple[int, int], int] = {}
        self.words: dict[tuple[int, int], int] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.leaves: dict[tuple[int, int], int] = {}
        self.saved: dict[tuple[int, int], int] = {}

    def add(self, key: tuple[int, int], parent: int | None, size: int, words: int) -> None:
        self.parent[key], self.size[key], self.words[key] = parent, size, words

    def beneath(self, key: tuple[int, int], leaves: int, saved: int) -> None:
        self.leaves[key] = self.leaves.get(key, 0) + leaves
        self.saved[key] = self.saved.get(key, 0) + saved

    def rows(self) -> list[tuple]:
        """All nodes, with their subtrees added up from the deepest."""
        out = []
        for key in sorted(self.parent, key=lambda k: -k[1]):
            children = self.children.get(key, 0)
            self.beneath(key, int(children == 0), (self.size[key] - 1) * self.words[key])
            if self.parent[key] is not None:
                self.beneath((self.parent[key], key[1] - 1), self.leaves[key], self.saved[key])
            out.append((*key, self.parent[key], self.size[key], children, self.leaves[key], self.saved[key]))
        return out


_SORTED = "conv long, n long, start long, node long, shared long, next long, state string"


def _sorter(found: dict[tuple, int | None], depth: int, digit: int):
    """How far each conversation goes down the spine; found: by bucket and turns, the node's conv_id, none for a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, n, start, bucket, tids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node, k, state = bucket, 0, None
                while k < len(tids) and (key := (bucket, *tids[: k + 1])) in found:
                    if found[key] is None:
                        state = "chain"
                        break
                    node, k = found[key], k + 1
                state = state or ("ended" if n == depth + k else "live" if k == digit else "local")
                out.append((conv, n, start, node, depth + k, tids[k] if k < len(tids) else None, state))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.string() if i == 6 else pa.int64()) for i in range(7)], [f.split(" ")[0] for f in _SORTED.split(", ")])

    return run


def _rounds(turns: DataFrame, sequences: DataFrame, spine: Spine) -> tuple[list[DataFrame], list[tuple[int, int, int]]]:
    """Deal the buckets, round by round: what each conversation came to, and the chains as (conv, depth, parent)."""
    spark = turns.sparkSession
    whole = sequences.agg(F.min("conv"), F.count(F.lit(1)), F.sum(F.col("n") + 1)).first()
    least = max(LOCAL, whole[2] // shared.partitions(spark))
    spine.add((whole[0], 0), None, whole[1], 0)
    live, depth, digit, done, chains = sequences.withColumn("bucket", F.lit(whole[0])), 0, DIGIT, [], []
    while live is not None:
        window = turns.where((F.col("pos") >= depth) & (F.col("pos") < depth + digit + TURNS - 1))
        near = window.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("near"))
        digits = F.slice(F.filter("near", lambda t: t["pos"] >= F.col("start") + depth), 1, digit)
        heads = live.join(near, "conv", "left").withColumn("digits", F.coalesce(digits, F.array().cast("array<struct<pos:long,tid:long,words:int>>")))
        heads = shared.written(heads.select("conv", "n", "start", "bucket", F.col("digits.tid").alias("tids"), F.col("digits.words").alias("words")), "trie-heads")
        each = heads.where(F.size("tids") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("tids"))).alias("k"))
        nodes = each.groupBy("bucket", F.slice("tids", F.lit(1), F.col("k")).alias("key")).agg(
            F.min("conv").alias("conv"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") - depth - F.col("k") + 1).alias("weight"), F.first(F.element_at("words", F.col("k"))).alias("words")
        )
        nodes = shared.written(nodes, "trie-nodes")
        large = sorted(nodes.where(F.col("weight") > least).collect(), key=lambda r: len(r.key))
        found: dict[tuple, int | None] = {}
        ups = {(r.bucket, ()): (r.bucket, depth) for r in live.select("bucket").distinct().collect()}
        for r in large:
            key, up = (r.bucket, *r.key), (r.bucket, tuple(r.key[:-1]))
            if up not in ups:
                continue  # further down a chain
            parent = ups[up]
            if r.m == 1:
                found[key] = None
                chains.append((r.conv, parent[1] + 1, parent[0]))
                spine.beneath(parent, 1, 0)
            else:
                found[key] = r.conv
                ups[(r.bucket, tuple(r.key))] = (r.conv, parent[1] + 1)
                spine.add((r.conv, parent[1] + 1), parent[0], r.m, r.words)
        parents = F.broadcast(spark.createDataFrame([(b, list(k)) for b, k in ups], "bucket long, up array<long>"))
        children = nodes.withColumn("up", F.slice("key", F.lit(1), F.size("key") - 1)).groupBy("bucket", "up").agg(F.count(F.lit(1)).alias("children"))
        for r in children.join(parents, ["bucket", "up"]).collect():
            spine.children[ups[(r.bucket, tuple(r.up))]] = r.children
        sorted_out = heads.select("conv", "n", "start", "bucket", "tids").mapInArrow(_sorter(found, depth, digit), _SORTED)
        done.append(sorted_out)
        again = any(node is not None and len(key) == digit + 1 for key, node in found.items())
        live = sorted_out.where("state = 'live'").select("conv", "n", "start", F.col("node").alias("bucket")) if again else None
        depth, digit = depth + digit, min(2 * digit, MOST_DIGIT)
    return done, chains


def bucket_nodes(conv: list[int], first: list[int], size: list[int], tid: list[int], words: list[int], members: list[int], parent: int, depth: int) -> list[tuple]:
    """The nodes of one bucket, as rows of NODE with whether they are its top, by multikey quicksort.

    Sequence i has the turns tid[first[i]] to tid[first[i] + size[i] - 1]; the members agree in the first one.
    """
    up: list[int] = []
    held: list[list] = []
    todo: list[tuple[list[int], int, int, bool]] = [(members, 0, -1, True)]
    while todo:
        own, at, above, same = todo.pop()
        if not same:  # three-way partition by the turn at this place
            pivot = tid[first[own[len(own) // 2]] + at]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for i in own:
                t = tid[first[i] + at]
                parts[(t >= pivot) + (t > pivot)].append(i)
            todo += [(part, at, above, which == 1) for which, part in enumerate(parts) if part]
            continue
        node = len(up)
        up.append(above)
        ended = sorted(conv[i] for i in own if size[i] == at + 1)
        ends = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else NOBODY
        held.append([min(conv[i] for i in own), depth + at + 1, len(own), 0, 0, (len(own) - 1) * words[first[own[0]] + at], ends])
        rest = [i for i in own if size[i] > at + 1]
        if rest:
            todo.append((rest, at + 1, node, len(rest) == 1))
    for node in range(len(up) - 1, -1, -1):  # nodes come after their parents
        held[node][4] = held[node][4] or 1
        if up[node] >= 0:
            above = held[up[node]]
            above[3] += 1
            above[4] += held[node][4]
            above[5] += held[node][5]
    return [(c, d, held[u][0] if u >= 0 else parent, m, kids, leaves, saved, ends, u < 0) for u, (c, d, m, kids, leaves, saved, ends) in zip(up, held, strict=True)]


_TOP = NODE + ", top boolean"


def _local_nodes(turns: DataFrame, local: DataFrame) -> DataFrame:
    """Nodes of all local buckets; local: (conv, n, start, node, shared, next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]

        def finished(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            """The nodes of all whole buckets, and the rows left."""
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(i).to_numpy() for i in range(7)]
            node, shared_turns, following, conv = columns[:4]
            n = len(node)
            new = np.ones(n, bool)
            new[1:] = (node[1:] != node[:-1]) | (shared_turns[1:] != shared_turns[:-1]) | (following[1:] != following[:-1])
            bucket = np.flatnonzero(new)
            end = n if last else int(bucket[-1])
            begins = new.copy()
            begins[1:] |= conv[1:] != conv[:-1]
            first = np.flatnonzero(begins[:end])
            size = np.diff(np.append(first, end)).tolist()
            convs, tid, words = conv[first].tolist(), columns[5].tolist(), columns[6].tolist()
            where = np.searchsorted(first, np.append(bucket[bucket < end], end)).tolist()
            first = first.tolist()
            out = []
            for a, b in zip(where, where[1:], strict=False):
                at = first[a]
                out += bucket_nodes(convs, first, size, tid, words, list(range(a, b)), int(node[at]), int(shared_turns[at]))
            rows = list(zip(*out, strict=True)) if out else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [f.split(" ")[0] for f in _TOP.split(", ")]), table.slice(end)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SLICE_ROWS:
                done, rest = finished(held, False)
                yield done
                held = rest.to_batches()
        if sum(b.num_rows for b in held):
            yield finished(held, True)[0]

    rows = shared.looked_up(turns, local, ["conv"], "n").where(F.col("pos") - F.col("start") >= F.col("shared"))
    key = ["node", "shared", "next"]
    dealt = rows.select(*key, "conv", "pos", "tid", F.col("words").cast("long").alias("words")).repartition(shared.partitions(turns.sparkSession), *key)
    return dealt.sortWithinPartitions(*key, "conv", "pos").mapInArrow(arrays.lean(run), _TOP)


def _chain_nodes(turns: DataFrame, sequences: DataFrame, chains: list[tuple[int, int, int]]) -> DataFrame:
    """A node for each turn of a chain from its depth on: one conversation, one leaf, nothing saved."""
    few = F.broadcast(turns.sparkSession.createDataFrame(chains, "conv long, top long, above long"))
    lengths = F.broadcast(sequences.join(few, "conv"))
    rows = turns.join(lengths, "conv").withColumn("depth", F.col("pos") - F.col("start") + 1).where("depth >= top")
    ends = F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOBODY)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("depth") == F.col("n"), none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved_tokens"),
        ends.alias("ends_sha256"),
    )


def ends_hashes(ended: DataFrame) -> DataFrame:
    """(node, shared, ends_sha256) from (node, shared, conv): SHA-256 of each node's conv in order, with commas.

    A hash is made from the first byte to the last, so a node's ids pass through one task, but as
    pieces of many ids that others have joined, one at a time.
    """
    parts, key = shared.partitions(ended.sparkSession), ["node", "shared"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (c.to_numpy() for c in batch.columns)
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])
            at = np.arange(len(conv))
            cut = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % PIECE_IDS == 0)
            ids = conv.tolist()
            text = [",".join(map(str, ids[a:b])) for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[cut]), pa.array(depth[cut]), pa.array(conv[cut]), pa.array(text)], ["node", "shared", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "shared", "ends_sha256"]
        one = lambda key, h: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], names)
        last, running = None, None
        for batch in batches:
            for *now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now == last:
                    running.update(b"," + ids.encode())
                    continue
                if last is not None:
                    yield one(last, running)
                last, running = now, hashlib.sha256(ids.encode())
        if last is not None:
            yield one(last, running)

    spread = ended.select(*key, "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(arrays.lean(pieces), "node long, shared long, first long, ids string")
    return spread.repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(arrays.lean(hashes), "node long, shared long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row, as NODE says, for each node of the prefix trie of the rebuilt conversations.

    Null roles and texts are empty. Turns stand by turn, null first; of equal ones the order is that
    of a hash of role and text, and repeated rows are repeated turns. Rows with a null conv_id make
    no conversation. A negative id's family is that of Spark's ``%``. A very long text is hashed
    where it is read and goes no further; a very long conversation is spread over tasks. Other
    columns are not read, so their names cannot clash. An empty table has no node, not even a root.

    There is a round for as many turns, 4 to 64, as the longest beginning that several conversations
    share beyond a partition's share of all turns.
    """
    spark = conversations.sparkSession
    turns, sequences = rebuilt(conversations)
    if sequences.isEmpty():
        return spark.createDataFrame([], NODE)
    spine = Spine()
    rounds, chains = _rounds(turns, sequences, spine)
    came = rounds[0]
    for other in rounds[1:]:
        came = came.unionByName(other)
    came = shared.written(came, "trie-sorted")
    local = came.where("state = 'local'").drop("state")
    nodes = shared.written(_local_nodes(turns, local), "trie-local")
    for r in nodes.where("top").groupBy("parent_conv_id", (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).collect():
        spine.beneath((r.parent_conv_id, r.depth), r.leaves, r.saved)
    names = [f.split(" ")[0] for f in NODE.split(", ")]
    upper = spark.createDataFrame(spine.rows(), NODE.removesuffix(", ends_sha256 string"))
    hashes = ends_hashes(came.where("state = 'ended'")).withColumnsRenamed({"node": "conv_id", "shared": "depth"})
    upper = upper.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
    out = nodes.select(*names).unionByName(upper.select(*names))
    return out.unionByName(_chain_nodes(turns, sequences, chains).select(*names)) if chains else out


