"""The trie against one built of Python's tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, n int, start int, node string, shared int, words int, top int"
SPACE = " \t\n\v\f\r"


def n_words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def order(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])


def brute(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (n_words(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5, 6) for r in rows], SCHEMA).repartition(5)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(table).collect())


def chats(rnd, ids, longest=6, words=("a", "b", "a b", "", None, " x\ty\n")):
    return [(c, t, rnd.choice(["user", "user", None]), rnd.choice(words)) for c in ids for t in range(rnd.randrange(longest))]


ODD = [
    (None, 1, "user", "lost"), (-5, 1, "u", "x"), (-5, 2, "u", "y"), (-5, 3, "u", "z"), (-5, 4, "u", "z"), (-20, 1, "u", "x"), (0, None, "u", "first"), (0, 1, "u", "second"), (3, 1, "u", "t"), (3, 1, "u", "s"), (3, 1, "u", "s"),
    (3, 2, None, None), (3, 3, "1:u", ""), (3, 4, "1", ":u"), (7, 1, "u", "alone"), (45, 9, "u", "no base"), (45, 10, "u", "w " * 3000), (62, 1, "u", "é b"),
]


@pytest.mark.parametrize("local", [0, 9, prefix_trie.LOCAL])
def test_trie(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    monkeypatch.setattr(prefix_trie, "DIGIT", 2)
    monkeypatch.setattr(prefix_trie, "SLICE_ROWS", 50)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rnd = random.Random(local)
    rows = ODD + chats(rnd, [*range(100, 180), 300, 901, 902])
    assert found(spark, rows) == brute(rows)


def test_copies_chains_and_long_beginnings(spark, monkeypatch):
    """Many copies, a conversation of a third of all rows, and conversations that agree for longer than a digit."""
    monkeypatch.setattr(prefix_trie, "LOCAL", 20)
    long = [(1000, t, "u", f"t{t}") for t in range(400)]
    shared = [(2000 + 20 * i, t, "u", f"s{t}" if t < 9 else f"own {i}") for i in range(30) for t in range(11)]
    copies = [(5000 + 20 * i, t, "u", f"c{t}") for i in range(60) for t in range(7)]
    two = [(9000 + 20 * i, t, "u", f"d{t} x") for i in range(2) for t in range(90)]
    rows = long + shared + copies + two
    assert found(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []
    one = [(7, 1, "u", "x y")]
    assert found(spark, one) == brute(one)


def test_places_over_borders(spark):
    """Turns of one conversation, equal ones too, are numbered over all parts."""
    table = spark.range(3000).select(F.lit(4).alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    turns, sequences = prefix_trie.rebuilt(table.repartition(6))
    assert turns.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[0] == sequences.first().n
    assert prefix_trie.encoded(table.repartition(6)).select("part").distinct().count() > 1


def test_query_equals_sql(spark, duck):
    frame = catalog.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    columns = sorted(frame.columns)
    wanted = duck.sql(catalog.oracle_sql()["op12_prefix_trie"]).select(", ".join(columns)).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(wanted, key=key) and len(wanted) > 20
