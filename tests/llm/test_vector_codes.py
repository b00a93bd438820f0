"""Product codes against a search of all entries, in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import catalog, shared, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, n int, __key_0 int"


def brute(rows):
    """(vec_id, code, error, label_error, digest) of every kept row."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    n = len(good[0][1]) // 16
    ints = [[x * 256 // 1 if abs(x) < 2**40 else int(x) * 256 for x in r[1]] for r in good]
    ints = [[int(x) for x in v] for v in ints]
    cut = [[v[p * n : (p + 1) * n] for p in range(16)] for v in ints]
    books = [[list(c[p]) for c in cut[:64]] for p in range(16)]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(2):
        for p in range(16):
            members = defaultdict(list)
            for c in cut:
                members[find(c[p], books[p])[1]].append(c[p])
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[find(c[p], books[p]) for p in range(16)] for c in cut]
    by_label = defaultdict(int)
    for r, f in zip(good, found, strict=True):
        by_label[r[2]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[r[2]], digest) for r, f in zip(good, found, strict=True))


def found(frame):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def vectors(rnd, count, dims, size=1.0):
    near = [[rnd.gauss(0, size) for _ in range(dims)] for _ in range(9)]
    return [[x + rnd.gauss(0, size / 20) for x in rnd.choice(near)] for _ in range(count)]


def test_codes(spark):
    rnd = random.Random(8)
    rows = [(2 * i, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(vectors(rnd, 150, 48))]
    rows += [(7, None, 1), (9, [math.nan] * 48, 1), (11, [math.inf] * 48, None), (13, [None] * 48, 2), (15, [1.0] * 32, 2), (17, [], 2), (None, rows[3][1], 1), (6, rows[5][1], 1), rows[4], rows[4]]
    assert found(vector_codes.compress(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("dims", [16, 64, 160])
def test_lengths_and_few_rows(spark, dims):
    rows = [(i, v, 0) for i, v in enumerate(vectors(random.Random(dims), 70 if dims == 16 else 10, dims))]
    assert found(vector_codes.compress(table(spark, rows))) == brute(rows)


def test_large_numbers(spark):
    rnd = random.Random(3)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors(rnd, 80, 16, 2.0**22))]
    rows += [(100 + i, [1e30 if p == i else 0.5 for p in range(16)], 1) for i in range(2)]
    rows = [*[(i - 10, r[1], 1) for i, r in enumerate(rows[-2:])], *rows[:-2]]
    assert found(vector_codes.compress(table(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert vector_codes.compress(table(spark, [])).count() == 0 and vector_codes.compress(table(spark, [(1, None, 2)])).count() == 0
    empty = vector_codes.compress(table(spark, [(3, [], 1), (4, [], None)]))
    assert found(empty) == [(str(i), "00" * 16, 0, 0, hashlib.sha256(b",".join([b""] * 0)).hexdigest()) for i in (3, 4)]
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 20, 0)]))


def test_search_equals_all_distances():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 4, 7):
        book = rnd.integers(-6, 6, (64, n))
        x = rnd.integers(-7, 7, (3000, n))
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        e, d = vector_codes.nearest(x, book)
        assert (e == every.argmin(1)).all() and (d == every.min(1)).all()
        e, d = vector_codes.nearest(x.astype(object), book)
        assert (e == every.argmin(1)).all() and (d == every.min(1)).all()


def test_query_equals_sql(spark, duck):
    frame = catalog.op11_vector_codes(spark, "/root/testdata/sf0.001")
    columns = sorted(frame.columns)
    wanted = duck.sql(catalog.oracle_sql()["op11_vector_codes"]).select(", ".join(columns)).fetchall()
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == sorted(wanted) and len(wanted) == 500


def test_lookup_with_a_hot_key(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 50) for i in range(300)], "i int, k int")
    counts = rows.groupBy("k").count()
    joined = shared.looked_up(rows, counts, ["k"], "count")
    assert joined.count() == 300 and all(r["count"] == (200 if r.k is None else 2) for r in joined.collect())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
