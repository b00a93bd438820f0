import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node string, part string, __n int, shard int, copies int"


def texts():
    """Prose with exact and near copies, shared lines and passages, ties, nulls, and odd texts."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéilnorst") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [line(rnd.randrange(0, 220)) for _ in range(60)]
    common = [line(12) for _ in range(3)]
    passage = line(110)
    for i in range(0, 40, 3):
        out[i] = f"{out[i]}\n  {common[i % 3].upper()}\t\n{line(20)}"
    for i in range(5, 30, 6):
        out[i] = f"{out[i][:50]} {passage} {out[i][50:]}"
    for i in range(3):
        w = out[20 + i].split(" ")
        for _ in range(9):
            near = list(w)
            near[rnd.randrange(len(w))] = "changed"
            out.append(" ".join(near))
    out += [out[1]] * 6 + [out[2]] * 2
    out += ["", None, " \n \t", "one", "One two", "one two", "a " * 600, "ab" * 900, "<|endoftext|> x", "can't we'll 'tis  \n\n don't", "😀" * 40, "z" * 5000]
    out += [line(5000)]
    return out


@pytest.fixture(scope="session")
def rows():
    every = texts()
    ids = list(range(0, 3 * len(every), 3))
    random.Random(2).shuffle(ids)
    return sorted(zip(ids, every, strict=True))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    table = [(d, t, None, None if d % 5 == 0 else f"s{d % 4}", len(t or ""), "h", "node", "part", 1, 2, 3) for d, t in rows]
    return spark.createDataFrame(table, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated ids and rows."""
    table = [(None, "a b c d e f", None, None, 1), (None, None, None, None, None), (1, "a b c d e f", "x", "s", 1), (1, "a b c d e f", "x", "s", 1), (1, "other words are here in this row", "x", "s", 1)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
