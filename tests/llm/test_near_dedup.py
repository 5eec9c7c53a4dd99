import random
from itertools import combinations

import numpy as np

from seqspark.llm import near_dedup, queries

from .helpers import oracle_rows, rows

SCHEMA = "doc_id long, text string, id string, n int, print string"


def sets_of(text, width):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\f\r" else c for c in text or "")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(docs, width):
    every = {}
    for i, t in docs:
        if i is not None:
            every.setdefault(i, []).append(sets_of(t, width))
    top = {i: i for i in every}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(every), 2):
        if any(100 * len(x & y) >= 80 * len(x | y) for x in every[a] if x for y in every[b] if y):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return sorted((repr(i), len(sets_of(t, width)), repr(None if i is None else find(i)), i is None or find(i) == i) for i, t in docs)


def check(spark, docs, width=4):
    df = spark.createDataFrame([(i, t, "x", 1, "p") for i, t in docs], SCHEMA)
    got = near_dedup.link(df, width=width).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == brute(docs, width)


def noisy(rng, words, p):
    return [rng.choice("abcdefgh") * rng.randint(3, 9) if rng.random() < p else w for w in words]


def test_small_sets_exactly(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    base = [f"w{i}" for i in range(24)]
    for i in range(120):
        w = base[: rng.randint(3, 24)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 3)}"
        docs.append((1000 + i, " ".join(w)))
    check(spark, docs + [(None, "a b c d e"), (None, None), (500, None), (501, " \n"), (3, docs[3][1]), (3, "A  b\tC d e f")])


def test_near_copies_of_longer_texts(spark):
    rng = random.Random(6)
    docs = []
    for f in range(25):
        words = [f"t{rng.randint(0, 4000)}" for _ in range(rng.choice([30, 80, 200, 900]))]
        docs += [(100 * f + j, " ".join(noisy(rng, words, rng.choice([0, 0.01, 0.03, 0.05])))) for j in range(7)]
    check(spark, docs)


def test_long_lists_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    rng = random.Random(8)
    words = [f"t{i}" for i in range(150)]
    docs = [(i, " ".join(noisy(rng, words, rng.choice([0.0, 0.02, 0.04, 0.06])))) for i in range(60)]
    check(spark, docs)
    check(spark, docs[:30], width=5)


def test_empty_table_and_components(spark):
    assert near_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 3)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    one = near_dedup.shingle_sets([b"a b c d e a b c d", b"", b"x y", b"X Y"], 4)
    assert [len(s) for s in one] == [5, 0, 1, 1] and np.array_equal(one[2], one[3])


def test_query_against_sql(spark):
    assert rows(queries.op9_near_dedup(spark, "/root/testdata/sf0.01")) == oracle_rows(queries.ORACLE["op9_near_dedup"])
