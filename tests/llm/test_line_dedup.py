import random

import pytest
from pyspark.sql import functions as F

from seqspark.llm import line_dedup, queries

SCHEMA = "doc_id long, text string, rank int, n_removed string, line string, pos int"


def brute(docs, prints, min_words):
    """Every repeated run with enough words, tried from each place at each length."""
    seqs = []
    for i, t in docs:
        if t is not None:
            seqs.append(((i is None, i if i is not None else 0, prints[t]), [x.strip() for x in t.split("\n") if x.strip()], (i, t)))
    seqs = sorted({s[0]: s for s in seqs}.values())
    size = lambda run: sum(len(x.split()) for x in run)
    seen, gone = {}, {}
    for place, lines, own in seqs:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[s:e]), (place, s))
    for place, lines, own in seqs:
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if size(lines[s:e]) >= min_words and seen[tuple(lines[s:e])] != (place, s):
                    gone.setdefault(own, set()).update(range(s, e))
    out = []
    for i, t in docs:
        kept, p = [], 0
        for x in (t or "").split("\n"):
            if not (x.strip() and p in gone.get((i, t), ())):
                kept.append(x)
            p += bool(x.strip())
        out.append((repr(i), repr(None if t is None else "\n".join(kept)), len(gone.get((i, t), ()))))
    return sorted(out)


def check(spark, docs, min_words):
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs], SCHEMA)
    prints = {r.text: r.p for r in df.select("text", F.xxhash64("text").alias("p")).collect()}
    got = line_dedup.dedup(df, min_words=min_words).collect()
    assert {r.n_removed for r in got} <= {"x"}
    assert sorted((repr(r.doc_id), repr(r.text), r._n_removed) for r in got) == brute(docs, prints, min_words)


@pytest.mark.parametrize("min_words", [1, 7])
def test_against_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a", "b          b", "c c c", " d ", "e e e e", "", "f f f f f f f f"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(40)]
    docs += [(100 + i, "\n".join(f"u{i} {j}" if rng.random() < 0.3 else f"s {j}" for j in range(14))) for i in range(12)]
    docs += [(None, "e e e e\nc c c"), (None, None), (500, None), (501, ""), (7, docs[7][1]), (7, "c c c\ne e e e"), (502, "\n".join(["same same"] * 30))]
    check(spark, docs, min_words)


def test_empty_and_one_line(spark):
    df = spark.createDataFrame([(1, "x y", 1, "x", "y", 2)], SCHEMA)
    assert [r.text for r in line_dedup.dedup(df).collect()] == ["x y"] and line_dedup.dedup(df.limit(0)).count() == 0


def test_query_keeps_first_places(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op8_line_dedup(spark, sf).collect()}
    seen = set()
    for i, t in sorted(docs):
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        long = [x for x in lines if len(x.split()) >= line_dedup.MIN_WORDS]
        kept = [x.strip() for x in got[i][0].split("\n") if x.strip()]
        assert all((x in kept) == (x not in seen) for x in set(long))
        seen.update(long)


def test_columns_with_the_names_of_counts_stay(spark):
    line = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, line, "mine", "m", "g", "i", "p"), (2, line + "\nown", "yours", None, "g", "i", "p")], "doc_id long, text string, n_removed string, N_Lines string, gone string, gone_id string, own string")
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert line_dedup.added(df) == ["_n_lines", "_n_removed"]
    assert (got[1].n_removed, got[1].N_Lines, got[1]._n_removed, got[1].own) == ("mine", "m", 0, "p")
    assert (got[2].n_removed, got[2].N_Lines, got[2]._n_removed, got[2].text) == ("yours", None, 1, "own")
