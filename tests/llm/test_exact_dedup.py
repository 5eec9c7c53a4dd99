from pyspark.sql import functions as F

from seqspark.llm import exact_dedup, queries

from .helpers import oracle_rows, rows

SCHEMA = "doc_id long, text string, digest string, id int, group_size string"
DOCS = [(5, None), (3, ""), (9, " \n"), (1, "a b"), (2, "a  b"), (4, "ab"), (6, "x"), (None, "x"), (7, "é\x0bé"), (8, "éé"), (8, "éé"), (10, "y" * 30000), (11, "y" * 30000)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "q", 1, "z") for i, t in docs], SCHEMA)


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), []).append((-len(t or ""), i is None, i))
    key = {}
    for norm, g in groups.items():
        key[norm] = (min(g)[2], len(g))
    return sorted((repr(i), repr(key["".join(c for c in t or "" if c not in " \t\n\x0b\f\r")])) for i, t in docs)


def got(df):
    return sorted((repr(r.doc_id), repr((r.keep_id, r.group_size))) for r in df.collect())


def test_against_brute_force(spark):
    df = exact_dedup.dedup(frame(spark, DOCS))
    assert got(df) == brute(DOCS)
    assert {r.doc_id for r in df.collect() if r.kept} == {9, 2, 6, 7, 10}


def test_colliding_digests_are_told_apart_by_bytes(spark):
    docs = [(i, "t" * (i % 7)) for i in range(60)] + DOCS
    df = exact_dedup.dedup(frame(spark, docs), digest=lambda c: (F.length(c) % 2).cast("string"))
    assert got(df) == brute(docs)
    same = exact_dedup.dedup(frame(spark, docs))
    assert rows(df) == rows(same)


def test_hot_group_and_empty_table(spark):
    docs = [(i, "hot text" if i % 3 else f"t{i}") for i in range(3000)]
    assert got(exact_dedup.dedup(frame(spark, docs))) == brute(docs)
    assert exact_dedup.dedup(frame(spark, DOCS).limit(0)).count() == 0


def test_query_against_sql(spark):
    assert rows(queries.op2_exact_dedup(spark, "/root/testdata/sf0.01")) == oracle_rows(queries.ORACLE["op2_exact_dedup"])


def test_runs_are_merged_through_their_filters(spark):
    """Entries that the filter rules out are in no other run; what it lets pass is merged by the digest."""
    index = exact_dedup.MergeIndex(spark)
    rows = [(i % 700, 5 + i % 3, i) for i in range(2000)]
    log = spark.createDataFrame(rows, "n long, n_points int, id long").repartition(7)
    index.flush(log.select(F.unhex(F.sha2(F.col("n").cast("string"), 256)).alias("digest"), F.lit("").alias("sha"), "n_points", "id"))
    assert len(index.runs) == exact_dedup.RUNS
    for run in index.runs:
        assert run.count() == run.select("digest").distinct().count()
    one, other = index.runs[:2]
    bits = {r["range"]: bytes(r.bits) for r in index.filter_of(one, 3).collect()}
    assert sum(bin(b).count("1") for x in bits.values() for b in x) > 0.9 * one.count()
    want = {}
    for n, size, i in rows:
        best, count = want.get(n, ((0, 0), 0))
        want[n] = (min(best, (-size, i)) if count else (-size, i), count + 1)
    got = {(r.keep_id, r.group_size) for r in index.compact().collect()}
    assert got == {(best[1], count) for best, count in want.values()}
