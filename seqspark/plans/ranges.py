"""Queries over intervals, drawn from the line items; see views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.operators import intervals as I

from . import views as V

QUERIES, ORACLE = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _ab(spark, sf):
    s = V.spans(spark, sf)
    a = s.where("strand = '+'").select("scaffold", F.col("id").alias("a"), F.col("line").alias("la"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = s.where("strand = '-'").select("scaffold", F.col("id").alias("b"), F.col("line").alias("lb"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a, b


_AB = f"""{V.SPANS}, ab AS (SELECT x.id AS a, x.line AS la, x.start AS s1, x."end" AS e1, y.id AS b, y.line AS lb, y.start AS s2, y."end" AS e2 FROM spans x JOIN spans y ON x.scaffold = y.scaffold AND x.strand = '+' AND y.strand = '-')"""


@_query("overlap_pairs", f"WITH {_AB} SELECT a, la, b, lb, greatest(s1, s2) AS lo, least(e1, e2) AS hi FROM ab WHERE least(e1, e2) - greatest(s1, s2) >= 100")
def overlap_pairs(spark, sf):
    a, b = _ab(spark, sf)
    pairs = I.overlap_join(a, b, ["scaffold"], ("s1", "e1"), ("s2", "e2"), 2000)
    o = I.overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"), 100)
    return pairs.withColumn("o", o).where("o IS NOT NULL").select("a", "la", "b", "lb", F.col("o.start").alias("lo"), F.col("o.end").alias("hi"))


@_query("overlap_tree", f"""WITH {V.SPANS} SELECT q.id AS query, q.line AS line, count(*) AS hits, min(t.id) AS first FROM spans q JOIN spans t ON q.scaffold = t.scaffold AND q.start <= t."end" AND t.start <= q.start + 50 GROUP BY ALL""")
def overlap_tree(spark, sf):
    s = V.spans(spark, sf)
    queries = s.select("scaffold", F.col("id").alias("query"), "line", F.col("start").alias("q_start"), (F.col("start") + 50).alias("q_end"))
    hits = I.query_tree(s.select("scaffold", "start", "end", F.col("id").alias("value")), queries, ["scaffold"], 2000)
    return hits.groupBy("query", "line").agg(F.count(F.lit(1)).alias("hits"), F.min("value").alias("first"))


@_query(
    "nearest_left",
    f"""WITH {V.SPANS} SELECT q.id, q.line, coalesce((SELECT max({{'s': t.start, 'e': t."end"}}) FROM spans t WHERE t.scaffold = q.scaffold AND t."end" < q.start).e, 0) AS bound FROM spans q""",
)
def nearest_left(spark, sf):
    s = V.spans(spark, sf)
    return I.nearest(s.select("id", "line", "scaffold", F.col("start").alias("at")), s.select("scaffold", "start", "end"), ["scaffold"], "at", "left").select("id", "line", "bound")


@_query("nearest_right", f"""WITH {V.SPANS} SELECT q.id, q.line, (SELECT min(t.start) FROM spans t WHERE t.scaffold = q.scaffold AND t.start > q."end") AS bound FROM spans q""")
def nearest_right(spark, sf):
    s = V.spans(spark, sf)
    return I.nearest(s.select("id", "line", "scaffold", F.col("end").alias("at")), s.select("scaffold", "start", "end"), ["scaffold"], "at", "right").select("id", "line", "bound")


@_query("containment", f"""WITH {V.SPANS} SELECT id, line, EXISTS (SELECT 1 FROM spans t WHERE t.scaffold = q.scaffold AND t.strand = q.strand AND t.start <= q.start AND t."end" >= q."end" AND (t.id <> q.id OR t.line <> q.line)) AS inside FROM spans q""")
def containment(spark, sf):
    return I.contained(V.spans(spark, sf), ["scaffold", "strand"]).select("id", "line", "inside")


@_query(
    "coverage_80",
    f"WITH {_AB} SELECT DISTINCT a, la FROM ab WHERE (s2 <= s1 AND e2 >= e1) OR (greatest(0, least(e1, e2) - greatest(s1, s2) + 1) / (e1 - s1 + 1)::DOUBLE >= 0.8)",
)
def coverage_80(spark, sf):
    a, b = _ab(spark, sf)
    pairs = I.overlap_join(a, b, ["scaffold"], ("s1", "e1"), ("s2", "e2"), 2000)
    return pairs.where(I.covers(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))).select("a", "la").distinct()


@_query(
    "consecutive_gaps",
    f"""WITH {V.SPANS}, f AS (SELECT *, first_value(strand) OVER (PARTITION BY scaffold ORDER BY id, line) AS lead_strand FROM spans),
    o AS (SELECT *, lead(id) OVER w AS node_b, lead(start) OVER w AS gap_end FROM f WINDOW w AS (PARTITION BY scaffold ORDER BY CASE WHEN lead_strand = '-' THEN -start ELSE start END, id * 1000 + line, "end"))
    SELECT scaffold, id AS node_a, node_b, "end" AS gap_start, gap_end FROM o WHERE node_b IS NOT NULL""",
)
def consecutive_gaps(spark, sf):
    s = V.spans(spark, sf).select("scaffold", "start", "end", F.col("id").alias("node"), (F.col("id") * 1000 + F.col("line")).alias("ord"), F.when(F.col("strand") == "-", -1).otherwise(1).alias("frame"))
    return I.consecutive_gaps(s, ["scaffold"])


@_query(
    "needed_ranges",
    f"""WITH {V.SPANS}, c AS (SELECT scaffold, greatest(0, min(start) - 108) AS lo, max("end") + 108 AS hi FROM spans GROUP BY scaffold, id),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY scaffold ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM c),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY scaffold ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT scaffold, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY scaffold, k""",
)
def needed_ranges(spark, sf):
    return I.needed_ranges(V.spans(spark, sf), ["id"], flank=100)


@_query(
    "assign_tags",
    f"""WITH {V.SPANS} SELECT id, line, CASE WHEN strand = '+' THEN 'FLANK_' ELSE 'GAP_' END || CAST(scaffold AS VARCHAR) || '_' || CAST(row_number() OVER (PARTITION BY scaffold, strand ORDER BY start, "end", id, line) - 1 AS VARCHAR) AS tag FROM spans""",
)
def assign_tags(spark, sf):
    n = F.row_number().over(W.partitionBy("scaffold", "strand").orderBy("start", "end", "id", "line")) - 1
    return V.spans(spark, sf).select("id", "line", F.concat(F.when(F.col("strand") == "+", "FLANK_").otherwise("GAP_"), F.col("scaffold").cast("string"), F.lit("_"), n.cast("string")).alias("tag"))


@_query(
    "chunk_fetch",
    f"""WITH {V.NT} SELECT doc_id, substr(nt, 41) AS seq FROM nt WHERE length(nt) >= 140""",
)
def chunk_fetch(spark, sf):
    """Ranges of chunked sequences, put together from the blocks that they touch."""
    nt = V.nt(spark, sf).where("length(nt) >= 140")
    chunks = nt.select(F.col("doc_id").alias("scaffold"), F.posexplode(F.regexp_extract_all("nt", F.lit(".{1,64}"), F.lit(0))).alias("blk", "seq"))
    ranges = nt.select(F.col("doc_id").alias("scaffold"), F.lit(40).cast("long").alias("lo"), F.length("nt").cast("long").alias("hi"))
    return I.fetch_ranges(ranges, chunks, 64).select(F.col("scaffold").alias("doc_id"), "seq")
