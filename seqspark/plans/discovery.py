"""Queries over reading frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import orfs

from . import views as V

QUERIES, ORACLE = {}, {}


def _frames(nt: str, least: int) -> str:
    per = [f"SELECT doc_id, {f} AS frame, unnest(string_split({V.aa_sql(f'substr({nt}, {f + 1})')}, '*')) AS aa FROM h" for f in range(3)]
    return " UNION ALL ".join(f"SELECT doc_id, frame, aa FROM ({p}) WHERE length(aa) >= {least}" for p in per)


def orf_scan(spark, sf):
    found = V.nt(spark, sf).select("doc_id", F.explode(orfs.orfs(F.col("nt"), 20)).alias("o"))
    return found.select("doc_id", F.col("o.frame").alias("frame"), F.col("o.aa").alias("aa"))


QUERIES["orf_scan"] = orf_scan
ORACLE["orf_scan"] = f"WITH {V.NT}, h AS (SELECT doc_id, nt FROM nt) {_frames('nt', 20)}"


def orf_scan_from_start(spark, sf):
    found = V.nt(spark, sf).select("doc_id", F.explode(orfs.orfs(F.col("nt"), 20, True)).alias("o"))
    return found.select("doc_id", F.col("o.frame").alias("frame"), F.col("o.aa").alias("aa"))


QUERIES["orf_scan_from_start"] = orf_scan_from_start
ORACLE["orf_scan_from_start"] = f"WITH {V.NT}, h AS (SELECT doc_id, nt FROM nt), o AS ({_frames('nt', 20)}), m AS (SELECT doc_id, frame, substr(aa, instr(aa, 'M')) AS aa FROM o WHERE contains(aa, 'M')) SELECT doc_id, frame, aa FROM m WHERE length(aa) >= 20"


def orf_locations(spark, sf):
    regions = V.nt(spark, sf).select("doc_id", F.col("nt").alias("seq"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    regions = regions.withColumn("region_start", F.col("doc_id") * 1000 + 1).withColumn("region_end", F.col("region_start") + F.length("seq") - 1)
    return orfs.scan_regions(regions, 15).select("doc_id", "strand", "aa", "frame", "hit_start", "hit_end", (F.col("hit_end") - F.col("hit_start") + 1 == 3 * F.length("aa")).alias("fits"))


QUERIES["orf_locations"] = orf_locations
_READ = "CASE WHEN doc_id % 2 = 1 THEN translate(reverse(nt), 'ACGT', 'TGCA') ELSE nt END"
_PLACED = " UNION ALL ".join(
    f"""SELECT doc_id, n, {f} AS f, aa, {f} + 3 * (p - length(aa) - 1) AS s FROM (SELECT doc_id, n, aa, sum(length(aa) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM
    (SELECT doc_id, n, unnest(a) AS aa, unnest(range(0, len(a))) AS i FROM (SELECT doc_id, length(nt) AS n, string_split({V.aa_sql(f'substr(nt, {f + 1})')}, '*') AS a FROM h)))"""
    for f in range(3)
)
ORACLE["orf_locations"] = f"""WITH {V.NT}, h AS (SELECT doc_id, {_READ} AS nt FROM nt WHERE length(nt) >= 6), o AS (SELECT * FROM ({_PLACED}) WHERE length(aa) >= 15)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, aa, CASE WHEN doc_id % 2 = 0 THEN f + 1 ELSE -f - 1 END AS frame,
  (doc_id * 1000 + 1 + CASE WHEN doc_id % 2 = 0 THEN s ELSE n - (s + 3 * length(aa)) END)::BIGINT AS hit_start, (doc_id * 1000 + CASE WHEN doc_id % 2 = 0 THEN s + 3 * length(aa) ELSE n - s END)::BIGINT AS hit_end, true AS fits FROM o"""


def interval_subtraction(spark, sf):
    n = 40 + F.col("doc_id") % 60
    known = F.array(*(F.struct((F.col("doc_id") % m).cast("int").alias("start"), (F.col("doc_id") % m + k).cast("int").alias("end")) for m, k in ((7, 5), (31, 11), (97, 3))))
    return V.nt(spark, sf).select("doc_id", F.inline(orfs.subtract(n, known)))


QUERIES["interval_subtraction"] = interval_subtraction
ORACLE["interval_subtraction"] = """WITH p AS (SELECT doc_id, unnest(range(0, 40 + doc_id % 60)) AS i FROM documents),
  f AS (SELECT * FROM p WHERE NOT (i >= doc_id % 7 AND i < doc_id % 7 + 5) AND NOT (i >= doc_id % 31 AND i < doc_id % 31 + 11) AND NOT (i >= doc_id % 97 AND i < doc_id % 97 + 3)),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f) SELECT doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM g GROUP BY doc_id, k"""
