"""Queries over whole genes: cleaning, greedy dedup and the records that they read and write."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import candidates, cull
from seqspark.operators import columns as C
from seqspark.sources import text

from . import views as V

QUERIES, ORACLE = {}, {}


def cull_columns(spark, sf):
    """Every gene's alignment, cleaned. References are of this gene too; see views."""
    rows = V.rows(spark, sf).select("gene", F.col("row_id").alias("ord"), "header", "seq")
    out = cull.cull_columns(rows)
    return out.select("gene", "ord", "header", "seq", F.size("drops").alias("n_drops"), "left_trim", "right_trim", F.size("introns").alias("n_introns"), F.size("exons").alias("n_exons"))


QUERIES["cull_columns"] = cull_columns


def dedup_candidates(spark, sf):
    """Line items as candidates of their supplier: columns from the part, score from the price."""
    s = V.table(spark, sf, "lineitem")
    start = F.col("l_partkey") * 100 + F.col("l_linenumber")
    first = (F.col("l_partkey") % 200).cast("int")
    rows = s.select(
        F.concat_ws("_", "l_suppkey", F.col("l_partkey") % 16).alias("gene"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("string")).alias("tag"),
        F.lit("s").alias("scaffold"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3).alias("end"),
        F.sequence(first, first + F.col("l_quantity").cast("int")).alias("cols"), F.lit("").alias("aa"), F.col("l_extendedprice").alias("full"), (F.col("l_discount") * 100).alias("covered"), F.lit("1").alias("cluster"),
    )
    return candidates.dedup_candidates(rows, ["gene"])


QUERIES["dedup_candidates"] = dedup_candidates


def fasta_records(spark, sf):
    return V.rows(spark, sf).select("row_id", text.fasta_lines(F.col("header"), F.col("seq"), mask_stops=True).alias("record"))


QUERIES["fasta_records"] = fasta_records
ORACLE["fasta_records"] = f"WITH {V.ROWS} SELECT row_id, '>' || header || chr(10) || replace(seq, '*', 'X') AS record FROM rows"


def gap_cull(spark, sf):
    """The columns that are gaps in all rows of a gene, and how many are left."""
    keep = C.empty_columns(V.rows(spark, sf), "gene")
    return keep.select("gene", F.size("keep").cast("long").alias("kept"), F.array_min("keep").alias("first"), F.array_max("keep").alias("last"))


QUERIES["gap_cull"] = gap_cull
ORACLE["gap_cull"] = f"WITH {V.CELLS}, k AS (SELECT gene, col FROM cells GROUP BY gene, col HAVING bool_or(ch <> '-')) SELECT gene, count(*) AS kept, min(col) AS first, max(col) AS last FROM k GROUP BY gene"


def supersede_natives(spark, sf):
    """Natives that recoveries on the same scaffold and strand cover; recoveries are the items of even orders, a third of them slots."""
    s = V.spans(spark, sf)
    slot = F.col("id") % 6 == 0
    tag = F.concat_ws("_", F.when(slot, "IMX").otherwise("GAP"), "id", "line").alias("tag")
    found = s.where("id % 2 = 0").select(tag, "scaffold", "strand", "start", "end", slot.alias("is_slot"), (F.col("id") * 1000 + F.col("line")).alias("ord"))
    natives = s.where("id % 2 = 1").select(F.concat_ws("_", F.lit("n"), "id", "line").alias("name"), "scaffold", "strand", "start", "end")
    return candidates.supersede_natives(found, natives, 2000).select("name", "tag", "superseded")


QUERIES["supersede_natives"] = supersede_natives
ORACLE["supersede_natives"] = f"""WITH {V.SPANS}, h AS (SELECT n.id, n.line, g.id AS g_id, g.line AS g_line, g.id % 6 = 0 AS slot
  FROM spans n JOIN spans g ON n.scaffold = g.scaffold AND n.strand = g.strand AND n.id % 2 = 1 AND g.id % 2 = 0
  WHERE (g.start <= n.start AND g."end" >= n."end") OR greatest(0, least(n."end", g."end") - greatest(n.start, g.start) + 1) / (n."end" - n.start + 1)::DOUBLE >= 0.8),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, line, slot ORDER BY g_id, g_line) AS k FROM h)
SELECT 'n_' || id || '_' || line AS name, CASE WHEN slot THEN 'IMX_' ELSE 'GAP_' END || g_id || '_' || g_line AS tag, slot AS superseded FROM k WHERE NOT slot OR k = 1"""
