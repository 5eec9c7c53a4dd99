"""Sequence-shaped tables derived from the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import codons
from seqspark.functions.views import NT_SQL, nucleotides
from seqspark.session import small_batches, table


def nt(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, n_chars, nt). Whole texts go to Python in small batches."""
    return small_batches(table(spark, sf, "documents")).select("doc_id", "source", "lang", "n_chars", nucleotides(F.coalesce("text", F.lit(""))).alias("nt"))


NT = f"nt AS (SELECT doc_id, source, lang, n_chars, {NT_SQL} AS nt FROM documents)"


def aa_sql(expr: str, code: int = 1) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '...'), lambda c: coalesce({codons.code_sql(code)}[c], 'X')), '')"


def rows(spark: SparkSession, sf: str, width: int = 120) -> DataFrame:
    """Alignment rows of whole documents: (row_id, gene, header, is_ref, weight, seq, other).

    A document gives a row for each block of 6 * width bases, one at least; seq is the first half's residues with gaps, other the second's.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.length("nt") / (6 * width)), F.lit(1)) - 1))
    cut = nt(spark, sf).withColumn("b", blocks).withColumn("row_id", F.col("doc_id") * 1_000_000 + F.col("b"))
    at = (F.col("b") * (6 * width)).cast("int")
    part = lambda skip: F.replace(codons.translate(F.substring(F.col("nt"), at + (skip + 1), F.lit(3 * width))), F.lit("X"), F.lit("-"))
    header = F.concat_ws("|", "source", "lang", F.lit("r"), F.concat(F.lit("n"), "row_id"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("-2"))
    return cut.select(
        "row_id",
        F.concat(F.lit("g"), (F.col("doc_id") % 11).cast("string")).alias("gene"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(header, F.lit("|."))).otherwise(header).alias("header"),
        (F.col("doc_id") % 5 == 0).alias("is_ref"),
        (1 + F.col("n_chars") % 9).alias("weight"),
        F.rpad(part(0), width, "-").alias("seq"),
        F.rpad(part(3 * width), width, "-").alias("other"),
    )


ROWS = f"""{NT}, cut AS (SELECT *, doc_id * 1000000 + b AS row_id FROM (SELECT *, unnest(range(0, greatest(1, (length(nt) + 719) // 720))) AS b FROM nt)), rows AS (
  SELECT row_id, 'g' || CAST(doc_id % 11 AS VARCHAR) AS gene, doc_id % 5 = 0 AS is_ref, 1 + n_chars % 9 AS weight,
    concat_ws('|', source, lang, 'r', 'n' || CAST(row_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '-2' END) || CASE WHEN doc_id % 5 = 0 THEN '|.' ELSE '' END AS header,
    rpad(replace({aa_sql("substr(nt, 720 * b + 1, 360)")}, 'X', '-'), 120, '-') AS seq, rpad(replace({aa_sql("substr(nt, 720 * b + 361, 360)")}, 'X', '-'), 120, '-') AS other
  FROM cut)"""
#: Cells of the alignment within each row's residue span, as (gene, row_id, weight, is_ref, col, ch).
FIRST = "CASE WHEN ltrim(seq, '-') = '' THEN 0 ELSE length(seq) - length(ltrim(seq, '-')) END"
LAST = "CASE WHEN ltrim(seq, '-') = '' THEN 1 ELSE length(rtrim(seq, '-')) END"
CELLS = f"""{ROWS}, cells AS (SELECT gene, row_id, weight, is_ref, col, substr(seq, col + 1, 1) AS ch, col >= {FIRST} AND col < {LAST} AS inside
  FROM (SELECT *, unnest(range(0, 120))::INT AS col FROM rows))"""


#: (id, line) is unique: line numbers the items of an order, whose own numbers repeat.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals from the line items: (id, line, scaffold, start, end, strand)."""
    start = F.col("l_partkey") * 100 + F.col("l_linenumber")
    line = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ITEM_ORDER))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), F.col("l_suppkey").alias("scaffold"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 20).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand")
    )


SPANS = f"""spans AS (SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}))::INT AS line, l_suppkey AS scaffold, l_partkey * 100 + l_linenumber AS start,
  l_partkey * 100 + l_linenumber + CAST(l_quantity AS BIGINT) * 20 AS "end", CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem)"""
