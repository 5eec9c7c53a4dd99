"""Canonical dedup of sequences: a sequence and its reverse complement count as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import sequences as S


def canonical_dedupe(records: DataFrame, order: list[str], seq: str = "seq", min_size: int = 1) -> DataFrame:
    """(id, seq, n): distinct canonical sequences with their counts.

    Ids number the sequences from 1 by first appearance in the order and are not renumbered by the filter.
    Counting combines in the tasks; the numbering is a running count over key ranges of the first places: the sequences are
    sorted over the cluster, and each partition adds the rows of those before it.
    """
    groups = records.groupBy(S.canonical(F.col(seq)).alias("seq")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return number(groups, "first", "id").where(F.col("n") >= min_size).select("id", "seq", "n")


def number(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with 1, 2, ... in the order of a column, whose values differ, without gathering the rows in one task."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1))
    rows = rows.persist()
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
