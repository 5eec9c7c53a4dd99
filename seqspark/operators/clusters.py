"""Clusters of nodes: which candidates they hold, where they begin and end, and the slots between constitutive neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Residues that a scored gap needs, or as many as the profile has columns; covered per cent that it needs.
MIN_GAP_RESIDUES, MIN_COVERED_PCT = 15, 20.0


def members(clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (gene, node, ...) of each cluster (gene, cluster_key, node), once for each cluster that names their node."""
    return clusters.select("gene", "cluster_key", "node").distinct().join(candidates, ["gene", "node"])


def end_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_node and last_node of each cluster, from its nodes (keys, ord, node, frame, start).

    The node of the smallest ord decides which way the cluster is put in order, by start: downwards if its frame is negative, and
    of equal starts the smaller ord comes first. Read from its end if the first node in that order has a negative frame.
    """
    by = nodes.groupBy(*keys).agg(
        F.min_by(F.col("frame"), F.col("ord")).alias("way"),
        *(f(F.struct("node", "frame"), F.struct(F.col("start"), o)).alias(n) for f, o, n in (
            (F.min_by, F.col("ord").alias("o"), "low"), (F.max_by, F.col("ord").alias("o"), "high"),
            (F.min_by, (-F.col("ord")).alias("o"), "low_down"), (F.max_by, (-F.col("ord")).alias("o"), "high_down"),
        )),
    )
    down = F.col("way") < 0
    head, tail = F.when(down, F.col("high_down")).otherwise(F.col("low")), F.when(down, F.col("low_down")).otherwise(F.col("high"))
    turned = head["frame"] < 0
    return by.select(*keys, F.when(turned, tail["node"]).otherwise(head["node"]).alias("first_node"), F.when(turned, head["node"]).otherwise(tail["node"]).alias("last_node"))


def slots(tokens: DataFrame, gff: DataFrame) -> DataFrame:
    """(gene, scaffold, left_node, right_node, cluster_key, node_ord, strand): the slots to scan, each once for a gene.

    A slot is a modular token (gene, cluster_key, node_ord, node, modular) inside a cluster, between two that are not, whose
    entries of the annotation (name, scaffold, strand) are on one scaffold; the first by cluster_key and node_ord stands for it.
    """
    w = W.partitionBy("gene", "cluster_key").orderBy("node_ord")
    near = lambda f, n: f(F.struct("node", "modular")).over(w).alias(n)
    kept = tokens.select("gene", "cluster_key", "node_ord", "modular", near(F.lag, "l"), near(F.lead, "r")).where("modular AND NOT l.modular AND NOT r.modular")
    entry = lambda side: gff.select(F.col("name").alias(f"{side}_node"), F.col("scaffold").alias(f"{side}_scaffold"), F.col("strand").alias(f"{side}_strand"))
    both = kept.select("gene", "cluster_key", "node_ord", F.col("l.node").alias("left_node"), F.col("r.node").alias("right_node")).join(entry("left"), "left_node").join(entry("right"), "right_node")
    once = both.where("left_scaffold = right_scaffold").groupBy("gene", F.col("left_scaffold").alias("scaffold"), "left_node", "right_node").agg(F.min(F.struct("cluster_key", "node_ord", F.col("left_strand").alias("strand"))).alias("s"))
    return once.select("gene", "scaffold", "left_node", "right_node", "s.*")


def score_gate(residues: Column, columns: Column, covered: Column) -> Column:
    """Why a scored candidate is rejected: gap_residues, low_blosum, or null if it passes."""
    few = residues < F.least(F.lit(MIN_GAP_RESIDUES), columns)
    return F.when(few, "gap_residues").when(covered < MIN_COVERED_PCT, "low_blosum")
