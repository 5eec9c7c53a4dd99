"""Joins and sweeps over intervals (key, start, end), ends inclusive unless said.

Range conditions become equi-joins on bins of the line: an interval is copied into each bin that it
touches, and a pair counts in the bin in which the later one starts, so no pair is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column, least: int) -> Column:
    """(start, end) common to two intervals if at least so long, else null."""
    a, b = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(b - a >= least, F.struct(a.alias("start"), b.alias("end")))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int, inclusive: bool = True) -> DataFrame:  # noqa: E741
    """All pairs of rows with equal keys and common points. Other column names must differ."""
    bins = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    (ls, le), (rs, re) = l, r
    meet = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if inclusive else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bin")
    return bins(left, ls, le).join(bins(right, rs, re), [*keys, "_bin"]).where(meet & first).drop("_bin")


def query_tree(tree: DataFrame, queries: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Stored intervals (start, end, value) that meet each query (q_start, q_end), in order of start, end."""
    return overlap_join(queries, tree, keys, ("q_start", "q_end"), ("start", "end"), width)


def nearest(queries: DataFrame, exons: DataFrame, keys: list[str], at: str, side: str) -> DataFrame:
    """queries with the column bound: as-of join with the exons (start, end) of the same keys.

    left: the end of that exon which, going back by start, is the first to end before the position (0 if none). right: the
    smallest start after the position (null if none).
    """
    if side == "right":
        marks = exons.select(*keys, F.col("start").alias("_p"), F.col("start").alias("_v"), F.lit(1).alias("_o"))
        asks = queries.select("*", F.col(at).alias("_p"), F.lit(None).cast(exons.schema["start"].dataType).alias("_v"), F.lit(2).alias("_o"))
        # read from the right, where the last start met is the nearest: a frame that ends at the last row is summed anew for each row
        w = W.partitionBy(*keys).orderBy(F.col("_p").desc(), F.col("_o").desc()).rowsBetween(W.unboundedPreceding, -1)
        found = F.when(F.col("_p").isNotNull(), F.last("_v", ignorenulls=True).over(w))
        both = asks.unionByName(marks, allowMissingColumns=True)
        # an exon that starts at the position itself does not count: it is met after the query
        return both.withColumn("bound", found).where("_o = 2").select(*queries.columns, "bound")
    # going back by start, an exon that ends before the position is always met before those that start earlier;
    # of the exons that start at or before it, the last by start among those with end < position
    if side != "left":
        raise ValueError("side is left or right")
    w = W.partitionBy(*keys).orderBy(F.col("_p"), F.col("_o"))
    starts = exons.select(*keys, F.col("end").alias("_p"), F.struct("start", "end").alias("_v"), F.lit(2).alias("_o"))
    asks = queries.select("*", F.col(at).alias("_p"), F.lit(None).cast(starts.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_o"))
    both = asks.unionByName(starts, allowMissingColumns=True)
    # by end: all exons with end < position, of which the one with the largest start is the first met
    best = F.max("_v").over(w.rowsBetween(W.unboundedPreceding, -1))
    return both.withColumn("_b", best).where("_o = 1").select(*queries.columns, F.coalesce(F.col("_b.end"), F.lit(0)).cast("long").alias("bound"))


def contained(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the column inside: whether another interval of the same keys covers it.

    Of equal intervals each covers the others, so all of them count as inside.
    """
    before = W.partitionBy(*keys).orderBy(F.col("start"), F.col("end").desc()).rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(*keys, "start", "end")
    covered = F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))
    return df.withColumn("inside", covered | (F.count(F.lit(1)).over(same) > 1))


def covers(native_start: Column, native_end: Column, start: Column, end: Column, share: float = 0.8) -> Column:
    """Whether an interval holds a native one, or at least that share of its bases (inclusive)."""
    common = F.least(native_end, end) - F.greatest(native_start, start) + 1
    return ((start <= native_start) & (end >= native_end)) | (F.greatest(F.lit(0), common) / (native_end - native_start + 1) >= share)


def blocks(df: DataFrame, keys: list[str], col: str, reach: int = 1) -> DataFrame:
    """(keys, start, end, n): runs of values no further than reach from one to the next."""
    w = W.partitionBy(*keys).orderBy(col)
    new = F.coalesce((F.col(col) - F.lag(col).over(w) > reach).cast("int"), F.lit(1))
    marked = df.select(*keys, col).distinct().withColumn("_new", new).withColumn("_block", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_block").agg(F.min(col).alias("start"), F.max(col).alias("end"), F.count(F.lit(1)).alias("n")).drop("_block")


def consecutive_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_a, node_b, gap_start, gap_end) between neighbours by start: from one's inclusive end to the next's start.

    Groups whose first member by ord has a negative frame go from the highest start down.
    """
    first = F.first("frame").over(W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    order = F.when(first < 0, -F.col("start")).otherwise(F.col("start"))
    w = W.partitionBy(*keys).orderBy("_o", "ord", "end")
    rows = df.withColumn("_o", order).withColumn("node_b", F.lead("node").over(w)).withColumn("gap_end", F.lead("start").over(w))
    return rows.where("node_b IS NOT NULL").select(*keys, F.col("node").alias("node_a"), "node_b", F.col("end").alias("gap_start"), "gap_end")


def qualify_gap(start: Column, end: Column, ref_gap_before: Column, low: int = 10, high: int = 250) -> Column:
    """(effective, min_aa) of a gap whose columns that are no reference gaps number low or more and less than high, else null.

    ref_gap_before holds, at place i, the number of reference gaps before column i.
    """
    effective = (end - start) - (F.get(ref_gap_before, end) - F.get(ref_gap_before, start))
    return F.when((effective >= low) & (effective < high), F.struct(effective.alias("effective"), F.greatest(F.lit(10), F.floor(effective / 2)).alias("min_aa")))


#: Ranges are merged first among those that start in one stretch of the genome of this length.
STRETCH = 1 << 17


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): ranges of equal keys that meet, put together."""
    w = W.partitionBy(*keys).orderBy("lo", "hi")
    new = F.coalesce((F.col("lo") > F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    marked = ranges.withColumn("_new", new).withColumn("_b", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_b")


def needed_ranges(nodes: DataFrame, cluster_keys: list[str], margin: int = 8, flank: int = 15000) -> DataFrame:
    """(scaffold, lo, hi): 0-based half-open spans of the genome that the clusters' gaps and flanks need, merged.

    Each step is dealt out over all shuffle partitions: left to their size, few tasks would sort many millions of rows each. A
    scaffold's ranges are merged by stretches first, and what these leave by scaffold.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = nodes.select(*dict.fromkeys([*cluster_keys, "scaffold", "start", "end"])).repartition(n, *cluster_keys, "scaffold")
    spans = ends.groupBy(*cluster_keys, "scaffold").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    halo = margin + flank
    wide = spans.select("scaffold", F.greatest(F.lit(0).cast("long"), F.col("s") - halo).alias("lo"), (F.col("e") + halo).alias("hi"))
    near = merged(wide.withColumn("_at", F.floor(F.col("lo") / STRETCH)).repartition(n, "scaffold", "_at"), ["scaffold", "_at"])
    return merged(near.drop("_at").repartition(n, "scaffold"), ["scaffold"])


def fetch_ranges(ranges: DataFrame, chunks: DataFrame, size: int = 65536) -> DataFrame:
    """(scaffold, lo, hi, seq): the bases of each range, from chunks (scaffold, blk, seq) of a size, by an equi-join on the block."""
    wanted = ranges.withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    met = wanted.join(chunks.select("scaffold", F.col("blk").cast("long").alias("blk"), "seq"), ["scaffold", "blk"])
    parts = met.groupBy("scaffold", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("blk", "seq"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    skip = (F.col("lo") - F.element_at("p", 1)["blk"] * size).cast("int")
    return parts.select("scaffold", "lo", "hi", F.substring(whole, skip + 1, (F.col("hi") - F.col("lo")).cast("int")).alias("seq"))
