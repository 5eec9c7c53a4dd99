"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Every row is logged as (digest, n_points, id). A task is the memtable of its rows and belongs to one of RUNS runs; a run is
flushed as a table sorted by the digest, with one entry for each digest (the identifier that stays, and the rows), and a
filter: a bitmap for each of its digest ranges, a bit for each digest. Compaction merges runs two by two: entries of the
one probe the filter of the other, those that it rules out are taken over as they are, and only the others are
merged by the digest, where the smaller identifier stays and the rows add up. The last run has one entry for each digest. A digest that
several rows share is a hit: the normalised texts of its rows are compared byte for byte with the text of the row that
stays, and rows that differ (a collision) are grouped by their texts instead.

A digest that a third of all rows share is pre-aggregated in the tasks that flush it, joined by a
broadcast (see join_by_key), and its byte comparison is salted, so no task gathers the group.

Defined cases: a null text counts as empty, and empty texts are equal to each other; a null id ranks
after all others and is a row of its own; of equally long texts the smallest id stays; rows repeated with
one id are one document, so each of them is kept when that id stays; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import erase, join_by_key, join_dealt, rows_of, text_of, written

WHITE = " \t\n\x0b\f\r"
#: Rows that a copy of the staying row's text is compared with, at most on average.
ROWS_PER_SALT = 1000


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: Runs that a flush makes; each merge halves their number. Digests of a run for each range of its filter, on average, and bits of a range.
RUNS, PER_RANGE, RANGE_BITS = 4, 2000, 32768


class MergeIndex:
    """A log-structured merge index in written tables; log has the entries as they came, runs the sorted runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.log, self.runs = spark, None, []

    def flush(self, entries: DataFrame) -> None:
        """Logs (digest, sha, n_points, id) and flushes the memtables as sorted runs."""
        self.log = written(entries.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(RUNS))), "log")
        best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id")))
        per = self.log.groupBy("run", "digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        per = written(per, "memtables", self.log)
        self.runs += [self._run(per.where(F.col("run") == r).drop("run"), per) for r in range(RUNS)]
        erase(per)

    def _run(self, entries: DataFrame, of: DataFrame) -> DataFrame:
        return written(entries.select("digest", "best", "group_size").sortWithinPartitions("digest"), "run", of)

    def filter_of(self, run: DataFrame, ranges: int) -> DataFrame:
        """(range, bits): a bitmap for each range of digests."""
        h = F.xxhash64("digest")
        return run.groupBy(_range(h, ranges).alias("range")).agg(F.expr(f"bitmap_construct_agg(pmod(shiftright(xxhash64(digest), 20), {RANGE_BITS}))").alias("bits"))

    def merge(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """One sorted run of the entries of both, which erases them."""
        ranges = max(1, rows_of(one) // PER_RANGE)
        bits = written(self.filter_of(one, ranges), "filter")
        h = F.xxhash64("digest")
        probed = other.withColumn("range", _range(h, ranges)).join(bits, "range", "left")
        at = F.pmod(F.shiftright(h, 20), F.lit(RANGE_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = F.coalesce(F.getbit(byte, at % 8), F.lit(0)) == 1
        probed = written(probed.select("digest", "best", "group_size", maybe.alias("maybe")), "probed", other)
        seen = probed.where("maybe").select("digest", F.col("best").alias("best_2"), F.col("group_size").alias("size_2"))
        both = one.join(seen, "digest", "full").select("digest", F.least("best", "best_2").alias("best"), (F.coalesce("group_size", F.lit(0)) + F.coalesce("size_2", F.lit(0))).alias("group_size"))
        out = self._run(both.unionByName(probed.where("NOT maybe").drop("maybe")), self.log)
        erase(one, other, bits, probed)
        return out

    def compact(self) -> DataFrame:
        """Merges all runs; (digest, keep_id, group_size)."""
        while len(self.runs) > 1:
            self.runs = [self.merge(*self.runs[i : i + 2]) if i + 1 < len(self.runs) else self.runs[i] for i in range(0, len(self.runs), 2)]
        return self.runs[0].select("digest", F.col("best.id").alias("keep_id"), "group_size")


def _range(h: Column, ranges: int) -> Column:
    return F.pmod(h, F.lit(ranges))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept and text_sha256.

    digest may be any function of the normalised text (unless given, SHA-256); the byte comparison makes the result independent
    of its collisions.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    rows = rows.select("id", F.length("text").alias("n_points"), normalised(F.col("text")).alias("norm")).withColumn("sha", sha256(F.col("norm")))
    rows = rows.withColumn("digest", F.unhex("sha") if digest is None else digest(F.col("norm")))
    index = MergeIndex(docs.sparkSession)
    index.flush(rows.select("digest", "sha", "n_points", "id"))
    level = index.compact()
    total = rows_of(index.log)
    placed = join_by_key(index.log.drop("run"), level, ["digest"], "group_size", total)

    hits = _hits(rows, level, index.log)
    clashing = written(_differing(hits), "clashes")
    if not clashing.isEmpty():
        placed = placed.join(clashing, "digest", "left_anti").unionByName(_by_text(hits.join(clashing, "digest", "left_semi")))
    return placed.select(F.col("id").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _hits(rows: DataFrame, level: DataFrame, log: DataFrame) -> DataFrame:
    """The rows whose digest others share too, with their normalised texts; written, as they are read twice."""
    shared = written(level.where("group_size > 1"), "shared")
    near = rows.select("id", "n_points", "norm", "digest")
    return written(join_dealt(near, shared, ["digest"], ["id", "n_points"], log, "shuffle_hash"), "hits")


def _differing(hits: DataFrame) -> DataFrame:
    """The digests of which some row's text differs from that of the row that stays."""
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT)
    stays = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max(F.struct("n_points", "norm")).alias("k"), F.max("group_size").alias("group_size"))
    stays = stays.select("digest", F.col("k.norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("id", "n_points"), salts))
    return salted.join(stays, ["digest", "salt"]).where("norm <> kept_norm").select("digest").distinct()


def _by_text(hits: DataFrame) -> DataFrame:
    """Groups by the texts themselves; for clashing digests only."""
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id")))
    groups = hits.groupBy("norm").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    return hits.drop("keep_id", "group_size").join(groups, "norm").select("digest", sha256(F.col("norm")).alias("sha"), "n_points", "id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))
