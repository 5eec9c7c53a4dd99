"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines (blank ones left out, others with outer white space removed). Lines that
occur once end every repeated run, so only repeated lines go on. Prefix doubling ranks all suffixes by
their first line, then by 2, 4, 8, ... lines: the distinct pairs of neighbouring ranks are counted,
sorted over the cluster by range and numbered by the partitions' offsets. A repeated run counts
from MIN_WORDS words on, and no run needs more than MIN_WORDS lines for that, so the array is built to that
depth: suffixes with equal ranks there form the longest-common-prefix intervals of each shortest run that
counts, from a line on or up to a line. The first place of an interval stays; the others are later copies and
their lines go. A maximal repeated run is the union of such shortest runs, so all of it goes, whatever its length.

Ranks reach the lines by join_by_key, and counts are summed in the tasks first, so a line that a third
of all documents share gathers nowhere.

Defined cases: earlier is by id (null last), then by a hash of the text, then by place; runs
within one document count; a null text stays null; rows repeated whole (id and text) are one document and each
gets its result; texts of any length are read whole; of a text that loses lines the others are joined by
line feeds; an empty table gives an empty result; other columns are kept, whatever their names. A word is a run of
characters that are no white space, so blanks alone add none.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import erase, fresh, join_by_key, rows_of, small_batches, written

MIN_WORDS = 10
#: Rows whose texts a worker holds as Python strings at once.
SLICE = 500
PLACE = ("no_id", "id", "print", "pos")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """no_id, id, print (of the text), pos among its lines, words, line (a 128-bit hash)."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, SLICE):
                some = b.slice(first, SLICE)
                which, pos, words, hashes = [], [], [], []
                for i, t in enumerate(some.column(3).to_pylist()):
                    p = 0
                    for x in t.split("\n"):
                        if x := x.strip():
                            which.append(i)
                            pos.append(p)
                            words.append(len(x.split()))
                            hashes.append(xxhash.xxh3_128_digest(x.encode()))
                            p += 1
                at = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(at) for c in range(3)), pa.array(pos, pa.int32()), pa.array(words, pa.int32()), pa.array(hashes, pa.binary())], names=[*PLACE, "words", "line"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return small_batches(rows).mapInArrow(run, f"no_id boolean, id {kind}, print long, pos int, words int, line binary")


def dense_ranks(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows of df, whose by columns are distinct, with their rank in the order of these columns.

    The rows are sorted by range; a row's rank is its place in its partition plus the rows of the
    partitions before, one number for each partition.
    """
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"))
    placed = written(placed, "sorted", df if hasattr(df, "written_path") else None)
    before, sizes = 0, placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets = []
    for r in sizes:
        offsets.append((r.part, before))
        before += r.n
    first = df.sparkSession.createDataFrame(offsets, "part int, first long")
    out = placed.join(F.broadcast(first), "part").select(*df.columns, (F.col("first") + F.col("place") + 1).alias("rank"))
    out.written_path = placed.written_path
    return out


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows whose by columns others share, with a column name of these columns' ranks; written."""
    counts = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("shared")).where("shared > 1"), "counts", rows)
    total = counts.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
    ranks = dense_ranks(counts, by)
    out = written(join_by_key(rows, ranks, by, "shared", total, "inner").withColumnRenamed("rank", name).drop("shared"), "ranked", rows)
    erase(counts, ranks)
    return out


def _doc() -> W:
    return W.partitionBy("no_id", "id", "print")


def _place(c: Column | None = None) -> Column:
    return F.struct(*(F.col(x) for x in PLACE[:3]), (F.col("pos") if c is None else c).alias("pos"))


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(no_id, id, print, pos) of the lines that belong to a later copy of a repeated run."""
    ranked = _ranked(lines, ["line"], "rank")
    seq = written(ranked.drop("line").distinct(), "suffixes", ranked)
    erase(ranked)
    levels = [seq.select(*PLACE, F.col("rank").alias("r"))]
    depth = 1
    while 2 * depth <= min_words:
        # a suffix that has no partner at this depth has none at any greater one
        here = levels[-1]
        lead = lambda c, d=depth: F.lead(c, d).over(_doc().orderBy("pos"))
        pairs = here.select(*PLACE, "r", lead("pos").alias("p2"), lead("r").alias("r2")).where(F.col("p2") == F.col("pos") + depth).drop("p2")
        pairs = written(pairs, "pairs", seq)
        level = _ranked(pairs, ["r", "r2"], "rank")
        erase(pairs)
        levels.append(level.select(*PLACE, F.col("rank").alias("r")))
        depth *= 2
    runs = written(_runs(seq, min_words), "runs", seq)
    shared = None
    for k, ranks in enumerate(levels):
        some = runs.where(F.floor(F.log2("m")) == k)
        ranks = ranks.select(*(F.col(c).alias(f"k_{c}") for c in PLACE), "r")

        def at(df: DataFrame, pos: Column, name: str, ranks=ranks) -> DataFrame:
            on = (df.no_id == ranks.k_no_id) & df.id.eqNullSafe(ranks.k_id) & (df.print == ranks.k_print) & (pos == ranks.k_pos)
            return df.join(ranks, on).drop(*(f"k_{c}" for c in PLACE)).withColumnRenamed("r", name)

        both = at(at(some, some.pos, "r1"), F.col("pos") + F.col("m") - (1 << k), "r2")
        shared = both if shared is None else shared.unionByName(both)
    shared = written(shared, "intervals", runs)
    first = written(shared.groupBy("m", "r1", "r2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first", shared)
    erase(runs)
    later = join_by_key(shared, first, ["m", "r1", "r2"], "n", max(1, rows_of(shared)), "inner").where(F.col("first") != _place())
    return later.select("no_id", "id", "print", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()


def _runs(seq: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of repeated lines with min_words words, from each line on and up to each line: place and lines m."""
    island = F.col("pos") - F.row_number().over(_doc().orderBy("pos"))
    rows = seq.withColumn("island", island)
    w = W.partitionBy("no_id", "id", "print", "island").orderBy("pos")
    rows = rows.withColumn("sum", F.sum("words").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ahead = F.collect_list("sum").over(w.rowsBetween(0, min_words - 1))
    behind = F.collect_list(F.col("sum") - F.col("words")).over(w.rowsBetween(1 - min_words, 0))
    rows = rows.select(*PLACE, "sum", "words", ahead.alias("ahead"), behind.alias("behind"))
    start = F.col("sum") - F.col("words")
    forth = F.size("ahead") - F.size(F.filter("ahead", lambda x: x - start >= min_words)) + 1
    back = F.size("behind") - F.size(F.filter("behind", lambda x: F.col("sum") - x >= min_words)) + 1
    on = rows.select(*PLACE, forth.alias("m")).where(F.col("m") <= F.size("ahead"))
    upto = rows.withColumn("m", back).where(F.col("m") <= F.size("behind")).select("no_id", "id", "print", (F.col("pos") - F.col("m") + 1).cast("int").alias("pos"), "m")
    return on.unionByName(upto).distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the texts that are left, and n_lines and n_removed of each (blank lines do not count).

    Where docs has columns of these names they stay as they are, and the counts get underscores in front; see added().
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    counts = added(docs)
    own, c_id, c_print, c_gone = fresh(docs, "own", "gone_id", "gone_print", "gone")
    lines = written(_lines(docs, key, text), "lines")
    gone = later_copies(lines, min_words).groupBy("no_id", "id", "print").agg(F.collect_list("pos").alias("gone"))
    gone = written(gone, "gone", lines).select(F.col("id").alias(c_id), F.col("print").alias(c_print), F.col("gone").alias(c_gone))
    erase(lines)
    rows = docs.withColumn(own, F.xxhash64(text))
    joined = rows.join(gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(c_id)) & (F.col(own) == F.col(c_print)), "left").select(*docs.columns, c_gone)
    col = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                texts, n, lost = [], [], []
                for t, g in zip(b.column(col).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    parts = [] if t is None else t.split("\n")
                    p, keep, out = 0, [], set(g or ())
                    for x in parts:
                        full = bool(x.strip())
                        if not (full and p in out):
                            keep.append(x)
                        p += full
                    texts.append("\n".join(keep) if out else t)
                    n.append(p)
                    lost.append(len(out))
                cols = list(b.columns[:-1])
                cols[col] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=[*b.schema.names[:-1], *counts])

    return small_batches(joined).mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts)]))


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that dedup() adds to docs."""
    return fresh(docs, "n_lines", "n_removed")
