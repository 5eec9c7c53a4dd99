"""Aggregates over the columns of alignments, each a group of rows of equal width.

Counts of (column, symbol) cells are summed in the tasks before any shuffle, those of whole alignments over arrays of
cells, so an alignment of any depth moves at most its width times the alphabet. Results are one row for a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import blosum
from seqspark.functions import sequences as S


def cells(rows: DataFrame, group: str, seq: str = "seq", span: bool = True, *extra: str) -> DataFrame:
    """(group, *extra, col, ch): the cells of every row; with span only those of its residue span."""
    parts = S.chars(F.col(seq))
    if span:
        # a row of gaps has the span of one column, and gives that one vote
        start, end = S.residue_start(F.col(seq)), S.residue_end(F.col(seq))
        parts = F.slice(parts, start + 1, end - start)
        return rows.select(group, *extra, start.alias("_s"), F.posexplode(parts).alias("_i", "ch")).select(group, *extra, (F.col("_s") + F.col("_i")).alias("col"), "ch")
    return rows.select(group, *extra, F.posexplode(parts).alias("col", "ch"))


#: Counts that a task holds of several groups.
HELD_COUNTS = 1 << 21
#: Symbols whose counts a consensus needs: - and * are one, which sorts after the letters.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ~"
_GAP = ord("-")


def _counted(rows: DataFrame, group: str, seq: str, count: Callable[[np.ndarray, np.ndarray], np.ndarray], weight: Column | None = None) -> DataFrame:
    """(group, col, k, n): count(cells, weights), an array over columns and k, summed over the rows of a group within a task.

    A row with col -1 and k the width comes with each width of a group. Null sequences do not count.
    """
    used = rows.select(group, F.col(seq).alias("_s"), F.coalesce(weight.cast("long") if weight is not None else F.lit(1).cast("long"), F.lit(0)).alias("_w"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict = {}

        def handed(schema: pa.Schema) -> pa.RecordBatch:
            genes, parts = [], []
            for (gene, width), counts in held.items():
                col, k = np.nonzero(counts)
                parts.append(np.stack([np.append(col, -1), np.append(k, width), np.append(counts[col, k], 1)]))
                genes += [gene] * parts[-1].shape[1]
            held.clear()
            col, k, n = np.concatenate(parts, 1)
            return pa.RecordBatch.from_arrays([pa.array(genes, schema.field(0).type), pa.array(col.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n)], [group, "col", "k", "n"])

        schema = None
        for batch in batches:
            schema, where = batch.schema, {}
            seqs, weights = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i, (gene, s) in enumerate(zip(batch.column(0).to_pylist(), seqs, strict=True)):
                if s is not None:
                    where.setdefault((gene, len(s)), []).append(i)
            for key, at in where.items():
                cells = np.frombuffer("".join([seqs[i] for i in at]).encode("latin-1", "replace"), np.uint8).reshape(len(at), key[1])
                found = count(cells, weights[at])
                held[key] = held[key] + found if key in held else found
            if len(held) > 64 and sum(c.size for c in held.values()) > HELD_COUNTS:
                yield handed(schema)
        if held:
            yield handed(schema)

    return used.mapInArrow(run, f"`{group}` {rows.schema[group].dataType.simpleString()}, col int, k int, n long")


def _symbols(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of each of SYMBOLS in the columns of each row's span; a row of gaps has the span of one column."""
    full = cells != _GAP
    width, some = cells.shape[1], full.any(1)
    if not width:
        return np.zeros((0, len(SYMBOLS)), np.int64)
    first = np.where(some, full.argmax(1), 0)
    last = np.where(some, width - full[:, ::-1].argmax(1), 1)
    col = np.arange(width)
    row, at = np.nonzero((col >= first[:, None]) & (col < last[:, None]))
    which = cells[row, at].astype(np.int64) - ord("A")
    out = np.zeros(width * len(SYMBOLS), np.int64)
    np.add.at(out, at * len(SYMBOLS) + np.where((which >= 0) & (which < 26), which, 26), weights[row])
    return out.reshape(width, -1)


def _assembled(best: DataFrame, group: str, out: str) -> DataFrame:
    """Columns (col, ch) put in order over the width, X where a column is missing; the width comes with col -1."""
    maps = best.groupBy(group).agg(F.max("width").alias("width"), F.map_from_entries(F.collect_list(F.when(F.col("col") >= 0, F.struct("col", "ch")))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit("X"))), "")
    return maps.select(group, F.when(F.col("width") > 0, text).otherwise("").alias(out))


def consensus(rows: DataFrame, group: str, threshold: float, min_depth: int = 0, seq: str = "seq", weight: str | None = None, order: str | None = None) -> DataFrame:
    """(group, consensus): per column the symbol with the largest share of the weights, if over the threshold, else X.

    - and * count as one symbol, which ranks after the letters in ties; columns of less weight than
    min_depth (or none) give X. Symbols other than capitals, - and * raise an error. It is as wide as the widest row or, with
    an order, as the first.
    """
    good = F.when(F.col(seq).rlike("^[A-Z*-]*$"), F.col(seq)).otherwise(S._fail("an alignment symbol is not a capital, - or *", "string"))
    given = rows.withColumn(seq, good)
    some = _counted(given, group, seq, _symbols, F.col(weight) if weight else None)
    counts = some.groupBy(group, "col", "k").agg(F.sum("n").alias("n"))
    # the largest count, of equals the first letter: the gap sign sorts after Z
    best = counts.groupBy(group, "col").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min_by("k", F.struct(-F.col("n"), "k")).alias("k"), F.max("k").alias("width"))
    letter = F.translate(F.substring(F.lit(SYMBOLS), F.col("k") + 1, F.lit(1)), "~", "-")
    winner = F.when((F.col("total") >= max(1, min_depth)) & (F.col("top") / F.col("total") > threshold), letter).otherwise("X")
    wide = F.when(F.col("col") < 0, F.col("width")).alias("width")
    if order is None:
        return _assembled(best.select(group, "col", winner.alias("ch"), wide), group, "consensus")
    first = rows.groupBy(group).agg(F.min_by(F.length(seq), order).alias("width")).select(group, F.lit(-1).alias("col"), F.lit("X").alias("ch"), "width")
    return _assembled(best.where("col >= 0").select(group, "col", winner.alias("ch"), wide).unionByName(first), group, "consensus")


def _filled(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, col): the columns in which some row has no gap."""
    found = _counted(rows, group, seq, lambda cells, _: (cells != _GAP).any(0)[:, None].astype(np.int64))
    return found.where("col >= 0").select(group, "col").distinct()


def empty_columns(rows: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """(group, keep): the columns, in order, in which some row has no gap."""
    return _filled(rows, group, seq).groupBy(group).agg(F.array_sort(F.collect_list("col")).alias("keep"))


def drop_empty_columns(rows: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """The rows without the columns that are gaps in all of them."""
    # kept columns travel as the stretches that they form, and a row is put together of so many parts
    place = F.col("col") - F.row_number().over(W.partitionBy(group).orderBy("col"))
    each = _filled(rows, group, seq).withColumn("_k", place).groupBy(group, "_k").agg(F.min("col").alias("at"), F.count(F.lit(1)).cast("int").alias("n"))
    keep = each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("keep"))
    text = F.array_join(F.transform("keep", lambda r: F.substring(F.col(seq), r["at"] + 1, r["n"])), "")
    return rows.join(keep, group, "left").withColumn(seq, F.coalesce(text, F.lit(""))).drop("keep")


def occupancy(refs: DataFrame, group: str, seq: str = "seq", gaps: tuple[str, ...] = ("-",)) -> DataFrame:
    """(group, col, n_refs, filled, gap_share): how many references have a symbol in each column."""
    n = refs.groupBy(group).agg(F.count(F.lit(1)).alias("n_refs"))
    filled = cells(refs, group, seq, False).groupBy(group, "col").agg(F.sum((~F.col("ch").isin(*gaps)).cast("long")).alias("filled"))
    return filled.join(n, group).select(group, "col", "n_refs", "filled", (F.lit(1.0) - F.col("filled") / F.col("n_refs")).alias("gap_share"))


def pssm(refs: DataFrame, group: str, start: int, end: int, min_occupancy: float = 0.30, seq: str = "seq", count_stops: bool = True, standard_only: bool = False) -> DataFrame:
    """(group, col, aa, score, col_max): BLOSUM62 scores of the 20 residues against the references' mix in each column.

    A column counts if the share of references with a symbol (no - or .) reaches min_occupancy and its best score is over 0.
    count_stops lets * fill a column; standard_only counts only the 20 residues towards the share.
    """
    n = refs.groupBy(group).agg(F.count(F.lit(1)).alias("n_refs"))
    residue = F.upper("ch").isin(*blosum.AMINO)
    fills = residue if standard_only else ~F.col("ch").isin("-", ".", *([] if count_stops else ["*"]))
    inside = cells(refs, group, seq, False).where((F.col("col") >= start) & (F.col("col") < end))
    counts = inside.groupBy(group, "col", F.when(residue, F.upper("ch")).alias("ref_aa")).agg(F.sum(fills.cast("long")).alias("filled"), F.count(F.lit(1)).alias("cnt"))
    per = counts.groupBy(group, "col").agg(F.sum("filled").alias("filled"), F.sum(F.when(F.col("ref_aa").isNotNull(), F.col("cnt"))).alias("total"), F.map_from_entries(F.collect_list(F.when(F.col("ref_aa").isNotNull(), F.struct("ref_aa", "cnt")))).alias("mix"))
    used = per.join(n, group).where((F.col("filled") / F.col("n_refs") >= min_occupancy) & (F.col("total") > 0))
    table = blosum.pair_map()
    score = lambda q: F.aggregate(F.map_entries("mix"), F.lit(0).cast("long"), lambda acc, e: acc + blosum.score(q, e["key"], table) * e["value"]) / F.col("total")
    scored = used.withColumn("scores", F.transform(F.array(*map(F.lit, blosum.AMINO)), lambda q: F.struct(q.alias("aa"), score(q).alias("score"))))
    scored = scored.withColumn("col_max", F.array_max(F.transform("scores", lambda s: s["score"]))).where("col_max > 0")
    return scored.select(group, "col", "col_max", F.inline("scores")).select(group, "col", "aa", "score", "col_max")


def score_window(cands: DataFrame, profile: DataFrame, group: str, start: int, end: int, key: str = "header", seq: str = "seq") -> DataFrame:
    """(group, key, residues, score, full, covered): a candidate's score by a profile, in percent of the best of
    all columns and of the columns in which it has a residue; an unknown residue, * too, scores -4."""
    inside = cells(cands, group, seq, False, key).where((F.col("col") >= start) & (F.col("col") < end) & ~F.col("ch").isin("-", "."))
    col_max = profile.groupBy(group, "col").agg(F.max("col_max").alias("col_max"))
    whole = col_max.groupBy(group).agg(F.sum("col_max").alias("full_max"))
    met = inside.join(col_max, [group, "col"]).join(profile.select(group, "col", F.col("aa").alias("ch"), "score"), [group, "col", "ch"], "left")
    per = met.groupBy(group, key).agg(F.count(F.lit(1)).alias("residues"), F.sum(F.coalesce("score", F.lit(-4.0))).alias("score"), F.sum("col_max").alias("covered_max"))
    share = lambda m: F.when(F.col(m) > 0, F.col("score") / F.col(m) * 100).otherwise(0.0)
    return per.join(whole, group).select(group, key, "residues", "score", share("full_max").alias("full"), share("covered_max").alias("covered"))


def convert_consensus(rows: DataFrame, cons: DataFrame, group: str, limit: int = 8, seq: str = "seq") -> DataFrame:
    """(group, converted): the consensus with ? in columns of its span in which all rows have gaps; runs of ? under
    the limit that another symbol follows become gaps."""
    keep = empty_columns(rows, group, seq)
    c = F.col("consensus")
    start, end = S.residue_start(c, "X"), S.residue_end(c, "X")
    filled = F.coalesce("keep", F.array().cast("array<int>"))
    marked = F.array_join(F.transform(S.chars(c), lambda x, i: F.when((i >= start) & (i < end) & ~F.array_contains(filled, i), F.lit("?")).otherwise(x)), "")
    return cons.join(keep, group, "left").withColumn("m", marked).select(group, _short_marks(F.col("m"), limit).alias("converted"))


def _short_marks(text: Column, limit: int) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"\?+|[^?]+"), F.lit(0))
    n = F.size(runs)
    short = lambda r, i: r.startswith("?") & (F.length(r) < limit) & (i < n - 1)
    return F.array_join(F.transform(runs, lambda r, i: F.when(short(r, i), F.repeat(F.lit("-"), F.length(r))).otherwise(r)), "")


def edge_mask(refs: DataFrame, group: str, fraction: float = 0.5, seq: str = "seq") -> DataFrame:
    """(group, first, last): the columns between which some end column reaches the references' share; all where none does."""
    occ = occupancy(refs, group, seq).withColumn("full", (F.col("filled") / F.col("n_refs") >= fraction))
    per = occ.groupBy(group).agg(F.min(F.when(F.col("full"), F.col("col"))).alias("a"), F.max(F.when(F.col("full"), F.col("col"))).alias("b"), F.max("col").alias("top"))
    return per.select(group, F.coalesce("a", F.lit(0)).alias("first"), F.coalesce("b", "top").alias("last"))


def reference_columns(refs: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """(group, col, ch, n): symbol counts in each column, gaps inside a reference's span included."""
    some = refs.where(F.length(F.ltrim(F.col(seq), F.lit("-"))) > 0)
    return cells(some, group, seq, True).groupBy(group, "col", "ch").agg(F.count(F.lit(1)).alias("n"))


def upper_median(values: Column) -> Column:
    """The upper of the two middle elements."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def median_span(refs: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """(group, start, end): the upper medians of the references' first and last residues."""
    per = refs.groupBy(group).agg(F.collect_list(S.residue_start(F.col(seq))).alias("s"), F.collect_list(S.residue_end(F.col(seq))).alias("e"))
    return per.select(group, upper_median(F.col("s")).alias("start"), upper_median(F.col("e")).alias("end"))
