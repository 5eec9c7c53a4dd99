"""Open reading frames between stops, as a table function, and where they lie on the genome."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import codons
from seqspark.functions import sequences as S


ORF = "array<struct<aa:string,frame:int,nt_start:int,nt_end:int,nt:string>>"


_FIELDS = [("aa", pa.string()), ("frame", pa.int32()), ("nt_start", pa.int32()), ("nt_end", pa.int32()), ("nt", pa.string())]
#: Bases of sequences whose reading frames are held as objects of Python, about.
SLICE_BASES = 1 << 20


def stretches(seq: str, min_aa: int, require_start: bool, code: np.ndarray, residues: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The reading frames of one sequence, field by field: all stops of a frame are found at once."""
    whole, places = [], []
    for f in range(3):
        aa = codons.residues_of(seq, code, residues, f)
        stops = np.flatnonzero(aa == ord("*"))
        begins, ends = np.concatenate(([0], stops + 1)), np.append(stops, len(aa))
        if require_start:  # the first M from each begin on
            starts = np.append(np.flatnonzero(aa == ord("M")), len(aa))
            begins = starts[np.searchsorted(starts, begins)]
        some = (ends - begins >= min_aa) & (ends > begins)
        places.append(np.stack([np.full(int(some.sum()), f), begins[some], ends[some]]))
        whole.append(aa.tobytes().decode())
    frame, a, b = np.concatenate(places, 1)
    start, end = frame + 3 * a, frame + 3 * b
    order = np.lexsort((start, frame, a - b))
    frame, a, b, start, end = (x[order] for x in (frame, a, b, start, end))
    found = [whole[f][i:j] for f, i, j in zip(frame.tolist(), a.tolist(), b.tolist(), strict=True)]
    return found, frame, start, end, [seq[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def _listed(seqs: list[str | None], *how) -> pa.ListArray:
    """The reading frames of some sequences, as one Arrow array."""
    each = [None if x is None else stretches(x, *how) for x in seqs]
    full = [e for e in each if e is not None]
    fields = []
    for i, (_, kind) in enumerate(_FIELDS):
        fields.append(pa.array([x for e in full for x in e[i]] if kind == pa.string() else np.concatenate([np.zeros(0, int), *(e[i] for e in full)]).astype(np.int32), kind))
    ends = np.cumsum([0, *(0 if e is None else len(e[0]) for e in each)])
    offsets = pa.array(ends.astype(np.int32), mask=np.array([*(e is None for e in each), False]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=[pa.field(*f) for f in _FIELDS]))


def orfs(seq: Column, min_aa: int, require_start: bool = False) -> Column:
    """Every stop-to-stop stretch of the three forward frames with min_aa residues, longest first.

    An array of (aa, frame, nt_start, nt_end, nt); frame is 0 to 2, nt positions are 0-based and half-open.
    With require_start a stretch begins at its first M, or is left out. Stretches that lie within others stay.
    """
    code, residues = codons.residue_table(1, uracil=False)

    @F.arrow_udf(ORF)
    def run(s: pa.Array) -> pa.Array:
        out, some, n = [], [], 0
        for x in s:
            some.append(x.as_py())
            n += len(some[-1] or "")
            if n >= SLICE_BASES:
                out.append(_listed(some, min_aa, require_start, code, residues))
                some, n = [], 0
        return pa.concat_arrays([*out, _listed(some, min_aa, require_start, code, residues)])

    return run(seq)


def locate(start: Column, end: Column, region_start: Column, region_end: Column, strand: Column) -> Column:
    """1-based inclusive genomic (start, end) of a reading frame in a region that is 1-based; on - the region was read backwards."""
    length = region_end - region_start + 1
    forth = strand == "+"
    return F.struct(
        F.when(forth, region_start + start).otherwise(region_start + length - end).alias("start"),
        F.when(forth, region_start + end - 1).otherwise(region_start + length - start - 1).alias("end"),
    )


def scan_regions(regions: DataFrame, min_aa: Column | int, require_start: bool = False, seq: str = "seq") -> DataFrame:
    """regions (region_start, region_end, strand, seq in genomic order) exploded to their reading frames.

    Adds aa, nt, frame (signed by strand, 1 to 3), hit_start and hit_end; regions of under 6 bases have none.
    """
    read = F.when(F.col("strand") == "-", S.revcomp_upper(F.col(seq))).otherwise(F.col(seq))
    least = min_aa if isinstance(min_aa, int) else 1
    found = regions.where(F.length(seq) >= 6).select("*", F.explode(orfs(read, least, require_start)).alias("_o"))
    if not isinstance(min_aa, int):
        found = found.where(F.length("_o.aa") >= min_aa)
    place = locate(F.col("_o.nt_start"), F.col("_o.nt_end"), F.col("region_start"), F.col("region_end"), F.col("strand"))
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    return found.select(*regions.columns, F.col("_o.aa").alias("aa"), F.col("_o.nt").alias("nt"), (sign * (F.col("_o.frame") + 1)).alias("frame"), place["start"].alias("hit_start"), place["end"].alias("hit_end"))


def subtract(aa_len: Column, known: Column) -> Column:
    """The stretches of 0 to aa_len that no interval of an array of (start, end) covers, as (start, end), half-open."""
    ordered = F.array_sort(known)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        free = k["start"] > acc["at"]
        out = F.when(free, F.array_append(acc["out"], F.struct(acc["at"].alias("start"), F.least(k["start"], aa_len).cast("int").alias("end")))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], k["end"]).cast("int").alias("at"), out.alias("out"))

    def last(acc: Column) -> Column:
        return F.when(acc["at"] < aa_len, F.array_append(acc["out"], F.struct(acc["at"].alias("start"), aa_len.cast("int").alias("end")))).otherwise(acc["out"])

    return F.filter(F.aggregate(ordered, zero, step, last), lambda s: s["end"] > s["start"])
