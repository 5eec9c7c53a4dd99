"""Scalar functions over sequences, as column expressions. Positions count from 0; sequences are ASCII.

A null argument gives null. Where lengths must agree and do not, the functions raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blosum


def chars(seq: Column) -> Column:
    """The characters of a sequence; none of an empty one."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def revcomp(seq: Column) -> Column:
    """Reverse complement by the IUPAC codes, case kept; other characters stay."""
    return F.translate(F.reverse(seq), "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd")


def revcomp_upper(seq: Column) -> Column:
    """Reverse complement in which bases become capitals and all else stays."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def complement_or_n(seq: Column) -> Column:
    """Reverse complement in capitals in which all but the four bases becomes N."""
    return F.translate(F.regexp_replace(F.upper(F.reverse(seq)), "[^ACGT]", "N"), "ACGT", "TGCA")


def canonical(seq: Column) -> Column:
    """The smaller, bytewise, of a sequence and its reverse complement."""
    return F.least(seq, complement_or_n(seq))


def residue_start(seq: Column, gap: str = "-") -> Column:
    """Place of the first residue; 0 where there is none."""
    left = F.length(F.ltrim(seq, F.lit(gap)))
    return F.when(left == 0, 0).otherwise(F.length(seq) - left)


def residue_end(seq: Column, gap: str = "-") -> Column:
    """One past the last residue; 1 where there is none."""
    left = F.length(F.rtrim(seq, F.lit(gap)))
    return F.when(left == 0, 1).otherwise(left)


def find_index_pair(seq: Column, gap: str = "-") -> Column:
    """(start, end) of the residues, end exclusive; (0, 1) where there are only gaps."""
    if len(gap) != 1:
        raise ValueError("the gap must be one character")
    return F.struct(residue_start(seq, gap).alias("start"), residue_end(seq, gap).alias("end"))


def residue_span(seq: Column, none_start: int, none_end: Column | int, inclusive: bool = False) -> Column:
    """The same span by another convention for sequences without residues, and for the end."""
    empty = F.length(F.ltrim(seq, F.lit("-"))) == 0
    end = residue_end(seq) - (1 if inclusive else 0)
    none = F.lit(none_end) if isinstance(none_end, int) else none_end
    return F.struct(F.when(empty, none_start).otherwise(residue_start(seq)).alias("start"), F.when(empty, none).otherwise(end).alias("end"))


def is_same_kmer(a: Column, b: Column) -> Column:
    """Whether no position differs; sequences of unequal length are never the same."""
    return a == b


def count_pairs(a: Column, b: Column, test) -> Column:
    """How many positions pass a test of the two characters, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.arrays_zip(chars(F.substring(a, F.lit(1), n)).alias("a"), chars(F.substring(b, F.lit(1), n)).alias("b"))
    return F.size(F.filter(pairs, lambda p: test(p["a"], p["b"])))


def constrained_distance(consensus: Column, candidate: Column) -> Column:
    """Positions that differ within the candidate's residue span, less the X of the consensus there, 0 at least."""
    start, end = residue_start(candidate), residue_end(candidate)
    con, can = F.substring(consensus, start + 1, end - start), F.substring(candidate, start + 1, end - start)
    differ = count_pairs(con, can, lambda x, y: x != y)
    blank = F.length(con) - F.length(F.replace(con, F.lit("X"), F.lit("")))
    return F.greatest(F.lit(0), differ - blank).cast("long")


def _blosum_checked(value: Column, *seqs: Column) -> Column:
    ok = F.lit(True)
    for s in seqs:
        ok = ok & ~s.rlike("[^" + blosum.ALLOWED.replace("*", r"\*") + "-]")
    return F.when(ok, value).otherwise(_fail("a character has no BLOSUM62 score", "double"))


def blosum62_distance(first: Column, second: Column) -> Column:
    """1 less the score over the larger self-score, gaps as stops; NaN of empty sequences."""
    table = blosum.pair_map()
    a, b = F.translate(first, "-", "*"), F.translate(second, "-", "*")
    pairs = F.arrays_zip(chars(a).alias("a"), chars(F.substring(b, F.lit(1), F.length(a))).alias("b"))

    def total(x: str, y: str) -> Column:
        return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + blosum.score(p[x], p[y], table))

    value = F.lit(1.0) - F.try_divide(total("a", "b").cast("double"), F.greatest(total("a", "a"), total("b", "b")).cast("double"))
    value = F.when(F.length(a) == 0, F.lit(float("nan"))).otherwise(value)
    value = F.when(F.length(second) >= F.length(first), value).otherwise(_fail("the second sequence is shorter", "double"))
    return _blosum_checked(value, first, second)


def blosum62_candidate_to_reference(candidate: Column, reference: Column) -> Column:
    """The same for a candidate and a reference; columns in which the reference has none are skipped and a candidate's gap costs 11."""
    table = blosum.pair_map()
    pairs = F.filter(F.arrays_zip(chars(candidate).alias("c"), chars(reference).alias("r")), lambda p: ~p["r"].isin("-", "*"))
    gap = lambda p: p["c"].isin("-", "*")
    add = lambda value: F.aggregate(pairs, F.lit(0), lambda acc, p: acc + value(p))
    score = add(lambda p: F.when(gap(p), -11).otherwise(blosum.score(p["c"], p["r"], table)))
    own = add(lambda p: F.when(gap(p), -11).otherwise(blosum.score(p["c"], p["c"], table)))
    best = F.greatest(own, add(lambda p: blosum.score(p["r"], p["r"], table)))
    value = F.when(best == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - F.try_divide(score.cast("double"), best.cast("double")))
    value = F.when(F.length(candidate) == F.length(reference), value).otherwise(_fail("sequences must have equal length", "double"))
    return _blosum_checked(value, candidate, reference)


def join_with_exclusions(seq: Column, excluded: Column) -> Column:
    """The sequence with a gap at each residue i of which 3 * i is excluded."""
    return F.array_join(F.transform(chars(seq), lambda c, i: F.when(F.array_contains(excluded, i * 3), F.lit("-")).otherwise(c)), "")


def del_cols(seq: Column, columns: Column, is_nt: bool = False) -> Column:
    """The sequence with gaps in these columns; of nucleotides the two after each as well."""
    hit = lambda i: F.array_contains(columns, i)
    gone = (lambda i: hit(i) | hit(i - 1) | hit(i - 2)) if is_nt else hit
    return F.array_join(F.transform(chars(seq), lambda c, i: F.when(gone(i), F.lit("-")).otherwise(c)), "")


def regions(seq: Column, pattern: str = "[^-]+") -> Column:
    """(start, text) of every run that matches a pattern without empty matches."""
    runs = F.regexp_extract_all(seq, F.lit(pattern), F.lit(0))
    gaps = F.split(seq, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["g"]) + F.length(p["r"])).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + F.length(p["g"])).alias("start"), p["r"].alias("text"))).alias("out"),
    )
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), runs.alias("r")), lambda p: p["r"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def mask_small_regions(seq: Column, min_length: int) -> Column:
    """Residue runs shorter than min_length become X, and so do gaps."""
    runs = F.regexp_extract_all(seq, F.lit("[^-]+|-+"), F.lit(0))
    blank = lambda r: r.startswith("-") | (F.length(r) < min_length)
    return F.array_join(F.transform(runs, lambda r: F.when(blank(r), F.repeat(F.lit("X"), F.length(r))).otherwise(r)), "")


def consensus_distance(consensus: Column, candidate: Column, min_length: int, min_overlap: int) -> Column:
    """(distance, length): over the candidate's residue runs in which at least min_overlap positions are no X
    in the consensus nor in the candidate (whose runs under min_length are masked)."""
    masked = mask_small_regions(candidate, min_length)

    def one(r: Column) -> Column:
        n = F.length(r["text"])
        con, can = F.substring(consensus, r["start"] + 1, n), F.substring(masked, r["start"] + 1, n)
        return F.struct(
            count_pairs(con, can, lambda x, y: (x != "X") & (y != "X")).alias("overlap"),
            count_pairs(con, can, lambda x, y: (x != "X") & (x != y)).alias("distance"),
            F.least(F.length(con), F.length(can)).alias("length"),
        )

    counted = F.filter(F.transform(regions(candidate), one), lambda r: r["overlap"] >= min_overlap)
    add = lambda f: F.aggregate(counted, F.lit(0).cast("long"), lambda acc, r: acc + r[f])
    return F.struct(add("distance").alias("distance"), add("length").alias("length"))


def normalize_record(seq: Column) -> Column:
    """Capitals, with points as gaps and without blanks."""
    return F.upper(F.translate(seq, ". ", "-"))


def mask_stops(seq: Column) -> Column:
    return F.translate(seq, "*", "X")


def trim_locus(start: Column, end: Column, strand: Column, left: Column, right: Column) -> Column:
    """Genomic start and end after cutting residues (three bases each) from a hit's left and right; never below 0."""
    forth = strand == "+"
    cut_low, cut_high = F.when(forth, left).otherwise(right) * 3, F.when(forth, right).otherwise(left) * 3
    return F.struct((start + cut_low).alias("start"), F.greatest(F.lit(0).cast("long"), end - cut_high).alias("end"))


def region_label(scaffold: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.concat(scaffold, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("("), strand, F.lit(")"))


def header_field(header: Column, n: int, default: Column | None = None) -> Column:
    """Field n of a header between bars; the default where there are too few."""
    parts = F.split(header, r"\|")
    return F.when(F.size(parts) > n, parts[n]).otherwise(default if default is not None else F.lit(""))


def rename_node(header: Column, tag: Column) -> Column:
    """The header with another node field, if it has one."""
    parts = F.split(header, r"\|")
    return F.when(F.size(parts) > 3, F.array_join(F.transform(parts, lambda p, i: F.when(i == 3, tag).otherwise(p)), "|")).otherwise(header)


def is_reference(header: Column) -> Column:
    return header.endswith(".")


def spliced(nt: Column, first: Column, count: Column) -> Column:
    """Whether a block of residues (first, count) reads, in one phase, from a donor GT or GC to an acceptor AG, over 30 bases or more."""
    up, a, b = F.upper(nt), first * 3, (first + count) * 3
    one = lambda p: F.substring(up, a + (p + 1), F.lit(2)).isin("GT", "GC") & (F.substring(up, b + (p - 1), F.lit(2)) == "AG") & (b + p <= F.length(up))
    return (b - a >= 30) & (one(0) | one(1) | one(2))


def n_chunks(seq: Column, min_length: int) -> Column:
    """The stretches without N that have min_length bases."""
    return F.filter(F.split(seq, "[Nn]", -1), lambda c: F.length(c) >= min_length)


def low_complexity(
    seq: Column, window: int = 60, step: int = 15, dinuc: float = 2.5, trinuc: float = 3.75, min_segment: int = 30, min_fraction: float = 0.5, min_bp: int = 100, min_windows: int = 4
) -> Column:
    """Whether enough windows of the stretches of bases have low entropy of pairs or triples; see LowComplexity."""
    from seqspark.operators.complexity import flag

    return flag(seq, window, step, dinuc, trinuc, min_segment, min_fraction, min_bp, min_windows)
