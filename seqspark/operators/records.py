"""Operators over alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqspark.functions import sequences as S


def restore_stops(aligned: Column, original: Column) -> Column:
    """The aligned row with * wherever the original, ungapped sequence has one at that residue's ordinal."""
    runs = F.regexp_extract_all(aligned, F.lit("[-.]+|[^-.]+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        n = F.length(r)
        own = F.substring(original, acc["n"] + 1, n)
        pairs = F.zip_with(S.chars(r), S.chars(own), lambda a, o: F.when(o == "*", F.lit("*")).otherwise(a))
        gap = r.rlike("^[-.]")
        return F.struct((acc["n"] + F.when(gap, 0).otherwise(n)).alias("n"), F.concat(acc["out"], F.when(gap, r).otherwise(F.array_join(pairs, ""))).alias("out"))

    return F.aggregate(runs, zero, step, lambda acc: acc["out"])
