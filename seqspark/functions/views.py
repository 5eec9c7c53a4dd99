"""Sequence-shaped views over text columns, written so that plain SQL engines derive the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTNN"


def nucleotides(text: Column) -> Column:
    """Letters of a text folded onto A, C, G, T and N; other characters are removed first."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


#: The same in DuckDB's dialect, for a column named text.
NT_SQL = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"
