"""Genetic codes and codon expressions.

Each NCBI table is kept as its differences from the standard code. Translation looks residues up in an array by the codes
of three bases, for a whole sequence at once, in an Arrow function: a lambda over codons takes some ten times as long.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "TCAG"
CODONS = ["".join(c) for c in product(BASES, repeat=3)]
STANDARD = dict(zip(CODONS, "".join(("FFLLSSSSYY**CC*W", "LLLLPPPPHHQQRRRR", "IIIMTTTTNNKKSSRR", "VVVVAAAADDEEGGGG")), strict=True))
#: The genetic codes of NCBI as differences from the standard one. Table id to "codons=residue" changes.
CHANGES = {
    1: "", 2: "AGA,AGG=* ATA=M TGA=W", 3: "ATA=M CTT,CTC,CTA,CTG=T TGA=W", 4: "TGA=W", 5: "AGA,AGG=S ATA=M TGA=W", 6: "TAA,TAG=Q",
    9: "AAA=N AGA,AGG=S TGA=W", 10: "TGA=C", 11: "", 12: "CTG=S", 13: "AGA,AGG=G ATA=M TGA=W", 14: "AAA=N AGA,AGG=S TAA=Y TGA=W", 15: "TAG=Q", 16: "TAG=L",
    21: "TGA=W ATA=M AGA,AGG=S AAA=N", 22: "TCA=* TAG=L", 23: "TTA=*", 24: "AGA=S AGG=K TGA=W", 25: "TGA=G", 26: "CTG=A", 27: "TAA,TAG=Q TGA=W",
    28: "TAA,TAG=Q TGA=W", 29: "TAA,TAG=Y", 30: "TAA,TAG=E", 31: "TGA=W TAA,TAG=E", 32: "TAG=W", 33: "TAA=Y AGA=S AGG=K TGA=W",
}


def genetic_code(table: int = 1) -> dict[str, str]:
    """Codon (in T, C, A, G) to residue, * for a stop."""
    if table not in CHANGES:
        raise ValueError(f"Unknown NCBI codon table id: {table}")
    code = dict(STANDARD)
    for change in CHANGES[table].split():
        codons, residue = change.split("=")
        code |= dict.fromkeys(codons.split(","), residue)
    return code


def codons(seq: Column) -> Column:
    """The whole codons of a sequence, as an array."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def residue_table(table: int = 1, uracil: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A code of 0 to 4 for each byte (4: no base), and the residue of each of the 125 triples of codes."""
    code = np.full(256, 4, np.int64)
    for i, c in enumerate(BASES):
        code[[ord(c), ord(c.lower())]] = i
    if uracil:
        code[[ord("U"), ord("u")]] = code[ord("T")]
    residues = np.full(125, ord("X"), np.uint8)
    for codon, aa in genetic_code(table).items():
        a, b, c = (code[ord(x)] for x in codon)
        residues[a * 25 + b * 5 + c] = ord(aa)
    return code, residues


def triples_of(seq: str, code: np.ndarray, skip: int = 0) -> np.ndarray:
    """The place in a residue table of each codon of a sequence from a base on."""
    x = code[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)[skip:]]
    n = len(x) // 3 * 3
    return x[0:n:3] * 25 + x[1:n:3] * 5 + x[2:n:3]


def residues_of(seq: str, code: np.ndarray, residues: np.ndarray, skip: int = 0) -> np.ndarray:
    """The residues, as bytes, of a sequence from a base on."""
    return residues[triples_of(seq, code, skip)]


def translate(seq: Column, table: int = 1, uracil: bool = True) -> Column:
    """Residues of a nucleotide sequence; codons with any other letter give X, a partial last codon nothing.

    Case does not matter; U reads as T unless uracil is off.
    """
    code, residues = residue_table(table, uracil)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else residues_of(x, code, residues).tobytes().decode() for x in s], dtype=object)

    return run(seq)


#: Residues of a batch that translate_all returns, about.
BATCH_RESIDUES = 4 << 20


def translate_all(df: DataFrame, key: str, seq: str, tables: list[int]) -> DataFrame:
    """(key, code, aa): each sequence by each of the tables; none of a null one. A sequence is read once, and a worker holds few of its results."""
    code = residue_table()[0]
    every = [(t, residue_table(t)[1]) for t in tables]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            at, codes, found, n = [], [], [], 0
            kind = pa.int32()

            def handed(batch: pa.RecordBatch, at: list, codes: list, found: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(codes, kind), pa.array(found, pa.string())], [key, "code", "aa"])

            for i, x in enumerate(batch.column(1)):
                x = x.as_py()
                if x is None:
                    continue
                triples = triples_of(x, code)
                for t, residues in every:
                    at.append(i)
                    codes.append(t)
                    found.append(residues[triples].tobytes().decode())
                    n += len(triples)
                    if n >= BATCH_RESIDUES:
                        yield handed(batch, at, codes, found)
                        at, codes, found, n = [], [], [], 0
            if at:
                yield handed(batch, at, codes, found)

    return df.select(key, seq).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, code int, aa string")


def trim_to_codon(seq: Column) -> Column:
    return F.substring(seq, F.lit(1), F.length(seq) - F.length(seq) % 3)


def join_by_tripled_index(seq: Column, positions: Column) -> Column:
    """The codons at these codon positions, in the given order, repeats included; out of range is an error."""
    parts = codons(seq)
    return F.array_join(F.transform(positions, lambda i: F.element_at(parts, i.cast("int") + 1)), "")


def join_triplets_with_exclusions(seq: Column, first: Column, second: Column) -> Column:
    """Codons with those whose first position is in either set blanked; a partial last codon is an error."""
    gone = F.array_union(first, second)
    out = F.array_join(F.transform(codons(seq), lambda c, i: F.when(F.array_contains(gone, i * 3), F.lit("---")).otherwise(c)), "")
    return F.when(F.length(seq) % 3 == 0, out).otherwise(F.raise_error(F.lit("sequence length must be a multiple of 3")).cast("string"))


def code_sql(table: int = 1) -> str:
    """The code as a MAP literal of DuckDB."""
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in genetic_code(table).items()) + "}"
