"""Labelled rows for the classifiers: the split by crc32 of the id, and a bounded sample of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_of, written

FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether the row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most bound labelled documents outside the held-out fold, chosen by a hash of the id; written.

    The bound also proves the size of what is broadcast, and the number of rows that a caller may collect: an id is one row.
    Rows without id or label are not used; an id that repeats in labels counts once, with its largest label, and of an id that
    repeats in docs one text is used, the first by a hash.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    some = usable.groupBy(key).agg((F.max(label) >= 1).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(bound)
    rows = docs.select(F.col(key), text_of(text).alias("text")).join(F.broadcast(some), key)
    once = rows.groupBy(key, "y").agg(F.min_by("text", F.md5("text")).alias("text"))
    return written(once.select(key, "text", "y"), "training")
