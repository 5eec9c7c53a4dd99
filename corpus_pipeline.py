"""The corpus pipeline: quality classifier, line dedup, near-dedup, secret scan and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents. Stages use whole tables only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import line_dedup, near_dedup, packing, quality, secrets
from seqspark.llm._shared import fresh, written

#: No document whose score reaches this is rejected; low, so that clean documents stay.
QUALITY_THRESHOLD = 0.3
WIDTH, PERCENT = 5, 80
MASK = "[secret]"


def _columns(docs: DataFrame) -> list[str]:
    return list(docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on documents and labels, rejects go.

    A null or empty text is scored as one passage without words; rows repeated go or stay together; with no labels to learn
    from all get one score; columns of any name stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return quality.score(docs, model).where(F.col(quality.added(docs)) >= QUALITY_THRESHOLD).select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that has lost all its lines goes too.

    Null and empty texts stay; rows repeated whole are one document; of equal ids the smaller hash of the text is earlier;
    n_chars, if there, is measured anew; other columns of any name stay.
    """
    lines, removed = line_dedup.added(docs)
    out = line_dedup.dedup(docs).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return _measured(out.select(*_columns(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows of a null id and texts without words stay; rows repeated with an id are one document and stay or go together.
    """
    decided = near_dedup.link(docs, width=WIDTH, percent=PERCENT)
    gone = decided.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mask; overlapping spans are one.

    Null and empty texts stay as they are; equal texts get equal masks; n_chars, if there, is measured anew; other columns of
    any name stay. Spans depend on the text alone, so they come back by its digest; a text without characters has no
    spans and is dealt out by its place.
    """
    name, at = fresh(docs, "digest", "spans")
    bare = F.coalesce(F.length("text"), F.lit(0)) == 0
    rows = docs.withColumn(name, F.when(bare, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.md5("text")))
    texts = docs.where(~bare).select(F.md5("text").alias(name), F.col("text").alias("text"))
    found = secrets.spans(texts, key=name).where(F.size("spans") > 0).dropDuplicates([name])
    found = found.select(name, F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(at))
    joined = rows.join(found.hint("shuffle_hash"), name, "left")
    merged = F.aggregate(
        F.col(at),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["text"], F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(F.lit(""))).alias("text"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(merged)
    return _measured(joined.withColumn("text", text).select(*_columns(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; a null text is the end id alone, rows repeated are packed as often."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
