"""Readers and writers of sequence files: FASTA, FASTQ, GFF and cluster tables.

Files are read by Spark's own text reader (gzip included), so any path that Spark opens will do. Records
of one file are kept in order by ord.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqspark.functions import sequences as S

FASTA_ENDINGS, FASTQ_ENDINGS = ("fa", "fasta", "fna", "fas", "fsa_nt"), ("fq", "fastq")


def detect_format(path: str) -> str:
    """fasta or fastq, by the ending before an optional .gz; else an error."""
    ending = re.sub(r"\.gz$", "", path, flags=re.I).rpartition(".")[2].lower()
    if ending in FASTA_ENDINGS:
        return "fasta"
    if ending in FASTQ_ENDINGS:
        return "fastq"
    raise ValueError(f"not a FASTA or FASTQ file: {path}")


def _whole(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, header, seq): the header whole, sequence lines trimmed and joined. What stands before the first > is skipped."""
    records = F.split(F.concat(F.lit("\n"), "value"), "\n>")
    parts = _whole(spark, paths).select("path", F.posexplode(F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(0)))).alias("ord", "record"))
    lines = F.split("record", "\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(x, r"[\t ]+$", ""))), "")
    return parts.select("path", "ord", F.trim(lines[0]).alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ord, header, seq, quality) of records of four lines each."""
    lines = F.split(F.regexp_replace("value", r"\n+\z", ""), "\n")  # a read may be empty, and its line with it
    at = F.sequence(F.lit(0), F.floor(F.size("lines") / 4).cast("int") - 1)
    rows = _whole(spark, paths).select("path", lines.alias("lines")).where(F.size("lines") >= 4)
    rec = rows.select("path", F.explode(F.transform(at, lambda i: F.struct(i.alias("ord"), F.get("lines", i * 4).alias("h"), F.get("lines", i * 4 + 1).alias("seq"), F.get("lines", i * 4 + 3).alias("q")))).alias("r"))
    return rec.select("path", F.col("r.ord").alias("ord"), F.regexp_replace("r.h", "^@", "").alias("header"), F.col("r.seq").alias("seq"), F.col("r.q").alias("quality"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_rank, ord, header, seq) of FASTA and FASTQ files, ranked by name, then path."""
    ranked = sorted(paths, key=lambda p: (p.rpartition("/")[2], p))
    out = None
    for rank, path in enumerate(ranked):
        df = read_fasta(spark, path) if detect_format(path) == "fasta" else read_fastq(spark, path)
        df = df.select(F.lit(rank).alias("file_rank"), "ord", "header", "seq")
        out = df if out is None else out.unionByName(df)
    return out


def fasta_lines(header: Column, seq: Column, mask_stops: bool = False) -> Column:
    """A record as text; with mask_stops * is written as X."""
    return F.concat(F.lit(">"), header, F.lit("\n"), S.mask_stops(seq) if mask_stops else seq)


def write_fasta(df: DataFrame, path: str, order: list[str] | None = None, mask_stops: bool = False) -> None:
    rows = df.orderBy(*order) if order else df
    rows.select(fasta_lines(F.col("header"), F.col("seq"), mask_stops).alias("value")).write.mode("overwrite").text(path)


def write_dedupe(df: DataFrame, path: str) -> None:
    """>id|count records in the order of the ids."""
    rows = df.orderBy("id").select(F.concat_ws("|", F.col("id").cast("string"), F.col("n").cast("string")).alias("header"), "seq")
    rows.select(fasta_lines(F.col("header"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    split = _whole(spark, path).select("path", F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return split


def attribute(attrs: Column, name: str, blank_ends: bool = True) -> Column:
    """The value of a GFF attribute, which ends at ; (and, for the editor, at a blank); null if it is missing."""
    stop = r"[^; ]*" if blank_ends else r"[^;]*"
    value = F.regexp_extract(attrs, rf"(?:^|;)\s*{name}=({stop})", 1)
    return F.when(attrs.rlike(rf"(?:^|;)\s*{name}="), value)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(name, scaffold, start, end, strand): rows of nine fields with a Name; a bad number is 0, of equal names the last counts."""
    rows = _lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 9)
    number = lambda i: F.coalesce(F.expr(f"try_cast(trim(f[{i}]) AS BIGINT)"), F.lit(0).cast("long"))
    named = rows.select("ord", attribute(F.col("f")[8], "Name", False).alias("name"), F.col("f")[0].alias("scaffold"), number(3).alias("start"), number(4).alias("end"), F.col("f")[6].alias("strand")).where("name IS NOT NULL")
    last = named.groupBy("name").agg(F.max_by(F.struct("scaffold", "start", "end", "strand"), "ord").alias("v"))
    return last.select("name", "v.*")


def read_gff_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line, is_comment, fields, scaffold, start, end, strand, name, parent, frame) for editing; rows of fewer than nine fields are left out."""
    rows = _lines(spark, path).where(F.col("line") != "").withColumn("is_comment", F.col("line").startswith("#")).withColumn("fields", F.split("line", "\t"))
    rows = rows.where(F.col("is_comment") | (F.size("fields") >= 9))
    data = ~F.col("is_comment")
    attrs = F.col("fields")[8]
    number = lambda i: F.when(data, F.col("fields")[i].cast("long"))
    return rows.select(
        "ord", "line", "is_comment", "fields", F.when(data, F.col("fields")[0]).alias("scaffold"), number(3).alias("start"), number(4).alias("end"), F.when(data, F.col("fields")[6]).alias("strand"),
        F.when(data, attribute(attrs, "Name")).alias("name"), F.when(data, attribute(attrs, "Parent")).alias("parent"), F.when(data, F.split(attribute(attrs, "Note"), ",")[0]).alias("frame"),
    )


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cluster_key, node_ord, node, iso_type) of a cluster table, whose first line is skipped."""
    rows = _lines(spark, path).where((F.col("ord") > 0) & (F.trim("line") != "")).withColumn("f", F.split("line", ",")).where(F.size("f") >= 6)
    gene = F.regexp_replace(F.col("f")[0], r"\.gz$", "")
    return rows.select(gene.alias("gene"), F.col("f")[1].alias("cluster_key"), F.when(F.size("f") > 7, F.col("f")[7]).otherwise("").alias("iso_type"), F.posexplode(F.split(F.col("f")[5], ";")).alias("node_ord", "node")).select("gene", "cluster_key", "node_ord", "node", "iso_type")


def genome_chunks(records: DataFrame, size: int = 65536) -> DataFrame:
    """(scaffold, blk, seq) of sequences (header, seq), cut into blocks."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return records.select(F.col("header").alias("scaffold"), F.posexplode(cut).alias("blk", "seq"))


def find_gff(existing: list[str], sub_dir: str) -> str | None:
    """The annotation to use of these relative paths: in outlier/<sub_dir>, outlier/resolve or <sub_dir>, the first by name that ends in _coords.gff."""
    for folder in (f"outlier/{sub_dir}", "outlier/resolve", sub_dir):
        if found := sorted(p for p in existing if p.rpartition("/")[0] == folder and p.endswith("_coords.gff")):
            return found[0]
    return None


def gene_files(names: list[str]) -> list[str]:
    """The gene files among names, sorted: *.fa and *.fa.*"""
    return sorted(n for n in names if n.endswith(".fa") or ".fa." in n)


def with_node(df: DataFrame, header: str = "header") -> DataFrame:
    """df with node, frame and is_ref parsed from its headers."""
    h = F.col(header)
    return df.withColumns({"node": S.header_field(h, 3), "frame": S.header_field(h, 4).cast("int"), "is_ref": S.is_reference(h)})


def node_lookup(nodes: DataFrame, gff: DataFrame, node: str = "node") -> DataFrame:
    """nodes with the GFF entry of the same name, else of the name's first && segment without what follows an underscore."""
    short = F.split(F.split(F.col(node), "&&")[0], "_")[0]
    entry = lambda p: gff.select(F.col("name").alias(f"_{p}"), F.struct("scaffold", "start", "end", "strand").alias(f"_e{p}"))
    both = nodes.withColumn("_short", short).join(entry("a"), F.col(node) == F.col("_a"), "left").join(entry("b"), F.col("_short") == F.col("_b"), "left")
    return both.withColumn("entry", F.coalesce("_ea", "_eb")).drop("_short", "_a", "_ea", "_b", "_eb")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in an order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")
