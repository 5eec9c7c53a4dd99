import gzip

import pytest

from seqspark.functions import codons
from seqspark.functions import sequences as S
from seqspark.operators import dedupe, intervals
from seqspark.sources import text
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text("junk\n>h1 with words\nAC GT\nac\r\n\n>h2\n>h3\nNN*\n")
    got = [(r.header, r.seq) for r in text.read_fasta(spark, str(p)).orderBy("ord").collect()]
    assert got == [("h1 with words", "AC GTac"), ("h2", ""), ("h3", "NN*")]
    text.write_fasta(text.read_fasta(spark, str(p)), str(tmp_path / "out"), ["ord"], mask_stops=True)
    again = [(r.header, r.seq) for r in text.read_fasta(spark, str(tmp_path / "out")).orderBy("ord").collect()]
    assert again[-1] == ("h3", "NNX") and len(again) == 3


def test_fasta_and_fastq_dedupe(spark, tmp_path):
    (tmp_path / "b.fasta").write_text(">x\nAACG\n>y\naacg\n>z\nACGN\n")
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@r1\nCGTT\n+\nIIII\n@r2\nTTTT\n+\nIIII\n")
    records = text.read_sequences(spark, [str(tmp_path / "b.fasta"), str(tmp_path / "a.fq.gz")])
    got = [(r.id, r.seq, r.n) for r in dedupe.canonical_dedupe(records, ["file_rank", "ord"]).orderBy("id").collect()]
    assert got == [(1, "AACG", 2), (2, "AAAA", 1), (3, "CGTT", 1), (4, "ACGN", 1)]
    assert [r.id for r in dedupe.canonical_dedupe(records, ["file_rank", "ord"], min_size=2).collect()] == [1]
    with pytest.raises(ValueError):
        text.detect_format("x.txt")
    assert text.detect_format("X.FNA.GZ") == "fasta"


def test_clusters_lookup_and_paths(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("head\ng1.gz,1,a,b,c,n1;n2&&n9_x,z,IMX\ng1,1_1,a,b,c,n3\nbad,row\n")
    got = text.read_clusters(spark, str(p))
    assert [(r.gene, r.cluster_key, r.node_ord, r.node, r.iso_type) for r in got.orderBy("cluster_key", "node_ord").collect()] == [("g1", "1", 0, "n1", "IMX"), ("g1", "1", 1, "n2&&n9_x", "IMX"), ("g1", "1_1", 0, "n3", "")]
    gff = spark.createDataFrame([("n1", "s", 1, 2, "+"), ("n2", "s", 3, 4, "-")], "name string, scaffold string, start long, end long, strand string")
    found = {r.node: r.entry and r.entry.start for r in text.node_lookup(got.select("node"), gff).collect()}
    assert found == {"n1": 1, "n2&&n9_x": 3, "n3": None}
    assert text.find_gff(["x/b_coords.gff", "x/a_coords.gff", "outlier/y/z.gff"], "x") == "x/a_coords.gff" and text.find_gff([], "x") is None
    assert text.gene_files(["b.fa.gz", "a.fa", "c.txt"]) == ["a.fa", "b.fa.gz"]


def test_chunks(spark):
    genome = spark.createDataFrame([("s", "ACGTACGTAC"), ("t", "GG")], "header string, seq string")
    ranges = spark.createDataFrame([("s", 2, 9), ("s", 0, 4), ("t", 0, 2)], "scaffold string, lo long, hi long")
    got = {(r.scaffold, r.lo): r.seq for r in intervals.fetch_ranges(ranges, text.genome_chunks(genome, 4), 4).collect()}
    assert got == {("s", 2): "GTACGTA", ("s", 0): "ACGT", ("t", 0): "GG"}


def test_given_cases(spark):
    t = lambda s, n=1: one(spark, codons.translate(F.lit(s), n))
    assert t("ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG") == "MAIVMGR*KGAR*"
    assert (t("ATAAGAAGATGA"), t("ATAAGAAGATGA", 2)) == ("IRR*", "M**W")
    assert (t("augGcc"), t("ATNCCC"), t("ATGCC"), t("ATG")) == ("MA", "XP", "M", "M")
    with pytest.raises(ValueError):
        t("ATG", 8)
    assert one(spark, S.blosum62_distance(F.lit("A"), F.lit("-"))) == 2.0
    assert one(spark, S.revcomp(F.lit("AaRN"))) == "NYtT"
    assert one(spark, S.find_index_pair(F.lit("----"))) == (0, 1) and one(spark, S.find_index_pair(F.lit("-A-"))) == (1, 2)
    assert one(spark, S.blosum62_distance(F.lit(""), F.lit(""))) != one(spark, S.blosum62_distance(F.lit("A"), F.lit("A")))
    with pytest.raises(Exception, match="BLOSUM62"):
        one(spark, S.blosum62_distance(F.lit("a"), F.lit("A")))
    assert one(spark, S.is_same_kmer(F.lit("AC"), F.lit("ACG"))) is False
    assert one(spark, S.canonical(F.lit("aacg"))) == "CGTT"
