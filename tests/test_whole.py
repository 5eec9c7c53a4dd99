"""Queries over whole texts, against brute force and against their SQL."""

import math
import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from seqspark.functions import codons
from seqspark.functions.views import BASES, LETTERS
from seqspark.operators import orfs
from seqspark.plans import registry
from seqspark.plans import views as V

from .helpers import oracle, values

SF = "/root/testdata/sf0.001"


def sequence(text):
    return re.sub("[^A-Za-z]", "", text).upper().translate(str.maketrans(LETTERS, BASES))


def documents(spark, path, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def run(spark, name, sf):
    df = registry.queries()[name](spark, sf)
    return values(df.columns, df.collect())


def against_sql(spark, name):
    assert run(spark, name, SF) == oracle(registry.oracle_sql()[name], SF)[1]


def frames(seq, least, from_start=False):
    code = codons.genetic_code()
    for f in range(3):
        aa = "".join(code.get(seq[i : i + 3], "X") for i in range(f, len(seq) - 2, 3))
        for m in re.finditer("[^*]+", aa):
            skip = m[0].find("M") if from_start else 0
            if skip >= 0 and len(m[0]) - skip >= least:
                yield f, m[0][skip:], f + 3 * (m.start() + skip)


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdghijt", k=n)) for n in (4, 700, 1500, 4000, 9001)]
    # one frame crosses each of the old cuts, and one lies beyond them
    texts.append("tag" + "ca" * 2400 + "tag" + "atg" + "gca" * 300 + "tag")
    return texts, documents(spark, tmp_path_factory.mktemp("whole"), texts)


@pytest.mark.parametrize("name,start", [("orf_scan", False), ("orf_scan_from_start", True)])
def test_orf_scans_read_to_the_end(spark, long_texts, name, start):
    texts, sf = long_texts
    want = [(aa, i, f) for i, t in enumerate(texts) for f, aa, _ in frames(sequence(t), 20, start)]
    assert run(spark, name, sf) == values(["aa", "doc_id", "frame"], want)
    against_sql(spark, name)


def test_orf_locations_read_to_the_end(spark, long_texts):
    texts, sf = long_texts
    want = []
    for i, t in enumerate(texts):
        seq, back = sequence(t), i % 2 == 1
        read = seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if back else seq
        for f, aa, s in frames(read, 15):
            lo, hi = (len(seq) - s - 3 * len(aa), len(seq) - s) if back else (s, s + 3 * len(aa))
            want.append((i, "-" if back else "+", aa, -f - 1 if back else f + 1, i * 1000 + 1 + lo, i * 1000 + hi, True))
    columns = ["doc_id", "strand", "aa", "frame", "hit_start", "hit_end", "fits"]
    assert run(spark, "orf_locations", sf) == values(columns, want)
    against_sql(spark, "orf_locations")


def test_canonical_dedupe_compares_whole_sequences(spark, tmp_path):
    rng = random.Random(7)
    bodies = ["".join(rng.choices("abcdz", k=n)) for n in (50, 50, 900, 5000)]
    back = bodies[3][::-1].translate(str.maketrans("abcd", "dcba"))
    # most begin with the same four letters; two differ from an earlier one in their last letter only
    texts = ["abcd" + b for b in bodies] + [bodies[3], back, "ABCD " + bodies[2], "abcd" + bodies[2] + "a", bodies[3] + "a", "", ""]
    groups = {}
    for i, t in enumerate(texts):
        seq = sequence(t)
        groups.setdefault(min(seq, seq[::-1].translate(str.maketrans("ACGT", "TGCA"))), []).append(i)
    want = [(k, seq, len(at)) for k, (seq, at) in enumerate(groups.items(), 1) if len(at) >= 2]
    assert len(want) == 3
    assert run(spark, "canonical_dedupe", documents(spark, tmp_path, texts)) == values(["id", "seq", "n"], want)
    against_sql(spark, "canonical_dedupe")


def entropy(words):
    counts = [words.count(w) for w in set(words)]
    return (math.log(len(words)) - sum(c * math.log(c) for c in counts) / len(words)) / math.log(2)


def is_low(seq):
    total = fail = bp = 0
    for s in re.findall("[ACGT]{30,}", seq):
        size = min(60, len(s))
        for p in sorted({*range(0, len(s) - size + 1, 15), len(s) - size}) if len(s) > 60 else [0]:
            w = s[p : p + size]
            low = entropy([w[i : i + 2] for i in range(size - 1)]) < 3.6 or entropy([w[i : i + 3] for i in range(size - 2)]) < 4.9
            total, fail, bp = total + 1, fail + low, bp + low * size
    return total >= 4 and fail / total >= 0.5 and bp >= 100


def test_low_complexity_reads_to_the_end(spark, tmp_path):
    rng = random.Random(11)
    mixed = lambda n: "".join(rng.choices("abcd", k=n))
    # the head of 900 says the opposite of the whole in the first two
    texts = ["a" * 900 + mixed(4000), mixed(900) + "ab" * 2000, mixed(3000), "a" * 3000, mixed(50), "z" * 2000 + "abcd" * 500, ""]
    want = [(i, is_low(sequence(t))) for i, t in enumerate(texts)]
    assert [w for _, w in want[:2]] == [is_low(sequence(t)[:900]) is False for t in texts[:2]] == [False, True]
    assert run(spark, "low_complexity", documents(spark, tmp_path, texts)) == values(["doc_id", "low"], want)


def test_low_complexity_against_sql(spark):
    against_sql(spark, "low_complexity")


def test_supersede_natives_on_both_strands_and_slots(spark):
    spans = duckdb.sql(f"WITH {V.SPANS.replace('FROM lineitem', f'''FROM '{SF}/lineitem.parquet' ''')} SELECT scaffold, strand, id, line, start, \"end\" FROM spans ORDER BY id, line").fetchall()
    places = {}
    for scaffold, strand, *item in spans:
        places.setdefault((scaffold, strand), ([], []))[item[0] % 2].append(item)
    want = []
    for found, natives in places.values():
        for i, line, s, e in natives:
            slots = 0
            for gi, gline, gs, ge in found:  # by order and line
                if (gs <= s and ge >= e) or max(0, min(e, ge) - max(s, gs) + 1) / (e - s + 1) >= 0.8:
                    slots += gi % 6 == 0
                    if gi % 6 or slots == 1:
                        want.append((f"n_{i}_{line}", gi % 6 == 0, f"{'GAP' if gi % 6 else 'IMX'}_{gi}_{gline}"))
    assert any(slot for _, slot, _ in want)
    assert run(spark, "supersede_natives", SF) == values(["name", "superseded", "tag"], want)


def test_all_tables_in_small_batches(spark, monkeypatch):
    """Each text by each table, handed on in parts, and whole texts to Python a few at a time."""
    monkeypatch.setattr(codons, "BATCH_RESIDUES", 50)
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTN", k=n)) for n in (0, 2, 3, 30, 400)] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "k long, s string")
    got = codons.translate_all(df, "k", "s", [1, 2, 33]).collect()
    want = {(k, t): "".join(codons.genetic_code(t).get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3)) for k, s in enumerate(seqs) if s is not None for t in (1, 2, 33)}
    assert len(got) == len(want) and {(r.k, r.code): r.aa for r in got} == want
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "10000")
    plan = registry.queries()["translate_tables"](spark, SF)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and int(spark.conf.get(limit)) <= 1000


@pytest.mark.parametrize("bases", [1, 500])
def test_reading_frames_in_slices(spark, monkeypatch, bases):
    """A worker holds the frames of few sequences as objects, and an empty or null one among them changes nothing."""
    monkeypatch.setattr(orfs, "SLICE_BASES", bases)
    rng = random.Random(8)
    seqs = [None, "", "ACG", None] + ["".join(rng.choices("ACGTN", [4, 4, 4, 4, 1], k=rng.randint(5, 900))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k long, s string").coalesce(1)
    for start in (False, True):
        got = {r.k: r.o for r in df.select("k", orfs.orfs(F.col("s"), 3, start).alias("o")).collect()}
        for k, s in enumerate(seqs):
            if s is None:
                assert got[k] is None
                continue
            want = sorted(((aa, f, at, at + 3 * len(aa), s[at : at + 3 * len(aa)]) for f, aa, at in frames(s, 3, start)), key=lambda o: (-len(o[0]), o[1], o[2]))
            assert [tuple(o) for o in got[k]] == want


def test_orf_locations_in_slices(spark, monkeypatch):
    monkeypatch.setattr(orfs, "SLICE_BASES", 100)
    against_sql(spark, "orf_locations")
