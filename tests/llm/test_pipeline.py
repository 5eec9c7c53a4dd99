import re
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline as cp
from seqspark.llm._shared import written

from .test_near_dedup import sets_of
from .test_packing import check as check_packed
from .test_secrets import brute as secrets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = written(cp.filter_quality(spark, docs, SF), "t")
    assert first.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in first.select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in good) >= 0.97 * len(good)

    second = written(cp.drop_lines(spark, first, SF), "t")
    assert second.columns == docs.columns
    lines = Counter(x.strip() for r in second.collect() for x in r.text.split("\n") if x.count(" ") >= 12)
    assert max(lines.values()) == 1 and all(r.n_chars == len(r.text) for r in second.collect())

    third = written(cp.drop_near_copies(spark, second, SF), "t")
    assert third.columns == docs.columns
    left = [sets_of(r.text, 5) for r in third.collect()]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(left) for b in left[:i] if a and b)

    fourth = written(cp.mask_secrets(spark, third, SF), "t")
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in secrets_of(before[r.doc_id])[4].split(",") if s)]
        text = "".join("\x00" if any(a <= i < b for a, b in spans) else c for i, c in enumerate(before[r.doc_id]))
        assert r.text == re.sub("\x00+", cp.MASK, text)

    docs = [(r.doc_id, r.text) for r in fourth.collect()]
    out = cp.pack(spark, fourth, SF).collect()
    assert check_packed(docs, out)[0]


ODD = ["score", "spans", "n_removed", "N_LINES", "digest", "_print", "_spans", "_gone", "_id", "own", "kept", "id", "print", "shingles", "component"]


def test_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    mine = lambda i: tuple(f"{c} of {i}" for c in ODD)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "password=abcdefgh in a row of words that is long enough to go on", "en", "s", 3), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)]
    rows = [r + mine(r[0]) for r in rows]
    for frame in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = frame
        for _, stage in cp.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "t")
            assert docs.columns == frame.columns
            for r in docs.collect():  # values of other columns are the row's own
                assert tuple(r[c] for c in ODD) == mine(r.doc_id)
        assert cp.pack(spark, docs, SF).count() == docs.count()


class Over:
    """Another object with some of its names replaced."""

    def __init__(self, under, **names):
        self.__dict__.update(names, under=under)

    def __getattr__(self, name):
        return getattr(self.under, name)


def test_written_tables_ask_the_collector_where_the_heap_has_grown(spark, monkeypatch):
    real, calls = spark._jvm, []
    for mb in (49, 51):
        runtime = SimpleNamespace(totalMemory=lambda mb=mb: mb, maxMemory=lambda: 100)
        lang = Over(real.java.lang, Runtime=SimpleNamespace(getRuntime=lambda runtime=runtime: runtime))
        jvm = Over(real, java=Over(real.java, lang=lang), System=SimpleNamespace(gc=lambda mb=mb: calls.append(mb)))
        with monkeypatch.context() as m:
            m.setattr(spark, "_jvm", jvm)
            assert written(spark.range(3), "small").count() == 3
    assert calls == [51]
