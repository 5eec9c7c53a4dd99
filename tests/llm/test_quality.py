import zlib

import numpy as np

from seqspark.llm import quality, queries
from seqspark.llm._vector import Words

SCHEMA = "doc_id long, text string, score string, quality int"


def test_words_against_split():
    texts = ["", "a b", "  x\ty\n\nz ", "é" * 50, "q" * 3000, "\x1c \x85"]
    w = Words([t.encode() for t in texts])
    blob = bytes(w.raw)
    got = [(int(d), blob[a:b].decode()) for d, a, b in zip(w.doc, w.begin, w.end, strict=True)]
    want = [(i, x) for i, t in enumerate(texts) for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in t).split(" ") if x]
    assert got == want
    again = Words([b"Foo foo", b"bar FOO"])
    assert len(set(again.hash.tolist())) == 2


def test_passages_do_not_depend_on_the_batch():
    texts = ["one two\nthree " * 40, "", "  ", "A!! B!! " * 200, "x | y\n"]
    x, per = quality.passages([t.encode() for t in texts])
    assert per.tolist()[1:3] == [1, 1] and len(x) == per.sum()
    alone = [quality.passages([t.encode()])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    x, per, y = rng.normal(size=(40, quality.N_FEATURES)), np.array([3, 1, 6, 10, 20]), np.array([1, 0, 1, 0, 1.0])
    m, weight = quality.Model(), np.array([0.1, 0.2, 0.3, 0.2, 0.2])

    def loss():
        s = brute_scores(m, x, per)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    g = m.gradient(x, per, y, weight)
    for k, v in m.p.items():
        flat = v.reshape(-1)
        for i in range(0, len(flat), 7):
            was, h = flat[i], 1e-6
            flat[i] = was + h
            up = loss()
            flat[i] = was - h
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * h) - g[k].reshape(-1)[i]) < 1e-6, (k, i)
    m.fit(x, per, y, steps=200)
    assert ((m.scores(x, per) >= 0.5) == y).all()


def brute_scores(m, x, per):
    """Gated attention, a document and a passage at a time."""
    out, at = [], 0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for n in per:
        h = [np.tanh(np.clip((r - m.mean) / m.scale, -6, 6) @ m.p["W"] + m.p["b"]) for r in x[at : at + n]]
        e = [np.exp(m.p["a"] @ (np.tanh(v @ m.p["V"]) * sigmoid(v @ m.p["U"]))) for v in h]
        z = sum(a * v for a, v in zip(e, h, strict=True)) / sum(e)
        out.append(sigmoid(z @ m.p["o"] + m.p["c"][0]))
        at += n
    return np.array(out)


def test_query_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, sf).collect()}
    for r in docs.collect():
        x, per = quality.passages([(r.text or "").encode()])
        assert abs(brute_scores(model, x, per)[0] - got[r.doc_id]) < 1e-9


def test_a_column_called_score_stays(spark):
    df = spark.createDataFrame([(1, "some words", "mine"), (2, None, "yours")], "doc_id long, text string, Score string")
    out = quality.score(df, quality.Model())
    assert out.columns == ["doc_id", "text", "Score", "_score"] and {r.Score for r in out.collect()} == {"mine", "yours"}


def test_frames(spark):
    docs = [(i, "Plain and calm words that go on for a while. " * 3 if i % 2 else "BUY!! NOW!! " * 20) for i in range(60)] + [(None, None), (61, ""), (1, "Plain and calm words that go on for a while. " * 3), (62, "x " * 50000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], SCHEMA)
    lab = spark.createDataFrame([(i, i % 2, "w") for i in range(60)] + [(None, 1, ""), (7, None, "")], "doc_id long, quality int, text string")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert quality.classify(df, lab.limit(0)).count() == len(docs) and quality.classify(df.limit(0), lab).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.98, [r for r in good if not r.predicted]
    assert sum(r.predicted for r in bad) / len(bad) < 0.1, [r for r in bad if r.predicted]
