import zlib

import numpy as np

from seqspark.llm import queries, toxicity

SCHEMA = "doc_id long, text string, score string, y int, held_out int"


def test_machine_learns_a_product_that_no_weights_express():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, on in ((0, a), (1, b), (2, rng.integers(0, 2))) if on], int))
        y.append(a ^ b)
    m = toxicity.Machine(3, seed=1).fit(rows, np.array(y, float), epochs=40)
    assert ((m.scores(rows) >= 0.5) == np.array(y)).mean() > 0.99


def test_pairs_against_brute_force():
    m = toxicity.Machine(6)
    m.w[:] = np.arange(6)
    x = [0, 2, 5]
    pairs = sum(m.v[i] @ m.v[j] for i in x for j in x if i < j)
    assert np.isclose(m.logits([np.array(x)])[0], m.b[0] + m.w[x].sum() + pairs)


def test_frames(spark):
    docs = [(i, f"nice words here {i}" + (" awful!" if i % 3 == 0 else "")) for i in range(60)] + [(None, None), (61, ""), (3, "awful"), (62, "x " * 50000)]
    df = spark.createDataFrame([(i, t, "s", 1, 0) for i, t in docs], SCHEMA)
    lab = spark.createDataFrame([(i, int(i % 3 == 0), "w") for i in range(60)] + [(None, 1, ""), (7, None, ""), (7, 0, "")], "doc_id long, toxic int, text string")
    got = toxicity.classify(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 60) >= 59
    assert toxicity.classify(df, lab.limit(0)).where("predicted = 0").count() == len(docs)
    assert toxicity.classify(df.limit(0), lab).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 == r.toxic for r in got)
    wrong = sum(r.predicted != r.toxic for r in got)
    assert hit > 0 and 2 * hit / (2 * hit + wrong) > 0.9, (hit, wrong)
