"""Interval operators against brute force."""

import random

from seqspark.operators import intervals as I


def test_nearest_reads_each_row_once(spark):
    """Both sides, with positions on starts and ends, and no frame that is summed anew for each row."""
    rng = random.Random(2)
    exons = [(k, s, s + rng.randint(0, 9)) for k in "ab" for s in (rng.randint(1, 60) for _ in range(25))] + [(None, 5, 6)]
    asks = [(i, rng.choice(["a", "b", "c", None]), rng.randint(-2, 75)) for i in range(200)]
    e = spark.createDataFrame(exons, "k string, start long, end long")
    q = spark.createDataFrame(asks, "id long, k string, at long")
    for side in ("left", "right"):
        out = I.nearest(q, e, ["k"], "at", side)
        want = {}
        for i, k, at in asks:
            mine = [(s, t) for x, s, t in exons if x == k]
            want[i] = max(((s, t) for s, t in mine if t < at), default=(0, 0))[1] if side == "left" else min((s for s, _ in mine if s > at), default=None)
        assert {r.id: r.bound for r in out.collect()} == want
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_needed_ranges_by_stretches(spark, monkeypatch):
    """Ranges that cross stretches and hold others, and a scaffold that is not one task's whole."""
    monkeypatch.setattr(I, "STRETCH", 40)
    rng = random.Random(6)
    nodes = [(i // 2, k, s, s + rng.choice([3, 10, 150])) for k in "ab" for i, s in enumerate(rng.randint(0, 3000) for _ in range(60))]
    df = spark.createDataFrame(nodes, "id long, scaffold string, start long, end long")
    out = I.needed_ranges(df, ["id"], 1, 4)
    want = []
    for k in "ab":
        wide = sorted((max(0, min(s for j, x, s, _ in nodes if (j, x) == (i, k)) - 5), max(e for j, x, _, e in nodes if (j, x) == (i, k)) + 5) for i in {n[0] for n in nodes})
        for lo, hi in wide:
            if want and want[-1][0] == k and lo <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(hi, want[-1][2]))
            else:
                want.append((k, lo, hi))
    assert sorted((r.scaffold, r.lo, r.hi) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3
