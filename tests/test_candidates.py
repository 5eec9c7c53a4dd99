import random
from collections import Counter

from seqspark.operators import candidates as C


def cand(tag, start, end, cols, strand="+", **more):
    return C.Candidate(tag, "s", strand, start, end, frozenset(cols), **more)


def test_relations():
    a = cand("a", 1000, 1100, range(0, 40), covered=80.0)
    assert C.classify(cand("b", 1050, 1150, range(5, 45)), a) == "duplicate"
    assert C.classify(cand("b", 2000, 2100, range(0, 40), covered=75.0), a) == "module"
    assert C.classify(cand("b", 2000, 2100, range(0, 40), covered=10.0), a) == "duplicate"
    assert C.classify(cand("b", 500, 600, range(60, 90)), a) == "mono_break"
    assert C.classify(cand("b", 2000, 2100, range(60, 90)), a) == "independent"
    assert C.classify(cand("b", 1090, 1200, range(60, 90)), a) == "genomic"
    assert C.classify(cand("b", 500, 600, range(60, 90), slot=C.Slot("n", "l", "r")), a) == "independent"
    assert C.classify(cand("b", 500, 600, range(60, 90), "-"), cand("a", 1000, 1100, range(0, 40), "-")) == "independent"
    assert C.classify(cand("b", 2000, 2100, range(60, 90), "-"), a) == "independent"


def test_greedy_dedup_marks_modules_and_rejects():
    group = [cand("a", 1000, 1100, range(40), covered=80.0), cand("b", 2000, 2100, range(40), covered=80.0), cand("c", 1010, 1110, range(40)), cand("d", 1090, 1200, range(60, 90)), cand("e", 3000, 3100, range(60, 90))]
    kept, log = C.dedup_group(group)
    assert [(c.tag, c.partner) for c in kept] == [("a", "b"), ("b", "a"), ("e", None)]
    assert [x.split()[0] for x in log] == ["MODULE_DETECTED", "REJECTED", "REJECTED"]


def test_cross_cluster():
    a, b = cand("a", 100, 200, [], cluster="1_1", full=90.0), cand("b", 120, 220, [], cluster="1", full=10.0)
    c = cand("c", 120, 220, [], cluster="2", full=50.0)
    assert C.cross_cluster_losers([a, b]) == {0: 1}
    assert C.cross_cluster_losers([b, c]) == {0: 1}
    assert C.cross_cluster_losers([a, cand("d", 190, 400, [], cluster="3")]) == {}


def test_slots():
    clusters = {"1": ["x", "p", "q", "y"], "1_2": ["x", "r", "y"], "2": ["x", "z", "y"]}
    slot = C.Slot("q", "y", "x")
    assert C.slot_siblings("1_7", slot, clusters) == {"p", "r"}
    seqs = {"p": "ARNDCQEGHI", "r": "WWWWWWWWWW"}
    good, short, far = (cand(t, 1, 2, [], cluster="1", slot=slot, aa=s) for t, s in (("g", "ARNDCQEGHL"), ("s", "AR"), ("f", "GGGPPPGGGP")))
    kept, log = C.kick_slot_candidates([good, short, far, cand("o", 1, 2, [])], seqs, clusters)
    assert [c.tag for c in kept] == ["g", "o"] and "imx_length" in log[0] and "imx_similarity" in log[1]


def test_natives(spark):
    found = spark.createDataFrame([("GAP_1", "s", "+", 100, 200, False, 0), ("IMX1", "s", "+", 100, 300, True, 1), ("IMX2", "s", "+", 90, 310, True, 2), ("FLANK_1", "s", "+", 1, 999, False, 3)], "tag string, scaffold string, strand string, start long, end long, is_slot boolean, ord int")
    natives = spark.createDataFrame([("n1", "s", "+", 110, 190), ("n2", "s", "+", 150, 350), ("n3", "s", "-", 110, 190), ("GAP_9", "s", "+", 110, 190)], "name string, scaffold string, strand string, start long, end long")
    got = {tuple(r) for r in C.supersede_natives(found, natives).collect()}
    assert got == {("n1", "GAP_1", False), ("n1", "IMX1", True), ("n2", "IMX2", True)}


def test_split_against_every_place():
    rng = random.Random(3)
    refs = ["".join(rng.choice("ARND-") for _ in range(30)) for _ in range(5)]
    cols = C.reference_letters(refs)
    assert sum(map(Counter.total, cols)) == sum(len(r.strip("-")) for r in refs)
    for _ in range(100):
        a, b = ("".join(rng.choice("ARND-") for _ in range(30)) for _ in range(2))
        s, e = sorted(rng.sample(range(31), 2))
        worth = lambda c, i: (cols[i][c] if c in cols[i] else -1) - (c == "-")
        every = [sum(worth(a[i], i) for i in range(s, p)) + sum(worth(b[i], i) for i in range(p, e)) for p in range(s, e + 1)]
        want = max(p for p in range(s, e + 1) if every[p - s] == max(every)) if max(every) >= -1 else s
        assert C.calculate_split(a, b, s, e, cols) == want
    assert C.calculate_split("", "", 5, 5, cols) == 5


def test_modules_trims_and_drops():
    row = "A" * 20 + "-" * 10
    members = [("a", row, ("s", 500, "-")), ("b", row, ("s", 100, "-")), ("c", "-" * 20 + "A" * 10, ("s", 300, "-")), ("d", row, ("t", 1, "+"))]
    assert C.module_groups(members) == [["a", "b"]]
    c = cand("x", 100, 129, [], aa="ACDEFGHIKL")
    assert (C.apply_cull_trim(c, {0, 1, 9}).start, C.apply_cull_trim(c, {0, 1, 9}).end) == (106, 126)
    assert C.apply_cull_trim(c, set(range(10))) == c
    assert C.apply_drop("A-CD", {1, 2}, {0}, 5) == ("A--D", {0, 2})


def test_frames(spark):
    rows = [("g", i, t, "s", "+", a, b, cols, "", f, 10 * f, "1") for i, (t, a, b, cols, f) in enumerate([("late", 1010, 1110, list(range(40)), 1.0), ("a", 1000, 1100, list(range(40)), 9.0), ("b", 2000, 2100, list(range(40)), 8.0)])]
    df = spark.createDataFrame(rows, "gene string, ord int, tag string, scaffold string, strand string, start long, end long, cols array<int>, aa string, full double, covered double, cluster string")
    got = {r.tag: (r.accepted, r.partner) for r in C.dedup_candidates(df, ["gene"]).collect()}
    assert got == {"late": (False, None), "a": (True, "b"), "b": (True, "a")}


def test_groups_are_read_in_batches(spark):
    """Groups larger than an Arrow batch, and many in one, decided as by dedup_group, without a call for each."""
    rng = random.Random(4)
    rows, want = [], {}
    for g, n in enumerate([1, 2, 60, 90, 3, 40, 150, 5]):
        some = []
        for i in range(n):
            first, size, start = rng.randint(-5, 120), rng.randint(0, 40), rng.randint(0, 5000)
            cols = sorted(range(first, first + size) if rng.random() < 0.6 else rng.sample(range(first, first + 60), size))
            cols = [c + 70_000 for c in cols] if rng.random() < 0.1 else cols
            where = (rng.choice("stuvwxyz"), rng.choice("+-"))
            if i % 3 == 1:  # the columns of the one before, elsewhere on its scaffold
                cols, where, start = some[-1][7], some[-1][3:5], some[-1][6] + rng.randint(1, 400)
            some.append((f"g{g}", i, f"t{g}_{i}", *where, start, start + rng.randint(3, 150), cols, "", float(rng.randint(0, 30)), float(rng.randint(-5, 50)), "1"))
        rng.shuffle(some)
        rows += some
        best = sorted(some, key=lambda r: (-r[9], r[1]))
        kept, _ = C.dedup_group([C.Candidate(r[2], r[3], r[4], r[5], r[6], frozenset(r[7]), full=r[9], covered=r[10]) for r in best])
        partner = {c.tag: c.partner for c in kept}
        want |= {r[2]: (r[2] in partner, partner.get(r[2])) for r in some}
    df = spark.createDataFrame(rows, "gene string, ord int, tag string, scaffold string, strand string, start long, end long, cols array<int>, aa string, full double, covered double, cluster string")
    assert sum(p is not None for _, p in want.values()) > 5
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(limit)
    try:
        for n in ("7", old):
            spark.conf.set(limit, n)
            out = C.dedup_candidates(df, ["gene"])
            got = out.collect()
            assert len(got) == len(rows) and {r.tag: (r.accepted, r.partner) for r in got} == want
            assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set(limit, old)
