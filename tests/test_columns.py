"""Column aggregates against brute force, over genes of several widths and with columns to drop."""

import random
from collections import Counter, defaultdict

import pytest

from seqspark.operators import columns as C


@pytest.fixture(scope="module")
def genes():
    rng = random.Random(11)
    out = []
    for g in range(5):
        width = rng.choice([1, 30, 50])
        gone = set(range(3, 15)) | {0, width - 1} if g % 2 else set()
        for i in range(20):
            s = "".join("-" if j in gone or rng.random() < 0.4 else rng.choice("ACZ*") for j in range(width))
            out.append((f"g{g}", i, "-" * width if i == 7 else s, rng.randint(1, 9)))
    return [*out, ("gaps", 0, "-----", 2), ("none", 0, "", 3)]


def test_columns_are_counted_by_arrays(spark, genes, monkeypatch):
    monkeypatch.setattr(C, "HELD_COUNTS", 0)
    df = spark.createDataFrame(genes, "gene string, ord long, seq string, weight long")
    keep, votes, width = defaultdict(set), defaultdict(Counter), {}
    for g, _, s, w in genes:
        width[g] = len(s)
        a, b = (len(s) - len(s.lstrip("-")), len(s.rstrip("-"))) if s.strip("-") else (0, 1)
        for i, c in enumerate(s):
            if c != "-":
                keep[g].add(i)
            if a <= i < b:
                votes[g, i]["~" if c in "-*" else c] += w
    out = C.drop_empty_columns(df, "gene")
    assert {(r.gene, r.ord): r.seq for r in out.collect()} == {(g, i): "".join(s[j] for j in sorted(keep[g])) for g, i, s, _ in genes}
    # no row for each cell, and a row's symbols are not cut again for each kept column
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "split(" not in plan
    assert {r.gene: r.keep for r in C.empty_columns(df, "gene").collect()} == {g: sorted(k) for g, k in keep.items() if k}

    def best(g, i):
        if not votes[g, i]:
            return "X"
        top = min(votes[g, i], key=lambda c: (-votes[g, i][c], c))
        return ("-" if top == "~" else top) if votes[g, i][top] / votes[g, i].total() > 0.3 else "X"

    cons = C.consensus(df, "gene", 0.3, weight="weight")
    assert "posexplode" not in cons._jdf.queryExecution().optimizedPlan().toString()
    assert {r.gene: r.consensus for r in cons.collect()} == {g: "".join(best(g, i) for i in range(n)) for g, n in width.items()}
    first = C.consensus(df, "gene", 0.3, weight="weight", order="ord")
    assert sorted(first.collect()) == sorted(cons.collect())


def test_converted_consensus(spark):
    """Columns that all rows lack, at the start, in a short run and in a long one, without a row for each cell."""
    rows = [("g", "--AC-----GA---------CC-"), ("g", "--AC-----GA---------CC-"), ("g", "-----------------------")]
    df = spark.createDataFrame(rows, "gene string, seq string")
    out = C.convert_consensus(df, C.consensus(df, "gene", 0.5), "gene")
    assert [tuple(r) for r in out.collect()] == [("g", "--AC-----GA?????????CCX")]
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
