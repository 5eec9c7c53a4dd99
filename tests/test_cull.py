import random

import numpy as np
import pytest

from seqspark.operators import cull
from seqspark.sources import text

AA = "ARNDCQEGHILKMFPSTWYV"


def base(n=120, seed=1):
    return "".join(random.Random(seed).choices(AA, k=n))


def test_runs_and_blocks():
    assert cull.runs(np.array([True, True, False, True])) == [(True, 0, 2), (False, 2, 3), (True, 3, 4)] and cull.runs(np.zeros(0, bool)) == []
    o = cull.Options()
    data = np.ones(100, bool)
    filled = np.zeros(100, bool)
    filled[2:7] = filled[40:80] = True
    assert cull.block_start(filled, data, o) == 40  # five residues behind a supported gap are no block
    filled[90:95] = True
    assert cull.tail_end(filled, data, 40, o) == 80
    assert cull.block_start(filled, np.zeros(100, bool), o) == 0 and cull.tail_end(filled, np.zeros(100, bool), 0, o) == 100


def test_edges_and_ragged_rows():
    ref = base()
    heads, seqs = ["a|.", "b|.", "c"], ["-" * 10 + ref[10:], "-" * 10 + ref[10:], ref]
    got = cull.cull_alignment(heads, seqs)
    assert got[2].trim == (10, 0) and got[2].drops == list(range(10)) and got[2].seq == ref[10:] and got[0].seq == ref[10:]
    with pytest.raises(ValueError):
        cull.cull_alignment(["a", "b"], ["AA", "A"])
    assert cull.cull_alignment([], []) == []
    assert [c.seq for c in cull.cull_alignment(["x"], ["AC"])] == [None]


def test_intron_with_stop_and_with_splice_sites():
    ref = base()
    block = "AAAAA*AAAAAAAAA"
    heads = ["r1|.", "r2|.", "c"]
    gapped = ref[:60] + "-" * 15 + ref[60:]
    got = cull.cull_alignment(heads, [gapped, gapped, ref[:60] + block + ref[60:]])
    assert got[2].introns == [(60, 15)] and got[2].exons == [(0, 60), (75, 60)] and got[2].drops == list(range(60, 75)) and got[2].trim is None
    assert got[2].seq == ref
    plain = ref[:60] + block.replace("*", "A") + ref[60:]
    assert not cull.cull_alignment(heads, [gapped, gapped, plain])[2].introns
    nt = "CCC" * 60 + "GT" + "C" * 41 + "AG" + "CCC" * 60
    assert cull.cull_alignment(heads, [gapped, gapped, plain], {"c": nt})[2].introns == [(60, 15)]


def test_stop_near_an_end_takes_the_bad_side_along():
    ref = base()
    bad = ref[:100] + "*" + "".join("W" if c != "W" else "P" for c in ref[101:])
    got = cull.cull_alignment(["r|.", "s|.", "c"], [ref, ref, bad])
    assert got[2].seq.rstrip("-") == ref[:100] and got[2].introns == [(100, 20)] and got[2].exons == []
    good = ref[:100] + "*" + ref[101:]
    assert cull.cull_alignment(["r|.", "s|.", "c"], [ref, ref, good])[2].seq == good


def test_only_gaps_are_added(spark):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        ref = base(150, g)
        for i in range(9):
            s = "".join("-" if rng.random() < 0.1 else rng.choice(AA + "*") if rng.random() < 0.2 else c for c in ref)
            s = "-" * rng.randint(0, 40) + s[40:] if rng.random() < 0.5 else s
            s = s.ljust(150, "-")[:150]
            rows.append((f"g{g}", i, f"h{i}" + ("|." if i < 3 else ""), s))
    df = spark.createDataFrame(rows, "gene string, ord long, header string, seq string")
    got = cull.cull_columns(df).collect()
    assert len(got) == len(rows)
    original = {(g, o): s for g, o, _, s in rows}
    for g in {r.gene for r in got}:
        assert len({len(r.seq) for r in got if r.gene == g and r.seq is not None}) == 1
    for r in got:
        residues = original[r.gene, r.ord].replace("-", "")
        if r.seq is not None and not r.header.endswith("."):
            assert "".join(c for i, c in enumerate(residues) if i not in set(r.drops)) == r.seq.replace("-", "")


def test_gff(spark, tmp_path):
    row = lambda s, a, b, strand, name, parent="G", note="1": "\t".join([s, "x", "CDS", str(a), str(b), ".", strand, "0", f"Name={name};Parent={parent};Note={note},q"])
    lines = ["##gff", row("s", 101, 400, "+", "n1"), row("s", 1000, 1299, "-", "n2"), row("s", 2000, 2100, "+", "n3"), row("s", 2010, 2050, "+", "n4"), "short\trow", row("s", 1, 30, "+", "n5"), row("s", 5000, 5100, "+", "e1"), row("s", 5000, 5100, "+", "e2")]
    p = tmp_path / "in.gff"
    p.write_text("\n".join(lines))
    rows = text.read_gff_rows(spark, str(p))
    culls = spark.createDataFrame([("G", "n1", "1", 2, 1), ("G", "n2", "1", 2, 1), ("G", "n5", "1", None, None)], "gene string, name string, frame string, left int, right int")
    introns = spark.createDataFrame([("G", "n2", "1", [(30, 10)])], f"gene string, name string, frame string, introns {cull.PAIRS}")
    out, inside = cull.apply_gff_culls(rows, culls, introns)
    got = [r.line.split("\t") for r in out.collect()]
    assert got[0] == ["##gff"]
    assert [(g[3], g[4], g[8].split(";")[0]) for g in got[1:]] == [("107", "397", "Name=n1"), ("1003", "1179", "Name=n2_E1"), ("1210", "1293", "Name=n2_E2"), ("2000", "2100", "Name=n3")] or print(got)
    assert {r.name for r in inside.collect()} == {"n4", "e1", "e2"}
    names = {r.name: (r.start, r.end, r.strand) for r in text.read_gff(spark, str(p)).collect()}
    assert names["n2"] == (1000, 1299, "-") and len(names) == 7


@pytest.mark.parametrize("n_refs", [0, 2, 9])
def test_genes_are_cleaned_in_slices(spark, monkeypatch, n_refs):
    """Genes dealt out over groups and slices, with columns that only candidates fill, as cleaned whole."""
    rng = random.Random(n_refs)
    rows = []
    for g in range(3):
        ref = base(150, g)
        gaps = set(range(60, 85)) if g < 2 else set()
        for i in range(60):
            is_ref = i < n_refs
            s = "".join("-" if (j in gaps and (is_ref or rng.random() < 0.3)) or rng.random() < 0.1 else rng.choice(AA + "*") if rng.random() < 0.2 else c for j, c in enumerate(ref))
            a, b = rng.randint(0, 60), rng.randint(90, 150)
            s = s if is_ref else "-" * a + s[a:b] + "-" * (150 - b)
            nt = "".join(rng.choice("ACGT") for _ in range(3 * 150)) if i % 2 else None
            rows.append((f"g{g}" if g else None, i, f"h{i % 50}" + ("|." if is_ref else ""), s, nt))
    df = spark.createDataFrame(rows, "gene string, ord long, header string, seq string, nt string")
    monkeypatch.setattr(cull, "DEALT_ROWS", 10)
    monkeypatch.setattr(cull, "SLICE_CELLS", 700)
    out = cull.cull_columns(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(r.gene, r.ord): (r.header, r.seq, r.drops, r.left_trim, r.right_trim, [tuple(x) for x in r.introns], [tuple(x) for x in r.exons]) for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for r, c in zip(mine, cull.cull_alignment([r[2] for r in mine], [r[3] for r in mine], {r[2]: r[4] for r in mine}), strict=True):
            want[g, r[1]] = (r[2], c.seq, c.drops, *(c.trim or (None, None)), c.introns, c.exons)
    assert got == want
    assert not n_refs or any(w[5] for w in want.values())
