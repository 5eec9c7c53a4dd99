import pytest
from pyspark.sql import functions as F

from seqspark.operators import clusters as C



def test_end_nodes(spark):
    rows = [("up", 1, "a", 1, 50), ("up", 2, "b", 2, 10), ("up", 3, "c", 1, 50), ("down", 1, "d", -1, 5), ("down", 2, "e", -1, 9), ("down", 3, "f", -1, 5), ("one", 1, "g", -3, 7)]
    mixed = [("mixed", 1, "h", -1, 3), ("mixed", 2, "i", 1, 8)]
    got = C.end_nodes(spark.createDataFrame(rows + mixed, "k string, ord long, node string, frame int, start long"), ["k"]).collect()
    assert {r.k: (r.first_node, r.last_node) for r in got} == {"up": ("b", "c"), "down": ("f", "e"), "one": ("g", "g"), "mixed": ("i", "h")}


def test_slots(spark):
    def tokens(key, text):
        return [("g", key, i, t.lower(), t.isupper()) for i, t in enumerate(text)]

    rows = tokens("k1", "aBc") + tokens("k0", "aDcE") + tokens("k2", "aBCd") + tokens("k3", "Fax")
    rows += tokens("k4", "aGz") + tokens("k5", "aGq")  # z is on another scaffold, q has no entry
    gff = [("a", "s", "-"), ("c", "s", "+"), ("z", "t", "+"), ("d", "s", "+")]
    got = C.slots(spark.createDataFrame(rows, "gene string, cluster_key string, node_ord int, node string, modular boolean"), spark.createDataFrame(gff, "name string, scaffold string, strand string")).collect()
    assert [tuple(r) for r in got] == [("g", "s", "a", "c", "k0", 1, "-")]


@pytest.mark.parametrize("values, reason", [((15, 40, 20.0), None), ((14, 40, 90.0), "gap_residues"), ((9, 9, 19.9), "low_blosum"), ((9, 9, 20.0), None), ((8, 9, 0.0), "gap_residues")])
def test_score_gate(spark, values, reason):
    df = spark.createDataFrame([values], "r int, c int, p double")
    assert df.select(C.score_gate(F.col("r"), F.col("c"), F.col("p"))).first()[0] == reason
