"""Queries over clusters of nodes, drawn from the line items: an order is a cluster, its items are tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import clusters as C

from . import views as V

QUERIES, ORACLE = {}, {}


def _query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


@_query(
    "end_nodes",
    f"""WITH {V.SPANS}, n AS (SELECT scaffold, id * 1000 + line AS ord, start, CASE WHEN strand = '+' THEN 1 ELSE -2 END AS frame FROM spans),
    w AS (SELECT *, first_value(frame) OVER (PARTITION BY scaffold ORDER BY ord) < 0 AS down FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY CASE WHEN down THEN -start ELSE start END, ord) AS k, count(*) OVER (PARTITION BY scaffold) AS m FROM w),
    e AS (SELECT h.scaffold, h.ord AS head, t.ord AS tail, h.frame < 0 AS turned FROM o h JOIN o t ON h.scaffold = t.scaffold AND h.k = 1 AND t.k = t.m)
    SELECT scaffold, CASE WHEN turned THEN tail ELSE head END AS first_node, CASE WHEN turned THEN head ELSE tail END AS last_node FROM e""",
)
def end_nodes(spark, sf):
    ord_ = F.col("id") * 1000 + F.col("line")
    nodes = V.spans(spark, sf).select("scaffold", ord_.alias("ord"), ord_.alias("node"), F.when(F.col("strand") == "+", 1).otherwise(-2).alias("frame"), "start")
    return C.end_nodes(nodes, ["scaffold"])


_TOKENS = f"""{V.SPANS}, t AS (SELECT id % 50 AS gene, id AS cluster_key, line AS node_ord, start // 100 AS node, (start // 100) % 3 = 0 AS modular FROM spans),
  gff AS (SELECT p_partkey AS name, p_partkey % 4 AS scaffold, CASE WHEN p_partkey % 7 < 3 THEN '+' ELSE '-' END AS strand FROM part WHERE p_partkey % 5 <> 0)"""


def _tokens(spark, sf):
    part = F.floor(F.col("start") / 100)
    return V.spans(spark, sf).select((F.col("id") % 50).alias("gene"), F.col("id").alias("cluster_key"), F.col("line").alias("node_ord"), part.alias("node"), (part % 3 == 0).alias("modular"))


@_query(
    "slots",
    f"""WITH {_TOKENS}, s AS (SELECT a.gene, a.cluster_key, a.node_ord, l.node AS left_node, r.node AS right_node FROM t a JOIN t l ON l.cluster_key = a.cluster_key AND l.node_ord = a.node_ord - 1
      JOIN t r ON r.cluster_key = a.cluster_key AND r.node_ord = a.node_ord + 1 WHERE a.modular AND NOT l.modular AND NOT r.modular),
    g AS (SELECT s.*, x.scaffold, x.strand, row_number() OVER (PARTITION BY s.gene, x.scaffold, left_node, right_node ORDER BY cluster_key, node_ord) AS k FROM s
      JOIN gff x ON x.name = left_node JOIN gff y ON y.name = right_node AND x.scaffold = y.scaffold)
    SELECT gene, scaffold, left_node, right_node, cluster_key, node_ord, strand FROM g WHERE k = 1""",
)
def slots(spark, sf):
    name = F.col("p_partkey")
    gff = V.table(spark, sf, "part").where(name % 5 != 0).select(name.alias("name"), (name % 4).alias("scaffold"), F.when(name % 7 < 3, "+").otherwise("-").alias("strand"))
    return C.slots(_tokens(spark, sf), gff)


@_query(
    "cluster_members",
    f"""WITH {_TOKENS} SELECT DISTINCT t.gene, t.cluster_key, t.node, p_size AS size FROM t JOIN part ON p_partkey = t.node AND p_size % 50 = t.gene""",
)
def cluster_members(spark, sf):
    candidates = V.table(spark, sf, "part").select((F.col("p_size") % 50).cast("long").alias("gene"), F.col("p_partkey").alias("node"), F.col("p_size").alias("size"))
    return C.members(_tokens(spark, sf), candidates)


@_query(
    "score_gates",
    f"""WITH {V.SPANS}, c AS (SELECT id, line, start % 40 AS residues, ("end" - start) // 40 AS cols, (start + line) % 101 AS covered FROM spans)
    SELECT id, line, CASE WHEN residues < 15 AND residues < cols THEN 'gap_residues' WHEN covered < 20 THEN 'low_blosum' END AS rejected FROM c""",
)
def score_gates(spark, sf):
    cols = F.floor((F.col("end") - F.col("start")) / 40)
    gate = C.score_gate(F.col("start") % 40, cols, (F.col("start") + F.col("line")) % 101)
    return V.spans(spark, sf).select("id", "line", gate.alias("rejected"))
