"""Queries over alignment columns. Genes are groups of documents; see views."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import blosum
from seqspark.functions import sequences as S
from seqspark.operators import columns as C

from . import views as V

QUERIES, ORACLE = {}, {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _consensus_sql(threshold: float, depth: int, weight: str) -> str:
    return f"""{V.CELLS}, n AS (SELECT gene, col, CASE WHEN ch IN ('-', '*') THEN '~' ELSE ch END AS b, sum({weight}) AS n FROM cells WHERE inside GROUP BY ALL),
    t AS (SELECT gene, col, sum(n) AS total, max(n) AS top, arg_min(b, (-n, b)) AS b FROM n GROUP BY gene, col),
    w AS (SELECT gene, col, CASE WHEN total >= {max(1, depth)} AND top / total > {threshold} THEN replace(b, '~', '-') ELSE 'X' END AS ch FROM t),
    consensus AS (SELECT g.gene, string_agg(coalesce(w.ch, 'X'), '' ORDER BY g.col) AS consensus FROM (SELECT DISTINCT gene, unnest(range(0, 120)) AS col FROM rows) g LEFT JOIN w ON w.gene = g.gene AND w.col = g.col GROUP BY g.gene)"""


@_query("consensus", f"WITH {_consensus_sql(0.25, 0, '1')} SELECT gene, consensus FROM consensus")
def consensus(spark, sf):
    return C.consensus(V.rows(spark, sf), "gene", 0.25)


@_query("consensus_depth", f"WITH {_consensus_sql(0.2, 3, '1')} SELECT gene, consensus FROM consensus")
def consensus_depth(spark, sf):
    return C.consensus(V.rows(spark, sf), "gene", 0.2, 3)


@_query("consensus_weighted", f"WITH {_consensus_sql(0.3, 0, 'weight')} SELECT gene, consensus FROM consensus")
def consensus_weighted(spark, sf):
    return C.consensus(V.rows(spark, sf), "gene", 0.3, weight="weight")


@_query("consensus_weighted_depth", f"WITH {_consensus_sql(0.3, 12, 'weight')} SELECT gene, consensus FROM consensus")
def consensus_weighted_depth(spark, sf):
    return C.consensus(V.rows(spark, sf), "gene", 0.3, 12, weight="weight")


_KEEP = "keep AS (SELECT gene, col FROM cells GROUP BY gene, col HAVING bool_or(ch <> '-'))"


@_query(
    "drop_empty_columns",
    f"WITH {V.CELLS}, {_KEEP} SELECT r.header, coalesce(string_agg(substr(r.seq, k.col + 1, 1), '' ORDER BY k.col), '') AS seq FROM rows r LEFT JOIN keep k ON k.gene = r.gene GROUP BY r.header, r.row_id",
)
def drop_empty_columns(spark, sf):
    return C.drop_empty_columns(V.rows(spark, sf).select("header", "gene", "seq"), "gene").select("header", "seq")


_REFS = "SELECT gene, col, ch, (SELECT count(*) FROM rows r WHERE r.gene = c.gene AND is_ref) AS n_refs FROM cells c WHERE is_ref"


@_query("ref_occupancy", f"WITH {V.CELLS} SELECT gene, col, any_value(n_refs) AS n_refs, (count(*) FILTER (ch <> '-'))::BIGINT AS filled, round(1.0::DOUBLE - (count(*) FILTER (ch <> '-'))::DOUBLE / any_value(n_refs), 9) AS gap_share FROM ({_REFS}) GROUP BY gene, col")
def ref_occupancy(spark, sf):
    return C.occupancy(V.rows(spark, sf).where("is_ref"), "gene").withColumn("gap_share", F.round("gap_share", 9))


@_query("reference_columns", f"WITH {V.CELLS} SELECT gene, col, ch, count(*) AS n FROM cells c WHERE is_ref AND inside AND EXISTS (SELECT 1 FROM rows r WHERE r.row_id = c.row_id AND replace(r.seq, '-', '') <> '') GROUP BY ALL")
def reference_columns(spark, sf):
    return C.reference_columns(V.rows(spark, sf).where("is_ref"), "gene")


def _pssm_sql(fills: str) -> str:
    amino = ", ".join(f"'{a}'" for a in blosum.AMINO)
    return f"""{V.CELLS}, used AS (SELECT gene, col FROM (SELECT gene, col, count(*) FILTER ({fills}) / any_value(n_refs) AS occ, count(*) FILTER (ch IN ({amino})) AS total FROM ({_REFS}) WHERE col >= 10 AND col < 90 GROUP BY gene, col) WHERE occ >= 0.3 AND total > 0),
    mix AS (SELECT gene, col, ch, count(*) AS n FROM cells SEMI JOIN used USING (gene, col) WHERE is_ref AND ch IN ({amino}) GROUP BY ALL), m AS MATERIALIZED (SELECT {blosum.pair_sql()} AS m),
    s AS (SELECT gene, col, aa, (sum(m[aa || ch] * n) / sum(n))::DOUBLE AS score FROM (SELECT *, unnest(string_split('{blosum.AMINO}', '')) AS aa FROM mix), m GROUP BY gene, col, aa),
    pssm AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY gene, col) AS col_max FROM s) WHERE col_max > 0)"""


@_query("pssm_window", f"WITH {_pssm_sql('''ch NOT IN ('-', '.')''')} SELECT gene, col, aa, round(score, 9) AS score, round(col_max, 9) AS col_max FROM pssm")
def pssm_window(spark, sf):
    p = C.pssm(V.rows(spark, sf).where("is_ref"), "gene", 10, 90)
    return p.withColumn("score", F.round("score", 9)).withColumn("col_max", F.round("col_max", 9))


_AMINO = ", ".join(f"'{a}'" for a in blosum.AMINO)


@_query("pssm_stop_trim", f"WITH {_pssm_sql(f'ch IN ({_AMINO})')} SELECT gene, count(*)::BIGINT AS n, round(sum(col_max), 6) AS total FROM pssm GROUP BY gene")
def pssm_stop_trim(spark, sf):
    p = C.pssm(V.rows(spark, sf).where("is_ref"), "gene", 10, 90, standard_only=True)
    return p.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("col_max"), 6).alias("total"))


@_query(
    "score_window",
    f"""WITH {_pssm_sql('''ch NOT IN ('-', '.')''')}, tops AS (SELECT DISTINCT gene, col, col_max FROM pssm), full_max AS (SELECT gene, sum(col_max) AS full_max FROM tops GROUP BY gene),
    c AS (SELECT x.gene, x.row_id, x.ch, t.col, t.col_max FROM cells x JOIN tops t USING (gene, col) WHERE NOT is_ref AND ch NOT IN ('-', '.')),
    sc AS (SELECT c.gene, c.row_id, count(*) AS residues, sum(coalesce(p.score, -4.0)) AS score, sum(c.col_max) AS covered_max FROM c LEFT JOIN pssm p ON p.gene = c.gene AND p.col = c.col AND p.aa = c.ch GROUP BY ALL)
    SELECT row_id, residues, round(score::DOUBLE, 6) AS score, round((score / full_max * 100)::DOUBLE, 6) AS full, round((score / covered_max * 100)::DOUBLE, 6) AS covered FROM sc JOIN full_max USING (gene)""",
)
def score_window(spark, sf):
    rows = V.rows(spark, sf)
    p = C.pssm(rows.where("is_ref"), "gene", 10, 90)
    out = C.score_window(rows.where("NOT is_ref"), p, "gene", 10, 90, "row_id")
    return out.select("row_id", "residues", *(F.round(c, 6).alias(c) for c in ("score", "full", "covered")))


@_query(
    "convert_consensus",
    f"""WITH {_consensus_sql(0.25, 0, '1')}, {_KEEP}, z AS (SELECT *, CASE WHEN ltrim(consensus, 'X') = '' THEN 0 ELSE 120 - length(ltrim(consensus, 'X')) END AS f, CASE WHEN rtrim(consensus, 'X') = '' THEN 1 ELSE length(rtrim(consensus, 'X')) END AS l FROM consensus),
    q AS (SELECT gene, string_agg(CASE WHEN i >= f AND i < l AND NOT EXISTS (SELECT 1 FROM keep k WHERE k.gene = g.gene AND k.col = i) THEN '?' ELSE substr(consensus, i + 1, 1) END, '' ORDER BY i) AS m FROM (SELECT *, unnest(range(0, 120)) AS i FROM z) g GROUP BY gene),
    runs AS (SELECT gene, regexp_extract_all(m, '[?]+|[^?]+') AS r FROM q)
    SELECT gene, array_to_string(list_transform(r, lambda x, i: CASE WHEN x[1] = '?' AND length(x) < 8 AND i < len(r) THEN repeat('-', length(x)) ELSE x END), '') AS converted FROM runs""",
)
def convert_consensus(spark, sf):
    rows = V.rows(spark, sf)
    return C.convert_consensus(rows, C.consensus(rows, "gene", 0.25), "gene")


@_query(
    "edge_mask",
    f"""WITH {V.CELLS}, o AS (SELECT gene, col, count(*) FILTER (ch <> '-') / any_value(n_refs) >= 0.5 AS filled FROM ({_REFS}) GROUP BY gene, col)
    SELECT gene, coalesce(min(col) FILTER (filled), 0)::INT AS first, coalesce(max(col) FILTER (filled), max(col))::INT AS last FROM o GROUP BY gene""",
)
def edge_mask(spark, sf):
    return C.edge_mask(V.rows(spark, sf).where("is_ref"), "gene")


@_query("median_span", f"WITH {V.ROWS}, s AS (SELECT gene, {V.FIRST} AS f, {V.LAST} AS l FROM rows WHERE is_ref) SELECT gene, list_sort(list(f))[count(*) // 2 + 1]::INT AS start, list_sort(list(l))[count(*) // 2 + 1]::INT AS \"end\" FROM s GROUP BY gene")
def median_span(spark, sf):
    return C.median_span(V.rows(spark, sf).where("is_ref"), "gene")


@_query(
    "residue_blocks",
    f"""WITH {V.CELLS}, r AS (SELECT row_id, col, col - row_number() OVER (PARTITION BY row_id ORDER BY col) AS island FROM cells WHERE ch <> '-') SELECT row_id, min(col)::INT AS start, max(col)::INT AS "end", count(*) AS n FROM r GROUP BY row_id, island""",
)
def residue_blocks(spark, sf):
    from seqspark.operators.intervals import blocks

    return blocks(C.cells(V.rows(spark, sf), "row_id", span=False).where("ch <> '-'"), ["row_id"], "col")


@_query(
    "bridged_blocks",
    f"""WITH {V.CELLS}, r AS (SELECT row_id, col, CASE WHEN col - lag(col) OVER (PARTITION BY row_id ORDER BY col) <= 8 THEN 0 ELSE 1 END AS fresh FROM cells WHERE ch <> '-'),
    b AS (SELECT row_id, col, sum(fresh) OVER (PARTITION BY row_id ORDER BY col) AS k FROM r) SELECT row_id, min(col)::INT AS start, max(col)::INT AS "end", count(*) AS n FROM b GROUP BY row_id, k""",
)
def bridged_blocks(spark, sf):
    from seqspark.operators.intervals import blocks

    return blocks(C.cells(V.rows(spark, sf), "row_id", span=False).where("ch <> '-'"), ["row_id"], "col", 8)


@_query(
    "residue_ordinals",
    f"WITH {V.CELLS} SELECT row_id, col, (row_number() OVER (PARTITION BY row_id ORDER BY col) - 1)::BIGINT AS ordinal FROM cells WHERE ch <> '-'",
)
def residue_ordinals(spark, sf):
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("row_id").orderBy("col")) - 1
    return C.cells(V.rows(spark, sf), "row_id", span=False).where("ch <> '-'").select("row_id", "col", at.cast("long").alias("ordinal"))


@_query(
    "qualify_gap",
    f"""WITH {V.CELLS}, g AS (SELECT gene, (count(*) FILTER (gap))::BIGINT AS gaps FROM (SELECT gene, col, count(*) FILTER (ch = '-') / any_value(n_refs) >= 0.67 AS gap FROM ({_REFS}) GROUP BY gene, col) WHERE col >= 20 AND col < 80 GROUP BY gene)
    SELECT gene, CASE WHEN 60 - gaps >= 10 AND 60 - gaps < 250 THEN 60 - gaps END AS effective, CASE WHEN 60 - gaps >= 10 AND 60 - gaps < 250 THEN greatest(10, (60 - gaps) // 2) END AS min_aa FROM g""",
)
def qualify_gap(spark, sf):
    from seqspark.operators.intervals import qualify_gap as gap

    occ = C.occupancy(V.rows(spark, sf).where("is_ref"), "gene", gaps=("-", " "))
    # the share is compared as a count, so that both engines round alike
    flags = occ.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("col", ((F.col("n_refs") - F.col("filled")) / F.col("n_refs") >= 0.67).cast("int").alias("gap")))).alias("f"))
    before = F.aggregate("f", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["gap"]))
    q = gap(F.lit(20), F.lit(80), before)
    return flags.select("gene", q.alias("q")).select("gene", F.col("q.effective").cast("long").alias("effective"), F.col("q.min_aa").cast("long").alias("min_aa"))


@_query("restore_stops", f"WITH {V.ROWS} SELECT row_id, seq FROM rows")
def restore_stops(spark, sf):
    """Stops masked for an aligner come back at the ordinals of their residues."""
    from seqspark.operators.records import restore_stops as restore

    rows = V.rows(spark, sf)
    return rows.select("row_id", restore(S.mask_stops(F.col("seq")), F.replace("seq", F.lit("-"), F.lit(""))).alias("seq"))
