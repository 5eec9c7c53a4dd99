"""Queries over sequence scalars, filters and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import blosum, codons
from seqspark.functions import sequences as S
from seqspark.operators import dedupe

from . import views as V

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query("translate_t1", f"WITH {V.NT} SELECT doc_id, aa, length(aa) - length(replace(aa, '*', '')) AS stops FROM (SELECT doc_id, {V.aa_sql('nt')} AS aa FROM nt)")
def translate_t1(spark, sf):
    aa = F.col("aa")
    return V.nt(spark, sf).select("doc_id", codons.translate(F.col("nt")).alias("aa")).select("doc_id", "aa", (F.length(aa) - F.length(F.replace(aa, F.lit("*"), F.lit("")))).cast("long").alias("stops"))


@query("translate_t2", f"WITH {V.NT} SELECT doc_id, {V.aa_sql('nt', 2)} AS aa FROM nt")
def translate_t2(spark, sf):
    return V.nt(spark, sf).select("doc_id", codons.translate(F.col("nt"), 2).alias("aa"))


_TABLES = [t for t in codons.CHANGES if t > 2]


@query("translate_tables", f"WITH {V.NT} " + " UNION ALL ".join(f"SELECT doc_id, {t} AS code, {V.aa_sql('nt', t)} AS aa FROM nt" for t in _TABLES))
def translate_tables(spark, sf):
    return codons.translate_all(V.nt(spark, sf), "doc_id", "nt", _TABLES)


@query(
    "revcomp",
    f"WITH {V.NT} SELECT doc_id, translate(reverse(nt), 'ACGT', 'TGCA') AS rc, translate(reverse(lower(nt)), 'acgt', 'TGCA') AS upper_rc, translate(regexp_replace(upper(reverse(lower(nt))), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') AS strict_rc FROM nt",
)
def revcomp(spark, sf):
    low = F.lower("nt")
    return V.nt(spark, sf).select("doc_id", S.revcomp(F.col("nt")).alias("rc"), S.revcomp_upper(low).alias("upper_rc"), S.complement_or_n(low).alias("strict_rc"))


@query(
    "index_pair",
    f"""WITH {V.ROWS} SELECT row_id, {V.FIRST} AS first, {V.LAST} AS last, CASE WHEN rtrim(seq, '-') = '' THEN 120 ELSE length(rtrim(seq, '-')) END AS flank_last,
    CASE WHEN rtrim(seq, '-') = '' THEN -1 ELSE length(rtrim(seq, '-')) - 1 END AS inclusive_last FROM rows""",
)
def index_pair(spark, sf):
    s = F.col("seq")
    p = S.find_index_pair(s)
    return V.rows(spark, sf).select("row_id", p["start"].alias("first"), p["end"].alias("last"), S.residue_span(s, 0, F.length(s))["end"].alias("flank_last"), S.residue_span(s, -1, -1, True)["end"].alias("inclusive_last"))


@query("same_kmer", f"WITH {V.ROWS} SELECT row_id, substr(seq, 1, 2) = substr(other, 1, 2) AS same FROM rows")
def same_kmer(spark, sf):
    return V.rows(spark, sf).select("row_id", S.is_same_kmer(F.substring("seq", 1, 2), F.substring("other", 1, 2)).alias("same"))


@query(
    "constrained_distance",
    f"""WITH {V.ROWS}, p AS (SELECT row_id, substr(replace(other, '-', 'X'), f + 1, l - f) AS con, substr(seq, f + 1, l - f) AS can FROM (SELECT *, {V.FIRST} AS f, {V.LAST} AS l FROM rows))
    SELECT row_id, greatest(0, len(list_filter(range(1, length(can) + 1), lambda i: substr(con, i, 1) <> substr(can, i, 1))) - (length(con) - length(replace(con, 'X', ''))))::BIGINT AS distance FROM p""",
)
def constrained_distance(spark, sf):
    return V.rows(spark, sf).select("row_id", S.constrained_distance(F.replace("other", F.lit("-"), F.lit("X")), F.col("seq")).alias("distance"))


_PAIR = f"{blosum.pair_sql()}"


@query(
    "blosum62_distance",
    f"""WITH {V.ROWS}, m AS MATERIALIZED (SELECT {_PAIR} AS m), t AS (SELECT row_id, coalesce(m[substr(a, i, 1) || substr(b, i, 1)], -4) AS x, coalesce(m[substr(a, i, 1) || substr(a, i, 1)], -4) AS y, coalesce(m[substr(b, i, 1) || substr(b, i, 1)], -4) AS z
      FROM (SELECT row_id, replace(seq, '-', '*') AS a, replace(other, '-', '*') AS b, unnest(range(1, 121)) AS i FROM rows), m)
    SELECT row_id, round(1.0::DOUBLE - sum(x)::DOUBLE / greatest(sum(y), sum(z))::DOUBLE, 6) AS distance FROM t GROUP BY row_id""",
)
def blosum62_distance(spark, sf):
    return V.rows(spark, sf).select("row_id", F.round(S.blosum62_distance(F.col("seq"), F.col("other")), 6).alias("distance"))


@query(
    "blosum62_candidate",
    f"""WITH {V.ROWS}, m AS MATERIALIZED (SELECT {_PAIR} AS m), t AS (SELECT row_id, CASE WHEN a IN ('-', '*') THEN -11 ELSE coalesce(m[a || b], -4) END AS x, CASE WHEN a IN ('-', '*') THEN -11 ELSE coalesce(m[a || a], -4) END AS y, coalesce(m[b || b], -4) AS z
      FROM (SELECT row_id, substr(seq, i, 1) AS a, substr(other, i, 1) AS b FROM (SELECT *, unnest(range(1, 121)) AS i FROM rows)), m WHERE b NOT IN ('-', '*')),
    d AS (SELECT row_id, sum(x) AS x, greatest(sum(y), sum(z)) AS best FROM t GROUP BY row_id)
    SELECT r.row_id, CASE WHEN coalesce(best, 0) <> 0 THEN round(1.0::DOUBLE - x::DOUBLE / best::DOUBLE, 6) END AS distance FROM rows r LEFT JOIN d USING (row_id)""",
)
def blosum62_candidate(spark, sf):
    d = S.blosum62_candidate_to_reference(F.col("seq"), F.col("other"))
    return V.rows(spark, sf).select("row_id", F.round(F.nanvl(d, F.lit(None).cast("double")), 6).alias("distance"))


@query("join_tripled", f"WITH {V.NT} SELECT doc_id, substr(nt, 1, 3) || substr(nt, 13, 3) || substr(nt, 7, 3) || substr(nt, 13, 3) AS joined FROM nt WHERE length(nt) >= 15")
def join_tripled(spark, sf):
    return V.nt(spark, sf).where(F.length("nt") >= 15).select("doc_id", codons.join_by_tripled_index(F.col("nt"), F.array(*map(F.lit, (0, 4, 2, 4)))).alias("joined"))


@query("join_excl", f"WITH {V.ROWS} SELECT row_id, '-' || substr(seq, 2, 2) || '-' || substr(seq, 5, 6) || '-' || substr(seq, 12) AS masked FROM rows")
def join_excl(spark, sf):
    return V.rows(spark, sf).select("row_id", S.join_with_exclusions(F.col("seq"), F.array(*map(F.lit, (0, 9, 30, 31)))).alias("masked"))


@query("join_triplets_excl", f"WITH {V.NT} SELECT doc_id, '---' || substr(nt, 4, 6) || '---' || substr(nt, 13, length(nt) // 3 * 3 - 12) AS masked FROM nt WHERE length(nt) >= 30")
def join_triplets_excl(spark, sf):
    cols = lambda *x: F.array(*map(F.lit, x))
    return V.nt(spark, sf).where(F.length("nt") >= 30).select("doc_id", codons.join_triplets_with_exclusions(codons.trim_to_codon(F.col("nt")), cols(0, 4), cols(9, 0)).alias("masked"))


@query("del_cols", f"WITH {V.ROWS} SELECT row_id, substr(seq, 1, 3) || '-' || substr(seq, 5, 6) || '-' || substr(seq, 12) AS aa, substr(seq, 1, 3) || '---' || substr(seq, 7, 4) || '---' || substr(seq, 14) AS nt FROM rows")
def del_cols(spark, sf):
    gone = F.array(F.lit(3), F.lit(10))
    return V.rows(spark, sf).select("row_id", S.del_cols(F.col("seq"), gone).alias("aa"), S.del_cols(F.col("seq"), gone, True).alias("nt"))


_RUNS = "list_transform(regexp_extract_all(seq, '[^-]+|-+'), lambda r: CASE WHEN r[1] = '-' OR length(r) < 5 THEN repeat('X', length(r)) ELSE r END)"


@query("mask_small_regions", f"WITH {V.ROWS} SELECT row_id, array_to_string({_RUNS}, '') AS masked FROM rows")
def mask_small_regions(spark, sf):
    return V.rows(spark, sf).select("row_id", S.mask_small_regions(F.col("seq"), 5).alias("masked"))


@query(
    "consensus_distance",
    f"""WITH {V.ROWS}, c AS (SELECT row_id, i, substr(seq, i, 1) AS raw, substr(replace(other, '-', 'X'), i, 1) AS con, substr(array_to_string({_RUNS}, ''), i, 1) AS can FROM (SELECT *, unnest(range(1, 121)) AS i FROM rows)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS region FROM c WHERE raw <> '-'),
    r AS (SELECT row_id, count(*) FILTER (con <> 'X' AND can <> 'X') AS overlap, count(*) FILTER (con <> 'X' AND con <> can) AS distance, count(*) AS n FROM g GROUP BY row_id, region)
    SELECT d.row_id, coalesce(sum(distance), 0)::BIGINT AS distance, coalesce(sum(n), 0)::BIGINT AS length FROM rows d LEFT JOIN r ON r.row_id = d.row_id AND overlap >= 4 GROUP BY d.row_id""",
)
def consensus_distance(spark, sf):
    d = S.consensus_distance(F.replace("other", F.lit("-"), F.lit("X")), F.col("seq"), 5, 4)
    return V.rows(spark, sf).select("row_id", d.alias("d")).select("row_id", F.col("d.distance").alias("distance"), F.col("d.length").alias("length"))


@query("normalize_records", f"WITH {V.ROWS} SELECT row_id, seq AS normal FROM rows")
def normalize_records(spark, sf):
    messy = F.concat(F.lit(" "), F.lower(F.replace("seq", F.lit("-"), F.lit("."))), F.lit(" "))
    return V.rows(spark, sf).select("row_id", S.normalize_record(messy).alias("normal"))


@query(
    "trim_locus",
    f"""WITH {V.SPANS} SELECT id, line, start + 3 * (CASE WHEN strand = '+' THEN line ELSE 2 END) AS a, greatest(0, "end" - 3 * (CASE WHEN strand = '+' THEN 2 ELSE line END)) AS b,
    CAST(scaffold AS VARCHAR) || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) || '(' || strand || ')' AS label FROM spans""",
)
def trim_locus(spark, sf):
    t = S.trim_locus(F.col("start"), F.col("end"), F.col("strand"), F.col("line"), F.lit(2))
    return V.spans(spark, sf).select("id", "line", t["start"].alias("a"), t["end"].alias("b"), S.region_label(F.col("scaffold").cast("string"), F.col("start"), F.col("end"), F.col("strand")).alias("label"))


@query(
    "header_fields",
    f"WITH {V.ROWS} SELECT row_id, string_split(header, '|')[4] AS node, string_split(header, '|')[5] AS frame, coalesce(string_split(header, '|')[6], header) AS tail, regexp_replace(header, '[|]n[0-9]+[|]', '|tag|') AS renamed, header LIKE '%.' AS is_ref FROM rows",
)
def header_fields(spark, sf):
    h = F.col("header")
    return V.rows(spark, sf).select("row_id", S.header_field(h, 3).alias("node"), S.header_field(h, 4).alias("frame"), S.header_field(h, 5, h).alias("tail"), S.rename_node(h, F.lit("tag")).alias("renamed"), S.is_reference(h).alias("is_ref"))


@query("n_chunks", f"WITH {V.NT}, c AS (SELECT doc_id, unnest(string_split(nt, 'N')) AS chunk FROM nt WHERE length(nt) >= 30) SELECT doc_id, chunk FROM c WHERE length(chunk) >= 30")
def n_chunks(spark, sf):
    return V.nt(spark, sf).where(F.length("nt") >= 30).select("doc_id", F.explode(S.n_chunks(F.col("nt"), 30)).alias("chunk"))


@query("filter_nt", f"WITH {V.ROWS} SELECT header, seq FROM rows WHERE header NOT IN (SELECT header FROM rows WHERE is_ref)")
def filter_nt(spark, sf):
    rows = V.rows(spark, sf)
    return rows.select("header", "seq").join(rows.where("is_ref").select("header"), "header", "left_anti")


@query("min_length", f"WITH {V.ROWS} SELECT header, length(replace(seq, '-', '')) AS n FROM rows WHERE is_ref OR length(replace(seq, '-', '')) >= 100")
def min_length(spark, sf):
    n = F.length(F.replace("seq", F.lit("-"), F.lit("")))
    return V.rows(spark, sf).where(F.col("is_ref") | (n >= 100)).select("header", n.cast("long").alias("n"))


_PHASES = " OR ".join(f"(substr(nt, {p + 1}, 2) IN ('GT', 'GC') AND substr(nt, n + {p - 1}, 2) = 'AG' AND n + {p} <= length(nt))" for p in range(3))


@query("splice_sites", f"WITH {V.NT} SELECT doc_id, n >= 30 AND ({_PHASES}) AS spliced FROM (SELECT *, length(nt) // 3 * 3 AS n FROM nt)")
def splice_sites(spark, sf):
    return V.nt(spark, sf).select("doc_id", S.spliced(F.col("nt"), F.lit(0), F.floor(F.length("nt") / 3).cast("int")).alias("spliced"))


@query(
    "low_complexity",
    f"""WITH {V.NT}, head AS (SELECT doc_id, nt FROM nt),
    seg AS (SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(regexp_extract_all(nt, '[ACGT]+')) AS s, unnest(range(1, len(regexp_extract_all(nt, '[ACGT]+')) + 1)) AS pos FROM head) WHERE length(s) >= 30),
    starts AS (SELECT doc_id, pos, s, least(60, length(s)) AS size, unnest(CASE WHEN length(s) <= 60 THEN [0] ELSE list_distinct(list_append(range(0, length(s) - 59, 15), length(s) - 60)) END) AS p0 FROM seg),
    win AS (SELECT doc_id, pos, p0, size, substr(s, p0 + 1, size) AS w FROM starts),
    di AS (SELECT doc_id, pos, p0, k, count(*) AS c FROM (SELECT *, substr(w, unnest(range(1, size)), 2) AS k FROM win) GROUP BY ALL),
    tri AS (SELECT doc_id, pos, p0, k, count(*) AS c FROM (SELECT *, substr(w, unnest(range(1, size - 1)), 3) AS k FROM win) GROUP BY ALL),
    h2 AS (SELECT doc_id, pos, p0, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2) AS h FROM di GROUP BY ALL),
    h3 AS (SELECT doc_id, pos, p0, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2) AS h FROM tri GROUP BY ALL),
    f AS (SELECT w.doc_id, w.size, h2.h < 3.6 OR h3.h < 4.9 AS low FROM win w JOIN h2 USING (doc_id, pos, p0) JOIN h3 USING (doc_id, pos, p0)),
    t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (low) AS fail, coalesce(sum(size) FILTER (low), 0) AS bp FROM f GROUP BY doc_id)
    SELECT nt.doc_id, coalesce(n >= 4 AND fail / n >= 0.5 AND bp >= 100, false) AS low FROM nt LEFT JOIN t USING (doc_id)""",
)
def low_complexity(spark, sf):
    return V.nt(spark, sf).select("doc_id", S.low_complexity(F.col("nt"), dinuc=3.6, trinuc=4.9).alias("low"))


@query(
    "canonical_dedupe",
    f"""WITH {V.NT}, s AS (SELECT doc_id, nt AS seq FROM nt), c AS (SELECT doc_id, least(seq, translate(reverse(seq), 'ACGT', 'TGCA')) AS seq FROM s),
    g AS (SELECT seq, count(*) AS n, min(doc_id) AS first FROM c GROUP BY seq), o AS (SELECT row_number() OVER (ORDER BY first) AS id, seq, n FROM g) SELECT id, seq, n FROM o WHERE n >= 2""",
)
def canonical_dedupe(spark, sf):
    return dedupe.canonical_dedupe(V.nt(spark, sf).select("doc_id", F.col("nt").alias("seq")), ["doc_id"], min_size=2)


@query("genomic_order", f"""WITH {V.SPANS} SELECT id, line, row_number() OVER (PARTITION BY scaffold ORDER BY start, "end", id, line) AS place FROM spans""")
def genomic_order(spark, sf):
    from pyspark.sql import Window as W

    return V.spans(spark, sf).select("id", "line", F.row_number().over(W.partitionBy("scaffold").orderBy("start", "end", "id", "line")).cast("long").alias("place"))


@query("best_of_header", f"WITH {V.ROWS} SELECT gene, row_id, n FROM (SELECT gene, row_id, length(replace(seq, '-', '')) AS n, row_number() OVER (PARTITION BY gene ORDER BY length(replace(seq, '-', '')) DESC, row_id) AS k FROM rows) WHERE k = 1")
def best_of_header(spark, sf):
    n = F.length(F.replace("seq", F.lit("-"), F.lit(""))).cast("long")
    best = V.rows(spark, sf).groupBy("gene").agg(F.min(F.struct((-n).alias("n"), "row_id")).alias("b"))
    return best.select("gene", F.col("b.row_id").alias("row_id"), (-F.col("b.n")).alias("n"))


@query("set_operations", f"WITH {V.NT}, s AS (SELECT doc_id, [doc_id % 3, doc_id % 5, 7] AS a, [doc_id % 4, 7, doc_id % 5] AS b FROM nt) SELECT doc_id, len(list_distinct(list_intersect(a, b)))::BIGINT AS common, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))::BIGINT AS only_a, len(list_distinct(list_concat(a, b)))::BIGINT AS either FROM s")
def set_operations(spark, sf):
    mod = lambda n: F.col("doc_id") % n
    a, b = F.array(mod(3), mod(5), F.lit(7)), F.array(mod(4), F.lit(7), mod(5))
    n = lambda c: F.size(c).cast("long")
    return V.nt(spark, sf).select("doc_id", n(F.array_intersect(a, b)).alias("common"), n(F.array_except(a, b)).alias("only_a"), n(F.array_union(a, b)).alias("either"))
