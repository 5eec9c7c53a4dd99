"""Secret scans: base patterns, and multipart credentials linked by an interval join; DataFrame operations only.

Base spans (assign, access, hex) are the leftmost non-overlapping matches of each pattern; of the matches
of assign, those whose value has fewer than 6 characters are dropped afterwards, so what they cover stays
covered. The method adds weak candidates: an account name, an opaque mixed token or an endpoint alone
says little, so each is reported only if its complementary parts begin within SCOPE code points of it in
the same document: an account needs a secret, an opaque token needs an identifier, an endpoint both.

The interval join deals parts out by (document, position div SCOPE); each such cell is first reduced to
the first and last start of each role, and a candidate looks at its own and the two neighbouring cells,
which decides the question exactly with at most three rows for a candidate, however many parts there are.

Defined cases: a null text counts as empty and has no spans; positions are code points, ends exclusive;
spans of different kinds may overlap; rows repeated with the same id and text get equal results, one
row each; a null id is treated as one more id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import join_by_key, text_of, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of under 20 characters holds no longer one
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
#: In the order in which ties of the start are listed, with the role of a part and the roles that it must find.
KINDS = {"assign": (ASSIGN, "S", ""), "access": (ACCESS, "I", ""), "hex": (HEX, "S", ""), "account": (ACCOUNT, "I", "S"), "opaque": (OPAQUE, "S", "I"), "endpoint": (ENDPOINT, "E", "IS")}
ORDER = list(KINDS)
SCOPE = 400


def _keeps(kind: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    if kind == "opaque":
        return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    return F.lit(True)


def _parts(text: Column, kind: str) -> tuple[Column, Column]:
    """The matches of a kind, and the texts before, between and after them."""
    pattern = KINDS[kind][0]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _described(rank: int, kind: str):
    return lambda m, at: F.struct(F.lit(rank).alias("rank"), at.alias("at"), F.length(m).alias("long"), _keeps(kind, m).alias("counts"))


def _only(kind: str):
    return lambda x: x["kind"] == kind


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: key and spans, an array of (start, rank, end, kind) in order."""
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    for k in ORDER:
        rows = rows.withColumn(f"m_{k}", _parts(F.col("text"), k)[0])
    lists = []
    for i, k in enumerate(ORDER):
        gaps = F.when(F.size(f"m_{k}") > 0, F.transform(_parts(F.col("text"), k)[1], F.length))
        one = F.transform(F.col(f"m_{k}"), _described(i, k))
        lists.append(F.when(F.size(f"m_{k}") > 0, F.zip_with(one, F.slice(gaps, 1, F.size(f"m_{k}")), lambda a, g: a.withField("gap", g))).otherwise(F.array()))
    table = written(rows.select("id", F.xxhash64("text").alias("print"), F.concat(*lists).alias("parts")), "parts")
    with_any = table.where(F.size("parts") > 0)
    placed = _placed(with_any.groupBy("id", "print", "parts").agg(F.count(F.lit(1)).alias("rows")))
    told = placed.where(F.col("counts") & (F.col("rank") < 3)).select("id", "print", "rows", "start", "rank", "end")
    told = told.unionByName(_linked(placed, scope))
    told = told.groupBy("id", "print").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("s"))
    told = told.select("id", "print", "rows", F.transform("s", lambda x: x.withField("kind", F.element_at(F.array(*map(F.lit, ORDER)), x["rank"] + 1))).alias("spans"))
    told = told.withColumn("id_null", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast(told.schema["id"].dataType)))
    named = with_any.select(F.coalesce("id", F.lit(0).cast(table.schema["id"].dataType)).alias("id"), F.col("id").isNull().alias("id_null"), "print")
    total = table.count()
    found = join_by_key(named, told, ["id", "id_null", "print"], "rows", total).select(F.when(~F.col("id_null"), F.col("id")).alias(key), "spans")
    none = table.where(F.size("parts") == 0).select(F.col("id").alias(key), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    empty = F.array().cast(found.schema["spans"].dataType)
    return found.unionByName(none).select(key, F.coalesce("spans", empty).alias("spans"))


def _placed(uniq: DataFrame) -> DataFrame:
    """A row for each part, with its start and end: sums over the parts of its kind before it in the document."""
    flat = uniq.select("id", "print", "rows", F.explode("parts").alias("p")).select("id", "print", "rows", "p.*")
    before = W.partitionBy("id", "print", "rank").orderBy("at")
    end = F.sum(F.col("gap") + F.col("long")).over(before)
    return flat.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("long"))


def _linked(placed: DataFrame, scope: int) -> DataFrame:
    """The weak candidates that have their complementary parts in scope."""
    role = F.element_at(F.array(*[F.lit(KINDS[k][1]) for k in ORDER]), F.col("rank") + 1)
    needs = F.element_at(F.array(*[F.lit(KINDS[k][2]) for k in ORDER]), F.col("rank") + 1)
    parts = placed.where("counts").withColumn("role", role).withColumn("cell", F.floor(F.col("start") / scope))
    cells = parts.where("role <> 'E'").groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("c_id"), F.col("print").alias("c_print"), F.col("cell").alias("c_cell"), F.col("role").alias("c_role")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    weak = parts.where(F.col("rank") >= 3).withColumn("needs", needs)
    looks = weak.withColumn("look", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    near = (F.col("low").between(F.col("start") - scope, F.col("start") + scope)) | (F.col("high").between(F.col("start") - scope, F.col("start") + scope))
    met = looks.join(cells, (F.coalesce(F.col("id").cast("string"), F.lit("")) == F.col("c_id")) & (F.col("print") == F.col("c_print")) & (F.col("look") == F.col("c_cell")) & F.col("needs").contains(F.col("c_role")) & near)
    met = met.groupBy("id", "print", "rows", "start", "rank", "end", "needs").agg(F.countDistinct("c_role").alias("roles"))
    return met.where(F.col("roles") == F.length("needs")).select("id", "print", "rows", "start", "rank", "end")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    s = F.col("spans")
    counts = [F.size(F.filter(s, _only(k))).cast("long").alias(f"n_{k}") for k in ORDER[:3]]
    base = F.filter(s, lambda x: x["rank"] < 3)
    return df.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(s).alias("spans"))
