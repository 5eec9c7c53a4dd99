import hashlib
import random
import re

from seqspark.llm import queries, secrets

SCHEMA = "doc_id long, text string, spans string, rank int, id long"
A = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
OTHERS = {k: re.compile(secrets.KINDS[k][0], re.A) for k in ("account", "opaque", "endpoint")}


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(found)
    for k, p in OTHERS.items():
        found += [(m.start(), secrets.ORDER.index(k), m.end()) for m in p.finditer(text) if k != "opaque" or all(re.search(x, m[0]) for x in ("[0-9]", "[A-Z]", "[a-z]"))]
    role = lambda r: secrets.KINDS[secrets.ORDER[r]][1]
    met = lambda p, want: all(any(role(q[1]) == w and abs(q[0] - p[0]) <= secrets.SCOPE for q in found) for w in want)
    every = base + [p for p in found if p[1] >= 3 and met(p, secrets.KINDS[secrets.ORDER[p[1]]][2])]
    name = lambda ps: ",".join(f"{secrets.ORDER[r]}:{a}:{b}" for a, r, b in sorted(ps))
    count = lambda r: sum(p[1] == r for p in base)
    return (count(0), count(1), count(2), hashlib.sha256(name(base).encode()).hexdigest(), name(every))


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 3, 7) for i, t in docs], SCHEMA)
    got = secrets.digests(secrets.spans(df)).collect()
    assert sorted((repr(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted((repr(i), *brute(t)) for i, t in docs)
    return {r.doc_id: r.spans for r in got}


def test_against_brute_force(spark):
    rng = random.Random(3)
    key, opaque = "AKIA" + "Z9" * 8, "aB3" + "x/Y9" * 10
    pool = [key, "AKIAAKIASHORT", opaque, "password=abc", "token=token:abcdefgh", "Secret : 'abcdef1", "API_KEY=\"zz.zz=zz", "https://h.example/x?y", "user=bob", "deadbeef" * 4, "0123456789abcdef", "é", "\n", "plain words here", "ſecret=abcdefgh", " " * 150, "secret", "=", ":"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (None, f"{key} {opaque}"), (None, None), (1002, "token=abcdef " * 4000), (1003, f"{key} {opaque}"), (1003, f"{key} {opaque}"), (1003, "user=bob")]
    out = check(spark, docs)
    assert "opaque" in out[None] or out[None] == "" and out[1003] is not None
    assert secrets.digests(secrets.spans(spark.createDataFrame([], SCHEMA))).count() == 0


def test_weak_parts_need_their_complements(spark):
    key, opaque = "AKIA" + "Z9" * 8, "aB3" + "x/Y9" * 10
    out = check(spark, [(1, opaque), (2, f"{key} {opaque}"), (3, f"{key} {'-' * 390} {opaque}"), (4, f"https://h.example {key} {opaque}"), (5, "https://h.example user=bob"), (6, "user=bob password=abcdef")])
    assert out[1] == "" and "opaque" in out[2] and "opaque" not in out[3]
    assert "endpoint" in out[4] and out[5] == "" and "account" in out[6]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_secrets(spark, sf).collect()
    assert len(got) == len(text)
    assert all((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute(text[r.doc_id]) for r in got)
