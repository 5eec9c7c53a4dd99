import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from seqspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    pool = ["a", "B", "é", "1", "٣", "²", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'ll", "'re", "'v", "'T", "!", "’", "日本", "ß", "\x00", "​", "́", "\U0001f600", "the", "don't", "\r\n"]
    out = ["", " ", "\n", "  x", "x  ", "''s", " 's", "\n's", "a's'll've", "x" * 5000, "!" * 3000, " \n \t x", "I'm he'd 'tis l'lle 'r 've'"]
    return out + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]


def test_same_ids_as_the_library(tik):
    r, ts = bpe.ranks(PATH), texts()
    for t, ids in zip(ts, r.encode(ts), strict=True):
        assert ids.tolist() == tik.encode_ordinary(t), repr(t)
        assert r.decode(ids.tolist()) == t.encode()


def test_classes_agree_with_the_library_for_every_code_point(tik):
    r = bpe.ranks(PATH)
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ts = ["".join(f"a{chr(c)}1 {chr(c)}!{chr(c)}" for c in cps[i : i + 997]) for i in range(0, len(cps), 997)]
    bad = [i for i, (t, ids) in enumerate(zip(ts, r.encode(ts), strict=True)) if ids.tolist() != tik.encode_ordinary(t)]
    assert not bad


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "it's ok", None), (2, "it's ok", "z")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [bytes(x.decoded) for x in out] == [b"", b"", b"it's ok", b"it's ok"]
    assert [x.offsets for x in out][2] == [0, 2, 4]
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0
    d = bpe.round_trip_digests(df, PATH).collect()
    assert [x.n_tokens for x in d] == [0, 0, 3, 3] and d[2].ids_sha256 == d[3].ids_sha256
