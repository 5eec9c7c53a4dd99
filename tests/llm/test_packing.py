import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from seqspark.llm import packing, queries

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, shard int, length int, offset string"


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_word_ids_equal_the_library():
    t, rng = library(), random.Random(2)
    pool = ["Hello", "world.", "x,", "don't", "é", "É", "é", "́", " ", "\x1c", "\x85", "\n", "  ", "ΑΣ.", "İ", "12", "...", "<|endoftext|>", "日本,", "ß.", "'s", "ö.", "\t"]
    texts = ["", " ", "a.b,c"] + [rng.choice(["", " "]).join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(2000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.word_ids(PATH).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for window in (8, 16, 100, 2048):
        lengths = sorted((rng.randint(1, window) for _ in range(400)), reverse=True)
        bins, offsets = packing.best_fit_decreasing(lengths, window)
        room: list[int] = []
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            fits = [r for r in room if r >= n]
            if fits:
                assert room[b] == min(fits) and o == window - room[b]
                room[b] -= n
            else:
                assert b == len(room) and o == 0
                room.append(window - n)


def check(docs, out):
    t = library()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, parts in by_doc.items():
        n = len([d for d in docs if d[0] == i])
        assert sum(x for _, x in parts) == n * len(ids[i])
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    return {i for i, _ in docs} == set(by_doc), sum(x for p in by_seq.values() for _, x in p) / (2048 * len(by_seq))


def test_frames(spark):
    docs = [(1, None), (2, ""), (3, "one two three."), (3, "one two three."), (None, "x"), (4, "word " * 9000), (5, "Y " * 2047)]
    df = spark.createDataFrame([(i, x, 1, 2, "o") for i, x in docs], SCHEMA)
    ok, _ = check(docs, packing.pack_documents(df, PATH).collect())
    assert ok and packing.pack_documents(df.limit(0), PATH).count() == 0


def test_query_has_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ok, fill = check(docs, queries.op7_packing(spark, sf).collect())
    assert ok and fill > 0.99, fill
