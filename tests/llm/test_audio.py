import struct

import numpy as np

from seqspark.llm import audio, queries

SCHEMA = "vec_id long, media binary, id int, n string, fingerprint string"


def tune(seed, notes=80):
    return audio.melody(np.random.default_rng(seed).normal(0, 0.25, notes))[0]


def brute(a, b):
    """The least share of differing bits over all offsets with enough overlap."""
    best = (1.0, 0)
    for o in range(-len(a), len(b)):
        x, y = a[max(0, -o) :], b[max(0, o) :]
        n = min(len(x), len(y))
        if n >= audio.MIN_OVERLAP:
            best = min(best, (int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n), o))
    return best


def test_integral_image_filters_against_sums():
    x = tune(1)
    rows = audio.chroma(x, audio.RATE)
    assert np.allclose(rows.sum(1), 1)
    wide = np.concatenate((rows, rows), 1)
    fp = audio.fingerprint(x, audio.RATE)
    shape, p, h, w, cuts = audio.FILTERS[0]
    for t in (0, 7, len(fp) - 1):
        d = wide[t : t + w // 2, p : p + h].sum() - wide[t + w // 2 : t + 2 * (w // 2), p : p + h].sum()
        assert int(fp[t] >> np.uint32(30)) == int(audio.GRAY[np.digitize(d / w, cuts)])


def packed(x, width, code=1):
    """A RIFF file of samples in another coding, two channels."""
    stereo = np.repeat(np.clip(x, -1, 1), 2)
    if code == 3:
        raw = stereo.astype(f"<f{width}").tobytes()
    else:
        raw = (stereo * (2 ** (8 * width - 1) - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    head = struct.pack("<HHIIHH", code, 2, audio.RATE, audio.RATE * 2 * width, 2 * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw)) + raw


def test_codings_of_samples():
    x = tune(9)[:5000]
    for width, code in ((2, 1), (3, 1), (4, 1), (4, 3), (8, 3)):
        got, rate = audio.parse_wav(packed(x, width, code))
        assert rate == audio.RATE and np.allclose(got, np.clip(x, -1, 1), atol=1e-3), (width, code)
    for bad in (None, b"", b"RIFF", audio.wav(x)[:30], packed(x, 2, 7)):
        assert len(audio.parse_wav(bad)[0]) == 0


def results(df):
    rows = df.collect()
    return [r for r in rows if r.match_id is None], {(r.class_id, r.match_id): r for r in rows if r.match_id is not None}


def test_search_finds_shifted_noisy_and_equal_recordings(spark):
    rng = np.random.default_rng(0)
    a = tune(3)
    rows = [(20, a), (21, a[8 * audio.HOP :]), (22, a + rng.normal(0, 0.02, len(a))), (40, tune(4)), (41, tune(5)), (43, a), (60, np.zeros(20000)), (61, np.zeros(20000))]
    media = [(i, bytearray(audio.wav(x))) for i, x in rows] + [(80, None), (81, bytearray(b"")), (82, bytearray(b"junk")), (None, bytearray(audio.wav(a))), (43, bytearray(audio.wav(a)))]
    df = spark.createDataFrame([(i, m, 1, "n", "f") for i, m in media], SCHEMA)
    members, pairs = results(audio.search(df, "vec_id", "media"))
    assert len(members) == len(media) and audio.search(df.limit(0), "vec_id", "media").count() == 0
    by = {r.vec_id: r for r in members}
    assert by[43].class_id == by[20].class_id and by[80].class_id == 80 and by[None].class_id is None and by[61].class_id == 60
    # shifted and noisy copies are of one class, at their places in it
    assert len({by[i].class_id for i in (20, 21, 22, 43)}) == 1 and not pairs
    assert by[20].offset - by[21].offset == -8 and by[22].offset == by[20].offset and max(by[i].bit_error for i in (20, 21, 22)) < 0.1


def test_near_copies_become_classes(spark):
    """Groups larger than a list may be, of noisy copies: members are near their leader, and links within MAX_ERROR are kept."""
    rng = np.random.default_rng(5)
    base = [rng.normal(0, 0.25, 64) for _ in range(4)]
    rows = [(100 * g + j, np.where(rng.random(64) < rng.choice([0, 0.03, 0.08]), rng.normal(0, 0.25, 64), v).tolist()) for g, v in enumerate(base) for j in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    members, pairs = results(audio.search(df, "vec_id", "embedding", audio.melody, long=5))
    prints = {i: audio.fingerprint(*audio.melody(v)) for i, v in rows}
    error = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum() / (32 * len(prints[i]))
    leader = {r.vec_id: r.class_id for r in members}
    assert len(leader) == len(rows) and all(leader[c] == c for c in leader.values())
    for r in members:
        assert r.offset == 0 and abs(error(r.vec_id, r.class_id) - r.bit_error) < 1e-9 and r.bit_error <= audio.CLASS_ERROR
    assert len(set(leader.values())) < 60
    want = [(i, j) for i in leader for j in leader if i % 20 == 0 and i != j and error(i, j) <= audio.MAX_ERROR]
    kept = sum(leader[i] == leader[j] or (leader[i], leader[j]) in pairs for i, j in want)
    assert len(want) > 100 and kept >= 0.95 * len(want), (kept, len(want))


def test_long_lists_lose_no_pair(spark):
    """Recordings that share one passage, shorter than 16 integers or at the end: each asking one meets all others, whatever long is."""
    rng = np.random.default_rng(7)
    passage, place, rows = rng.integers(-(2**31), 2**31, 8), {}, []
    for i in range(30):
        fp = rng.integers(-(2**31), 2**31, 60)
        place[i] = 52 if i == 29 else int(rng.integers(24, 50))
        fp[place[i] : place[i] + 8] = passage
        rows.append((i, fp.tolist()))
    prints = spark.createDataFrame(rows, "id long, fingerprint array<int>")
    asks = prints.where("id % 20 = 0").select("id")
    want = {(a, b, place[b] - place[a], 5) for a in (0, 20) for b in range(30) if a != b}
    for long in (5, audio.LONG):
        assert {(r.a, r.b, r.offset, r.votes) for r in audio.align(prints, asks, 1.0, long).collect()} == want, long


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    prints = {r.id: np.array(r.fingerprint, np.int32).view(np.uint32) for r in audio.fingerprints(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", audio.melody).collect()}
    members, pairs = results(queries.op10_audio(spark, sf))
    leader = {r.vec_id: r.class_id for r in members}
    want = hit = 0
    for q in (i for i in prints if i % 20 == 0):
        for i, fp in prints.items():
            if i != q and brute(prints[q], fp)[0] <= audio.MAX_ERROR:
                want += 1
                hit += leader[q] == leader[i] or (leader[q], leader[i]) in pairs
    assert hit >= 0.9 * want, (hit, want)
    # random recordings seldom align, so noisy copies are planted for a figure that means something
    rng = np.random.default_rng(2)
    base = [rng.normal(0, 0.25, 64) for _ in range(40)]
    rows = [(20 * i, v.tolist()) for i, v in enumerate(base)] + [(20 * i + 1, np.where(rng.random(64) < 0.06, rng.normal(0, 0.25, 64), v).tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fps = {r.id: np.array(r.fingerprint, np.int32).view(np.uint32) for r in audio.fingerprints(df, "vec_id", "embedding", audio.melody).collect()}
    members, pairs = results(audio.search(df, "vec_id", "embedding", audio.melody))
    leader = {r.vec_id: r.class_id for r in members}
    want = [i for i in range(40) if brute(fps[20 * i], fps[20 * i + 1])[0] <= audio.MAX_ERROR]
    linked = [leader[20 * i] == leader[20 * i + 1] or (leader[20 * i], leader[20 * i + 1]) in pairs for i in want]
    assert len(want) > 10 and sum(linked) >= 0.9 * len(want)
