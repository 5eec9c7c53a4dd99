"""Chroma fingerprints of a media column, and search for recordings that align.

A recording's short-time spectra are folded onto the 12 pitch classes, one row of energies for each
frame. Over the integral image of these rows 16 rectangle filters compare neighbouring areas; each
difference is quantised to two bits in Gray code, and the 16 codes of a frame are one packed 32-bit integer. To align
two recordings, equal runs of RUN integers vote for offsets in a histogram; the offset with the most votes is then
verified by the share of bits that differ over the whole overlap.

Recordings with equal fingerprints go on as one, the smallest id. Near copies are then gathered into classes: in each list
of recordings that share one of their SKETCH runs of the smallest hashes, the recording that stands in most lists is the hub, and members whose
fingerprints differ from a hub's in at most CLASS_ERROR of the bits join its class, in rounds, until one gains less than
a hundredth of what is left; who joins none is a class of its own, which loses no match. So a group of thousands of near copies costs about a comparison for each member and round, and is searched for once. Members of a
class are within MAX_ERROR of each other, as twice CLASS_ERROR is no more. Only representatives are then searched:
votes come from the inverted lists of all runs, and every asking member of a list votes with every other: lists of more than
LONG members (and a thousandth of all rows) are dealt out over several tasks, which changes nothing in what is found. Queries are the classes that hold an id divisible by
QUERY_EVERY. Two rows of different classes can align within MAX_ERROR only if their representatives do within MAX_ERROR +
2 * CLASS_ERROR, so pairs of representatives up to that are returned, with their errors.

Defined cases: null, empty, broken or too short media have no fingerprint, no matches and are a class each;
silence gives zeros; a null id is left out of search but keeps its row; repeated rows
share a class; recordings of any length are read frame by frame in blocks; PCM of 8, 16, 24 and 32 bits and floats of 32
and 64 bits are read, other codings count as broken; a run that a recording repeats votes with its first place; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import erase, join_by_key, join_dealt, rows_of, small_batches, written

FRAME, HOP, RUN, QUERY_EVERY = 1024, 256, 4, 20
MAX_ERROR, CLASS_ERROR, MIN_OVERLAP, MIN_VOTES, LONG, SKETCH = 0.2, 0.1, 32, 2, 64, 16
LOW_HZ, HIGH_HZ = 110.0, 1760.0
#: (shape, first pitch class, pitch classes, frames, thresholds) of the filters.
FILTERS = [(k % 4, (5 * k) % 12, 2 + k % 3 if k % 4 else 3, 4 + 2 * (k % 5), (-0.02, 0.0, 0.02)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
GRAY = np.array([0, 1, 3, 2], np.uint32)
RATE = 4000
#: Bits of a sample by the code of the coding: integers and floats.
SAMPLES = {1: (8, 16, 24, 32), 3: (32, 64)}


def parse_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono) and rate of PCM in a RIFF container; none of media that cannot be read."""
    none = np.zeros(0), RATE
    data = bytes(data or b"")
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, kind, raw = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = (int.from_bytes(body[24:26], "little") if code == 0xFFFE and len(body) >= 26 else code, channels, rate, bits)
        elif name == b"data":
            raw = body
        at += 8 + size + size % 2
    if kind is None or not kind[1] or not kind[2] or kind[3] not in SAMPLES.get(kind[0], ()):
        return none
    code, channels, rate, bits = kind
    width = bits // 8
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if code == 3:
        x = np.nan_to_num(np.frombuffer(raw, f"<f{width}").astype(np.float64))
    elif width == 1:
        x = (np.frombuffer(raw, "u1").astype(np.float64) - 128) / 128
    else:  # left-aligned in 32 bits
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        x = wide.reshape(-1).view("<i4") / 2.0**31
    return x.reshape(-1, channels).mean(1), rate


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def melody(vector, rate: int = RATE, note: int = 512) -> tuple[np.ndarray, int]:
    """A recording from numbers, for tables without media: each number sounds as one of 12 notes, by its size."""
    if vector is None or len(vector) == 0:
        return np.zeros(0), rate
    v = np.nan_to_num(np.asarray(vector, np.float64))
    pitch = np.clip(np.floor(v * 20) + 6, 0, 11)
    t = np.arange(note) / rate
    hz = 220 * 2 ** (pitch / 12)
    tone = np.sin(2 * np.pi * hz[:, None] * t) + 0.4 * np.sin(4 * np.pi * hz[:, None] * t)
    return (tone * 0.5).reshape(-1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energies of the pitch classes, a row for each frame; rows sum to 1, or are zeros in silence."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), np.round(12 * np.log2(hz[used] / 220)).astype(int) % 12] = 1
    window = np.hanning(FRAME)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    rows = [(np.abs(np.fft.rfft(view[a : a + 512] * window)[:, used]) ** 2) @ fold for a in range(0, n, 512)]
    energy = np.concatenate(rows)
    total = energy.sum(1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """The packed integers of a recording."""
    rows = chroma(samples, rate)
    n = len(rows) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(rows) + 1, 25))
    image[1:, 1:] = np.concatenate((rows, rows), 1).cumsum(0).cumsum(1)  # pitch classes go round
    area = lambda t, p, h, w: image[t + w, p + h] - image[t, p + h] - image[t + w, p] + image[t, p]
    t, out = np.arange(n), np.zeros(n, np.uint32)
    for shape, p, h, w, cuts in FILTERS:
        half, third = w // 2, max(1, h // 2)
        if shape == 0:  # earlier against later
            d = area(t, p, h, half) - area(t + half, p, h, half)
        elif shape == 1:  # lower against higher
            d = area(t, p, third, w) - area(t, p + third, third, w)
        elif shape == 2:  # crosswise
            d = area(t, p, third, half) + area(t + half, p + third, third, half) - area(t, p + third, third, half) - area(t + half, p, third, half)
        else:  # the middle against both ends
            d = 2 * area(t + w // 4, p, h, half) - area(t, p, h, w)
        out = (out << np.uint32(2)) | GRAY[np.digitize(d / w, cuts)]
    return out


def fingerprints(df: DataFrame, key: str, media: str, decode: Callable = parse_wav) -> DataFrame:
    """id, n (integers) and fingerprint of every row; decode turns a value of the media column into samples and rate."""
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = [fingerprint(*decode(v)).view(np.int32) for v in b.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in fp]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in fp], pa.int64()), pa.array(prints, pa.binary()), pa.array(fp, pa.list_(pa.int32()))], names=["id", "n", "print", "fingerprint"])

    return small_batches(df).select(F.col(key).alias("id"), F.col(media)).mapInArrow(run, f"id {kind}, n long, print binary, fingerprint array<int>")


def _runs(some: DataFrame) -> DataFrame:
    """(run, id, at): a hash of RUN integers in a row, where it first begins."""
    at = F.sequence(F.lit(1), F.size("fingerprint") - (RUN - 1))
    keys = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("fingerprint", i, RUN)).alias("run"), i.alias("at")))
    flat = some.where(F.size("fingerprint") >= RUN).select("id", F.inline(keys))
    return flat.groupBy("run", "id").agg(F.min("at").alias("at"))


def _sketch(some: DataFrame) -> DataFrame:
    """(run, id, at): of each recording the SKETCH runs of the smallest hashes, with their first places."""
    at = F.sequence(F.lit(1), F.size("fingerprint") - (RUN - 1))
    keys = F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("fingerprint", i, RUN)).alias("run"), i.alias("at"))))
    keyed = some.where(F.size("fingerprint") >= RUN).select("id", keys.alias("keys"))
    new = F.filter("keys", lambda k, i: (i == 0) | (F.get("keys", i - 1)["run"] != k["run"]))
    return keyed.select("id", F.inline(F.slice(new, 1, SKETCH))).select("run", "id", "at")


def _errors(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs (a, b, offset, a written table) with the overlap and the share of bits that differ there."""
    left = prints.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa"))
    right = prints.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb"))
    both = join_dealt(join_dealt(pairs, left, ["a"], ["b"]), right, ["b"], ["a"], pairs)
    skip_a, skip_b = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    both = both.withColumn("overlap", F.least(F.size("fa") - skip_a, F.size("fb") - skip_b)).where(F.col("overlap") > 0)
    differ = F.zip_with(F.slice("fa", skip_a + 1, F.col("overlap")), F.slice("fb", skip_b + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFFFFFF))))
    error = F.aggregate(differ, F.lit(0), lambda acc, x: acc + x) / (F.col("overlap") * 32)
    whole = F.col("overlap") * 10 >= F.greatest(F.size("fa"), F.size("fb")) * 9
    return both.select(*pairs.columns, "overlap", whole.alias("whole"), error.alias("bit_error"))


def _best_offsets(votes: DataFrame) -> DataFrame:
    """(a, b, offset, votes) of the histogram (a, b, offset): the offset with the most votes, of equals that nearest 0."""
    counted = votes.groupBy("a", "b", "offset").agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy("a", "b").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("h"))
    return best.where(F.col("h.votes") >= MIN_VOTES).select("a", "b", "h.offset", "h.votes")


def near_classes(prints: DataFrame, max_error: float = CLASS_ERROR) -> DataFrame:
    """(id, leader, offset, bit_error) of the recordings (id, fingerprint) that join another's class; leaders join none."""
    joined: DataFrame | None = None
    left = prints
    while True:
        runs = written(_sketch(left), "runs")
        lists = written(runs.groupBy("run").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists", runs)
        if lists.isEmpty():
            erase(runs, lists)
            break
        # the same plan at every size; AQE splits the rows of a long list
        members = written(runs.join(lists.hint("merge"), "run"), "members", runs)
        weight = members.groupBy("id").agg(F.count(F.lit(1)).alias("weight"))
        hubs = members.join(weight, "id").groupBy("run").agg(F.max(F.struct("weight", "id", "at")).alias("h"), F.max("size").alias("size"))
        hubs = written(hubs.select("run", F.col("h.id").alias("b"), F.col("h.weight").alias("rank"), F.col("h.at").alias("at_b"), "size"), "hubs", members)
        met = join_by_key(members.drop("size"), hubs, ["run"], "size", rows_of(members), "inner").where(F.col("id") != F.col("b"))
        pairs = written(_best_offsets(met.select(F.col("id").alias("a"), "b", (F.col("at_b") - F.col("at")).alias("offset"))), "pairs", members)
        near = _errors(pairs, left).where(F.col("whole") & (F.col("bit_error") <= max_error)).select("a", "b", "offset", "bit_error")
        # a recording joins only one that stands before it in the order (weight, id), the first of the nearest
        order = F.struct("weight", "id")
        ranks = weight.select("id", order.alias("rank"))
        near = near.join(ranks.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranks.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b")
        near = near.where(F.col("rank_b") > F.col("rank_a"))
        if joined is not None:  # a leader stays one, so each round adds members
            near = near.join(joined.select(F.col("leader").alias("a")), "a", "left_anti")
        near = near.groupBy("a").agg(F.min(F.struct("bit_error", "b", "offset")).alias("n"))
        near = written(near.select(F.col("a").alias("id"), F.col("n.b").alias("leader"), F.col("n.offset").alias("offset"), F.col("n.bit_error").alias("bit_error")), "near", pairs)
        # whose hub joins another itself waits for the next round
        now = written(near.join(near.select(F.col("id").alias("leader")), "leader", "left_anti").select("id", "leader", "offset", "bit_error"), "joined", near)
        erase(runs, lists, members, hubs, pairs, near)
        if now.isEmpty():
            break
        joined = now if joined is None else written(joined.unionByName(now), "joined")
        if rows_of(now) * 100 < rows_of(left):
            break
        left = written(prints.join(joined, "id", "left_anti"), "left")
    return joined if joined is not None else prints.select("id", F.col("id").alias("leader"), F.lit(0).alias("offset"), F.lit(0.0).alias("bit_error")).limit(0)


def align(prints: DataFrame, asks: DataFrame, max_error: float = MAX_ERROR, long: int = LONG) -> DataFrame:
    """(a, b, offset, votes, bit_error): the pairs of an asking recording and another that align; asks has the ids that ask.

    Lists of more than long members are dealt out; the pairs are the same whatever long is.
    """
    runs = written(_runs(prints), "runs")
    left = written(runs.join(asks, "id", "left_semi").select("run", F.col("id").alias("a"), F.col("at").alias("at_a")), "asking", runs)
    right = runs.select("run", F.col("id").alias("b"), F.col("at").alias("at_b"))
    votes = join_dealt(right, left, ["run"], ["b"], runs, least=long).where(F.col("a") != F.col("b")).select("a", "b", (F.col("at_b") - F.col("at_a")).alias("offset"))
    pairs = written(_best_offsets(votes), "pairs")
    erase(runs, left)
    return _errors(pairs, prints).where((F.col("overlap") >= MIN_OVERLAP) & (F.col("bit_error") <= max_error)).select(*pairs.columns, "bit_error")


def search(df: DataFrame, key: str, media: str, decode: Callable = parse_wav, every: int = QUERY_EVERY, max_error: float = MAX_ERROR, class_error: float = CLASS_ERROR, long: int = LONG) -> DataFrame:
    """key, n_frames, class_id, match_id, offset, votes and bit_error: membership of every row, then the pairs of classes.

    Each row of df has a row with its class (the id of its representative) and the offset and error towards that; match_id is null.
    Each class that holds an id which every divides has a row of its representative for each representative that aligns
    with it (match_id): frame t of the one sounds like frame t + offset of the other.
    """
    prints = written(fingerprints(df, key, media, decode), "prints")
    named = prints.where(F.col("print").isNotNull() & F.col("id").isNotNull())
    same = named.groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max("fingerprint").alias("fingerprint"), F.max(F.col("id") % every == 0).alias("asks"))
    same = written(same, "same")
    near = near_classes(same.select("id", "fingerprint"), class_error)
    placed = same.drop("fingerprint").join(near, "id", "left")
    placed = placed.select("print", "id", "rows", "n", "asks", F.coalesce("leader", "id").alias("class_id"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("bit_error", F.lit(0.0)).alias("bit_error"))
    placed = written(placed, "placed")
    leaders = same.join(placed.where("id = class_id").select("id"), "id", "left_semi").select("id", "fingerprint")
    asks = placed.where("asks").select(F.col("class_id").alias("id")).distinct()
    pairs = align(leaders, asks, max_error + 2 * class_error, long)
    matches = pairs.join(placed.where("id = class_id").select(F.col("id").alias("a"), "n"), "a").select(F.col("a").alias("id"), "n", F.col("a").alias("class_id"), F.col("b").alias("match_id"), "offset", "votes", "bit_error")
    total = same.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = join_by_key(named.select("id", "n", "print"), placed.select("print", "class_id", "rows", "offset", "bit_error"), ["print"], "rows", total)
    members = joined.select("id", "n", "class_id", "offset", "bit_error")
    alone = prints.where(F.col("print").isNull() | F.col("id").isNull()).select("id", "n", F.col("id").alias("class_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("double").alias("bit_error"))
    out = members.unionByName(alone).unionByName(matches, allowMissingColumns=True)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_frames"), "class_id", "match_id", "offset", "votes", "bit_error")
