"""Packing of tokenised documents into windows by best-fit decreasing.

Documents are tokenised by a public tokenizer file; word ids are cached, as the tokenizer drops white
space and never joins text across it. An end id follows each document. A document longer than a window
is first cut into full windows; the rest goes, longest first, into the open window with the least
capacity that still fits, which a segment tree indexed by remaining capacity finds in log2(window) steps.

The pieces (a few numbers each, no ids) are dealt out by a hash into shards of about SHARD_PIECES and
each shard is packed alone, so tasks stay bounded and even at any input size; a shard adds at most the
padding of its last windows. Within a shard the order is total (length, id, start, crc), so a repeated
task gives the same windows.

Defined cases: a null or empty text is the end id alone; a document of any length is cut, never dropped;
repeated rows and ids are packed as often as they come; a null id ranks before others; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, text_of, written

WINDOW, END_ID, SHARD_PIECES = 2048, 1, 20_000
#: Words whose ids a worker holds, and bytes of text that it takes at once: they bound its memory.
CACHED, CHUNK, TOGETHER = 400_000, 1 << 21, 500
SIGNS = string.punctuation


class WordIds:
    """Ids (as little-endian bytes) of words between blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of_letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, many at once: each is one piece, whose last token is marked as such."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):  # letters that only one of the two libraries knows
                out += self._ids(some)
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of these distinct words."""
        known = self.cache
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED:
            known = self.cache = {"": b""}
            new = words
        # a word of letters and signs of ASCII behind them is two pieces for the tokenizer, whatever the word
        ended, plain = [], set()
        for w in new:
            stem = w.rstrip(SIGNS)
            if stem and stem != w and stem.isalpha():
                ended.append((w, stem, w[len(stem) :]))
            else:
                plain.add(w)
        plain.update(x for _, stem, tail in ended for x in (stem, tail) if x not in known)
        letters = [w for w in plain if w.isalpha() and "\u0130" not in w]  # that one becomes two pieces in small letters
        others = list(plain.difference(letters))
        known.update(zip(letters, self._ids_of_letters(letters), strict=True))
        known.update(zip(others, self._ids(others), strict=True))
        for w, stem, tail in ended:
            known[w] = known[stem] + known[tail]
        return list(map(known.__getitem__, words))

    def encode(self, texts):
        """The ids of each text of a list or an Arrow array without nulls, as bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        first = 0
        while first < len(texts):
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + CHUNK)))
            some = texts.slice(first, last - first)
            # letters of ASCII are lowered here so that fewer words differ; the tokenizer lowers the others
            split = pc.split_pattern(pc.replace_substring(pc.ascii_lower(some), "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            ids = pa.array(self.learn(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
            cuts = ends[np.asarray(split.offsets)].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for i in range(len(some)):
                yield data[cuts[i] : cuts[i + 1]]
            first = last


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document's full windows and rest: key, start, length, ids_crc32, doc_tokens."""
    import pyarrow as pa

    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = word_ids(tokenizer_path)
        for b in batches:
            which, cols = [], ([], [], [], [])
            for i, ids in enumerate(coder.encode(b.column(1))):
                total = len(ids) // 4 + 1
                for at in range(0, total, window):
                    part = ids[4 * at : 4 * (at + window)]
                    crc, last = zlib.crc32(part), at + window >= total
                    which.append(i)
                    for c, v in zip(cols, (at, len(part) // 4 + last, zlib.crc32(end, crc) if last else crc, total), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(key, text_of(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class Capacities:
    """A segment tree over capacities 0 to a power of two less 1; a node counts the open windows under it."""

    def __init__(self, window: int):
        self.size = 1 << (window - 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, item: int) -> None:
        self.open[capacity].append(item)
        n = capacity + self.size
        while n:
            self.tree[n] += 1
            n >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Takes out an open window of the smallest capacity that is not under least; (capacity, window)."""
        tree = self.tree
        n = least + self.size
        if not tree[n]:
            while n > 1 and (n & 1 or not tree[n + 1]):  # up, until a right neighbour has windows
                n >>= 1
            if n <= 1:
                return None
            n += 1
            while n < self.size:
                n = 2 * n if tree[2 * n] else 2 * n + 1
        capacity = n - self.size
        while n:
            tree[n] -= 1
            n >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths come longest first and are at most the window."""
    tree = Capacities(window)
    bins, offsets, n = [], [], 0
    for length in lengths:
        if length == window or (found := tree.take(length)) is None:
            b, room, n = n, window, n + 1
        else:
            room, b = found
        bins.append(b)
        offsets.append(window - room)
        if length < room:
            tree.add(room - length, b)
    return bins, offsets


def pack(cut: DataFrame, key: str = "doc_id", window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. cut is read twice, so it should be a written table."""
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), key, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first", kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = (pdf["shard"].to_numpy(np.int64) << 32) + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return pdf.drop(columns="shard")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.groupBy("shard").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    return pack(written(pieces(docs, tokenizer_path, key, text, window), "pieces"), key, window)
