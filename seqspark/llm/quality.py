"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, its lines, of which long ones are cut every PASSAGE_WORDS words. Each
passage is described by shape (capitals, digits, symbols, repeats, word lengths and the like), encoded by
a dense layer, and weighted by gated attention; the weighted mean of the encodings is scored by a
logistic unit. Only documents have labels, so the attention learns which passages decide. Fitting runs on the
driver over all passages of at most SAMPLE labelled documents, FIT_BATCH documents a step; scoring reads all passages of whole
texts, some texts at a time: a worker holds the features of about a megabyte of text, or of one longer text.

Defined cases: a null, empty or blank text is one passage without words; repeated rows get equal scores;
where no label or only one class can be used the score is the smoothed share of the label; an empty table
gives an empty result; score() keeps other columns, and where one is called score its own gets underscores in
front (see added()); classify() does not read them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out, training_rows
from ._shared import fresh, small_batches, text_of
from ._vector import Words, chunks

SAMPLE, FIT_BATCH, PASSAGE_WORDS = 6000, 512, 60
WIDTH, GATE = 16, 8
N_FEATURES = 16

_KIND = np.zeros(256, np.int64)  # 0 other, 1 capital, 2 small or beyond ASCII, 3 digit, 4 sentence mark, 5 shout, 6 bar, 7 symbol
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[ord("|")] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7


def passages(texts: list[bytes], words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text."""
    w = Words(texts, lower=False)
    n = len(w.begin)
    feeds = np.cumsum(w.raw == 10)
    line = feeds[w.begin] if n else np.zeros(0, np.int64)  # a text's end is a line feed too
    fresh = np.concatenate(([True], line[1:] != line[:-1])) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    fresh = fresh | ((np.arange(n) - first) % words == 0)
    at = np.flatnonzero(fresh)
    which = np.cumsum(fresh) - 1
    count = np.diff(np.append(at, n))
    m = len(at)
    x = np.zeros((m, N_FEATURES))
    if m:
        prefix = np.zeros((8, len(w.raw) + 1), np.int32)
        kinds = _KIND[w.raw]
        for k in range(1, 8):
            np.cumsum(kinds == k, out=prefix[k, 1:])
        begin, end = w.begin[at], w.end[np.append(at[1:], n) - 1]
        by = (prefix[:, end] - prefix[:, begin]).astype(float)
        size = np.maximum(end - begin, 1)
        letters = np.maximum(by[1] + by[2], 1)
        long = (w.end - w.begin).astype(float)
        again = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & ~fresh[1:]))
        add = lambda v: np.add.reduceat(v.astype(float), at)
        pair = np.lexsort((w.hash, which))
        new = np.ones(n, bool)
        new[1:] = (w.hash[pair][1:] != w.hash[pair][:-1]) | (which[pair][1:] != which[pair][:-1])
        distinct = add(new)
        own = np.lexsort((w.hash, w.doc))  # words that are new in their text
        seen = np.ones(n, bool)
        seen[own[1:]] = (w.hash[own][1:] != w.hash[own][:-1]) | (w.doc[own][1:] != w.doc[own][:-1])
        share = np.bincount(w.doc, seen, len(texts)) / np.maximum(np.bincount(w.doc, minlength=len(texts)), 1)
        last = kinds[w.end - 1]
        cols = (
            np.log1p(count), by[1] / letters, by[3] / size, by[7] / size, by[5] / size, by[6] / size, by[4] / size, distinct / count,
            add(long) / count / 10, add(long > 18) / count, add(again) / count, add(long <= 3) / count, add((last == 5) | (last == 7)) / count,
            share[w.doc[at]], add(kinds[w.begin] == 1) / count, np.log1p(np.bincount(w.doc, minlength=len(texts)))[w.doc[at]] / 5,
        )
        x[:] = np.stack(cols, 1)
    per = np.bincount(w.doc[at], minlength=len(texts)) if m else np.zeros(len(texts), np.int64)
    if (per == 0).any():  # a text without words has one passage of zeros
        put = np.repeat(np.cumsum(per) - per, per == 0)
        x = np.insert(x, put, 0.0, axis=0)
        per = np.maximum(per, 1)
    return x, per


class Model:
    """Encoder, gated attention and logistic unit, with the scale of the features."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"W": g(N_FEATURES, WIDTH), "b": np.zeros(WIDTH), "V": g(WIDTH, GATE), "U": g(WIDTH, GATE), "a": g(GATE, 1)[:, 0], "o": g(WIDTH, 1)[:, 0], "c": np.zeros(1)}

    def _forward(self, x: np.ndarray, at: np.ndarray, doc: np.ndarray) -> dict:
        p = self.p
        f = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(f @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp(np.clip((t * s) @ p["a"], -30, 30))  # bounded, so no maximum need be taken out
        w = e / np.add.reduceat(e, at)[doc]
        z = np.add.reduceat(w[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"][0], -30, 30)))
        return {"f": f, "h": h, "t": t, "s": s, "w": w, "z": z, "y": y}

    def scores(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        at = np.cumsum(per) - per
        return self._forward(x, at, np.repeat(np.arange(len(per)), per))["y"]

    def gradient(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """The derivatives of the weighted cross-entropy of these documents by each parameter."""
        at, doc, p = np.cumsum(per) - per, np.repeat(np.arange(len(per)), per), self.p
        r = self._forward(x, at, doc)
        d = (r["y"] - y) * weight
        g = {"c": np.array([d.sum()]), "o": r["z"].T @ d}
        dz = d[:, None] * p["o"]
        dh = r["w"][:, None] * dz[doc]
        dw = (r["h"] * dz[doc]).sum(1)
        da = r["w"] * (dw - np.add.reduceat(r["w"] * dw, at)[doc])
        g["a"] = (r["t"] * r["s"]).T @ da
        dt, ds = da[:, None] * p["a"] * r["s"] * (1 - r["t"] ** 2), da[:, None] * p["a"] * r["t"] * r["s"] * (1 - r["s"])
        g["V"], g["U"] = r["h"].T @ dt, r["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - r["h"] ** 2
        g["W"], g["b"] = r["f"].T @ dh, dh.sum(0)
        return g

    def fit(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, batch: int = FIT_BATCH, seed: int = 11) -> Model:
        """Adam over batches of documents, drawn anew in each pass; the rate falls to a tenth."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        at, p, rng = np.cumsum(per) - per, self.p, np.random.default_rng(seed)
        share = np.clip(y.mean(), 0.05, 0.95)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(y))
            take, order = np.sort(order[:batch]), order[batch:]
            rows = np.repeat(at[take] - np.cumsum(per[take]) + per[take], per[take]) + np.arange(per[take].sum())
            g = self.gradient(x[rows], per[take], y[take], weight[take] / len(take))
            now = rate * (1 - 0.9 * step / steps)
            for k in p:
                grad = g[k] + decay * p[k]
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad * grad - m2[k])
                p[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    import pyarrow as pa

    rows = training_rows(docs, labels, label, sample, key, text)

    def featurise(batches):
        for b in batches:
            out = []
            for some in chunks(b.column(0)):
                x, per = passages(some)
                out += [part.astype(np.float32).tobytes() for part in np.split(x, np.cumsum(per)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary())], names=["k", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    data = small_batches(rows).select("text", key, "y").mapInArrow(featurise, f"k {kind}, y int, x binary").toPandas()
    data = data.sort_values(["k", "x"], kind="stable")  # whatever order the tasks end in
    y = data["y"].to_numpy(np.float64)
    model = Model()
    if len(set(y)) < 2:
        model.p["o"][:] = 0
        model.p["c"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return model
    parts = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in data["x"]]
    return model.fit(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), y)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column score; the model is a few hundred numbers and goes along with the function."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import DoubleType, StructField, StructType

    name = added(docs)
    col = docs.columns.index(text)

    def run(batches):
        for b in batches:
            s = np.concatenate([np.zeros(0)] + [model.scores(*passages(some)) for some in chunks(pc.fill_null(b.column(col), ""))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def added(docs: DataFrame) -> str:
    """The name of the column that score() adds to docs."""
    return fresh(docs, "score")[0]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: key, held_out, score and predicted."""
    rows = docs.select(key, text_of(text).alias("text"))
    out = score(rows, train(docs, labels, label, key, text))
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
