"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their prefixes of 4 to 6 letters (so inflected forms share one), hashed
into 2**20 buckets. Spark counts on how many texts of the fitting sample, of either class, each bucket occurs, and of
those that LEAST texts have the N_TERMS buckets of the largest chi-square become the inputs, 1 if a text has the term; both
are sizes of the model, like FACTORS. The machine adds to the linear weights
the products of latent vectors of all pairs of present terms, in time linear in the terms, so that an insult
together with a group mention may weigh more than both alone. It is fitted by Adam on the driver
from at most SAMPLE labelled documents, a bound that also limits what is collected; scoring reads every term of every text.

Defined cases: null and empty texts have no terms and get the score of the bias; texts of any length are
read whole; repeated rows get equal scores; where no label or only one class can be used the score is the
smoothed share of the label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out, training_rows
from ._shared import small_batches, text_of

SAMPLE, N_TERMS, LEAST, FACTORS, BUCKETS = 10_000, 3000, 3, 8, 1 << 20
CACHED = 200_000
#: Rows whose texts and terms a worker holds at once.
SLICE = 500
EDGE = ".,;:!?\"'()[]{}*#%&$<>|-_/\\«»„“”"


def terms(word: str) -> set[int]:
    """The buckets of a word and its prefixes."""
    w = word.lower().strip(EDGE)
    return {zlib.crc32(t.encode()) & BUCKETS - 1 for t in ("w" + w, *(f"p{w[:n]}" for n in (4, 5, 6) if len(w) >= n))} if w else set()


class Terms(dict):
    """The inputs that a word sets; chosen: bucket to input."""

    def __init__(self, chosen: dict[int, int] | None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        found = terms(word)
        out = tuple(found) if self.chosen is None else tuple(self.chosen[t] for t in found if t in self.chosen)
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(text.split()))))


class Machine:
    """sigmoid(bias + sum of weights + sum over pairs of inner products) of the present terms."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = np.zeros(1), np.zeros(n), rng.normal(0, 0.02, (n, factors))

    def logits(self, rows: list) -> np.ndarray:
        out = np.full(len(rows), self.b[0])
        sizes = np.array([len(x) for x in rows], np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            x = np.concatenate([np.asarray(rows[i], np.int64) for i in full])
            at = np.cumsum(sizes[full]) - sizes[full]
            s = np.add.reduceat(self.v[x], at, axis=0)
            own = (self.v**2).sum(1)
            out[full] += np.add.reduceat(self.w[x], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat(own[x], at))
        return out

    def scores(self, rows: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 3) -> Machine:
        rng = np.random.default_rng(seed)
        params = [self.b, self.w, self.v]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, n = 0, len(self.w)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                x = np.zeros((len(take), n), np.float32)
                for i, r in enumerate(take):
                    x[i, rows[r]] = 1
                s = x @ self.v
                z = self.b[0] + x @ self.w + 0.5 * ((s * s).sum(1) - x @ (self.v**2).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
                gw = x.T @ g
                gv = x.T @ (g[:, None] * s) - gw[:, None] * self.v
                step += 1
                for p, a, c, grad in zip(params, m1, m2, (np.array([g.sum()]), gw + decay * self.w, gv + decay * self.v), strict=True):
                    a += 0.1 * (grad - a)
                    c += 0.001 * (grad * grad - c)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, n_terms: int = N_TERMS) -> tuple[dict[int, int], Machine]:
    """The chosen buckets with their inputs, and the fitted machine."""
    import pyarrow as pa

    rows = training_rows(docs, labels, label, sample, key, text)

    def featurise(chosen):
        def run(batches):
            t = Terms(chosen)
            for b in batches:
                xs = pa.array([t.of(x) for x in b.column(0).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([xs, b.column(1)], names=["terms", "y"])

        return rows.select("text", "y").mapInArrow(run, "terms array<int>, y int")

    size = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        m = Machine(0)
        m.b[0] = np.log((n1 + 0.5) / (n0 + 1.5))
        return {}, m
    counts = featurise(None).select(F.explode("terms").alias("t"), "y").groupBy("t").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    a, n, whole = F.col("a").cast("double"), F.col("n").cast("double"), float(n1 + n0)
    det = a * whole - n * n1
    chi = det * det / (n * (whole - n + 1e-9) * float(n1) * float(n0))
    best = counts.where(F.col("n") >= LEAST).orderBy(chi.desc(), "t").limit(n_terms).select("t").collect()
    chosen = {r.t: i for i, r in enumerate(best)}
    data = featurise(chosen).toPandas()
    order = sorted(range(len(data)), key=lambda i: (data["y"].iat[i], tuple(data["terms"].iat[i])))  # whatever order the tasks end in
    xs = [np.asarray(data["terms"].iat[i], np.int64) for i in order]
    y = data["y"].to_numpy(np.float64)[order]
    return chosen, Machine(len(chosen)).fit(xs, y)


def score(docs: DataFrame, model: tuple[dict[int, int], Machine], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row; the model (N_TERMS rows of FACTORS numbers) goes along with the function."""
    import pyarrow as pa

    chosen, machine = model

    def run(batches):
        t = Terms(chosen)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                some = b.slice(at, SLICE)
                s = machine.scores([t.of(x) for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(key, text_of(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: key, held_out, score and predicted."""
    out = score(docs, train(docs, labels, label, key, text), key, text)
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
