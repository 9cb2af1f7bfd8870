"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the lower-cased text with every character that is no letter as a space; all n-grams of 1 to 3 characters, hashed
into 2^15 columns; 1 + log(count) times idf, scaled to length 1. The idf comes from all training rows. The regression is
trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled rows
(``sample_rows``, spread evenly over the languages, chosen by a hash of the id), of which every fifth row of each language is kept aside for
the temperature that calibrates the scores; a language's only row is fitted.

Texts of any length are read whole, in slices that overlap by two characters. Cases: a null text, and one without letters,
is ``und`` with score 0; null labels take no part in training; a table without labelled training rows predicts ``und``;
with one language every text with letters gets it, with score 1; repeated rows get the same prediction; empty tables give
no rows; only id, text and label are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
DIM = 1 << BITS
_SLICE = 1 << 20
_BLOCK = 128
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    if not text:
        return None
    letter, total, any_letter = _letter_table(), None, False
    for at in range(0, len(text), _SLICE):
        part = text[max(0, at - 2) : at + _SLICE].lower()
        fresh = min(at, 2)  # characters that only give context
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letter[c]
        any_letter = any_letter or bool(is_letter[fresh:].any())
        c = np.where(is_letter, c, np.uint32(32))
        shift = np.uint32(32 - BITS)
        one = c * _FACTORS[0]
        h = [(one ^ (one >> np.uint32(13))) * _FACTORS[1] >> shift]
        if len(c) > 1:
            two = (one[:-1] ^ (c[1:] * _FACTORS[1])) * _FACTORS[2]
            h.append((two ^ (two >> np.uint32(15))) * _FACTORS[0] >> shift)
        if len(c) > 2:
            three = (two[:-1] ^ (c[2:] * _FACTORS[2])) * _FACTORS[1]
            h.append((three ^ (three >> np.uint32(14))) * _FACTORS[2] >> shift)
        if fresh:  # n-grams that end inside the context belong to the slice before
            h = [x[max(0, fresh - n) :] for n, x in enumerate(h)]
        counts = np.bincount(np.concatenate(h), minlength=DIM)
        total = counts if total is None else total + counts
    return total if any_letter else None


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


def _blocks(total: np.ndarray, extra: int) -> pa.RecordBatch:
    parts = list(total.reshape(-1, _BLOCK))
    names = np.arange(len(parts) + 1, dtype=np.int32) - 1
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([np.array([extra], dtype=np.int64), *parts], pa.list_(pa.int64()))], ["block", "n"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of (text): in how many each column occurs, and how many have letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = ngram_counts(t.as_py())
                if c is not None:
                    total += c > 0
                    n += 1
        yield _blocks(total, n)

    def add(t: pa.Table) -> pa.Table:
        lists = t.column("n").combine_chunks()
        width = len(lists[0])
        total = lists.flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"block": t.column("block")[:1], "n": pa.array([total], pa.list_(pa.int64()))})

    got = texts.mapInArrow(count, "block int, n array<bigint>").groupBy("block").applyInArrow(add, "block int, n array<bigint>").collect()
    parts = {r["block"]: np.array(r["n"], dtype=np.int64) for r in got}
    n = int(parts.pop(-1, np.zeros(1, np.int64))[0])
    return np.concatenate([parts.get(i, np.zeros(_BLOCK, np.int64)) for i in range(DIM // _BLOCK)]), n


class Ftrl:
    """Follow-the-regularised-leader, proximal, for a softmax over sparse rows."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 0.5, l1: float = 2e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(u: float) -> float:
        s = logits / np.exp(u)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])) + 1e-3 * u * u

    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0
        at, x = _features(counts, self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def train(docs: DataFrame, learnt: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 2400, epochs: int = 3) -> Model:
    """A model from the rows for which ``learnt`` holds; ``sample_rows`` bounds the labelled sample that fits the weights."""
    rows = docs.where(learnt).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))
    labelled = rows.where(F.col("y").isNotNull() & F.col("t").isNotNull())
    per = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()}
    languages = sorted(per)
    if not languages:
        return Model([], np.ones(DIM), np.zeros((DIM, 1)), 1.0)
    df, n = document_frequencies(labelled.select("t"))
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    each = max(1, sample_rows // len(languages))
    chance = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30))
    within = F.create_map(*[F.lit(v) for y in languages for v in (y, int(min(1.0, (1.5 * each + 60) / per[y]) * (1 << 30)))])
    few = labelled.where(chance < F.element_at(within, F.col("y"))).withColumn("c", chance)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("c", "k", F.xxhash64("t")))).where(F.col("r") <= each)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, rs, ats, xs = [], [], [], []
            for y, r, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                c = ngram_counts(t.as_py())
                if c is not None:
                    at, x = _features(c, idf)
                    ys.append(y.as_py()), rs.append(r.as_py()), ats.append(at.astype(np.int32)), xs.append(x.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.string()), pa.array(rs, pa.int32()), pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))], ["y", "r", "at", "x"])

    got = few.select("y", "r", "t").mapInArrow(encode, "y string, r int, at array<int>, x array<float>").toPandas().sort_values(["r", "y"])
    place = {y: i for i, y in enumerate(languages)}
    sample = [(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=np.float64), place[y]) for a, x, y in zip(got["at"], got["x"], got["y"], strict=True)]
    # each language's second, seventh, ... row, so that every language with a row is fitted
    kept = (got.groupby("y").cumcount() % 5 == 1).to_numpy()
    ftrl, fit = Ftrl(len(languages)), [s for s, k in zip(sample, kept, strict=True) if not k]
    for _ in range(epochs):
        for s in fit:
            ftrl.learn(*s)
    w = ftrl.weights()
    aside = [s for s, k in zip(sample, kept, strict=True) if k]
    logits = np.array([x @ w[at] for at, x, _ in aside]).reshape(-1, len(languages))
    return Model(languages, idf, w.astype(np.float32), temperature(logits, np.array([s[2] for s in aside], dtype=np.int64)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score after them."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 weights a language
    at = keep.index(text) if text in keep else len(keep)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *([] if at < len(keep) else [F.col(text).alias("text")]))
    result = T.StructType([packed.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = b.column(0).field(at) if at < len(keep) else b.column(1)
            got = [model.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["row", "lang_pred", "score"])

    return packed.mapInArrow(run, result).select(*[F.col(f"row.`{c}`") for c in keep], "lang_pred", "score")
