"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the whole lower-cased text with sublinear counts and
inverse document frequencies, scaled to length one.  Document frequencies come from every
training row.  The weights are fitted with follow-the-regularised-leader steps under an
elastic-net penalty, on a bounded sample with as many rows of each language; a part of the sample
is held back to fit the temperature that calibrates the scores.

Only ``text`` and ``lang`` of training rows are learned from; a prediction sees the text alone.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does every row
where nothing could be learned (no labelled training row); a null doc_id is neither held out nor
trained on; rows that repeat are counted one by one; an empty table gives an empty result; very
long texts are used whole; other columns are left alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageOptions:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15  # of the feature space
    sample_rows: int = 4_000  # bound on the labelled rows the weights are fitted to
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    folds: int = 5
    calibration_share: float = 0.2
    min_score: float = 0.5  # for the filter: more likely than all other languages together


_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case with a blank at both ends and runs of others than letters as one blank."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[a]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, a, np.uint32(32))[keep]


def features(text: str, options: LanguageOptions) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, 1 + log of their counts)."""
    c = _codes(text)
    shift = np.uint32(32 - options.bits)
    grams = []
    for n in options.orders:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, dtype=np.uint32) * _MULT[4]
            for j in range(n):
                h = (h ^ (c[j : len(c) - n + 1 + j] * _MULT[j % 4])) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            grams.append((h * _MULT[0]) >> shift)
    counts = np.bincount(np.concatenate(grams), minlength=1 << options.bits) if grams else np.zeros(1 << options.bits, dtype=np.int64)
    index = np.flatnonzero(counts)
    return index, 1 + np.log(counts[index])


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # features by labels
    bias: np.ndarray
    temperature: float
    options: LanguageOptions

    def logits(self, text: str) -> np.ndarray:
        index, tf = features(text, self.options)
        x = tf * self.idf[index]
        norm = np.sqrt(x @ x)
        return (x @ self.weights[index]) / norm + self.bias if norm else self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, options: LanguageOptions) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after per-coordinate follow-the-regularised-leader steps, in row order."""
    d = 1 << options.bits
    z, n = np.zeros((d + 1, classes)), np.zeros((d + 1, classes))

    def leader(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        # in closed form: zero within the l1 ball, shrunk by l2 and the step size beyond it
        rate = (options.beta + np.sqrt(ni)) / options.alpha + options.l2
        return np.where(np.abs(zi) <= options.l1, 0.0, -(zi - np.sign(zi) * options.l1) / rate)

    for _ in range(options.epochs):
        for (index, x), label in zip(rows, y.tolist(), strict=True):
            at, v = np.append(index, d), np.append(x, 1.0)
            w = leader(z[at], n[at])
            p = softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / options.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(z, n)
    return w[:d], w[d]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds


def _document_frequencies(train: DataFrame, options: LanguageOptions) -> tuple[np.ndarray, int]:
    """Over every training row; each task hands on one array of the fixed feature space."""
    d = 1 << options.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(d, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                index, _ = features(t.as_py(), options)
                df[index] += 1
                n += 1
        if n:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, d)), pa.array(np.append(df[some], n))], names=["feature", "n"])

    sums = train.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(d + 1, dtype=np.int64)
    df[sums["feature"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return df[:d], int(df[d])


def train_language_model(docs: DataFrame, options: LanguageOptions = LanguageOptions(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    train = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    train = train.where((fold_of("doc_id", options.folds) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    labels = tuple(sorted(sizes))
    df, n = _document_frequencies(train, options)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = options.sample_rows / len(labels)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, each / c) * (1 << 30)))) for k, c in sizes.items()])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), options) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("lang"), pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())],
                names=["order", "lang", "index", "tf"],
            )

    picked = train.where(part < share).select(F.xxhash64("doc_id", F.lit(23)).alias("order"), "lang", "text").limit(2 * options.sample_rows)
    rows = picked.mapInArrow(extract, "order long, lang string, index binary, tf binary").toPandas().sort_values(["order", "lang", "index"], kind="stable")
    xs = []
    for i, v in zip(rows["index"], rows["tf"], strict=True):
        index = np.frombuffer(i, "<u4").astype(np.int64)
        x = np.frombuffer(v, "<f4").astype(np.float64) * idf[index]
        xs.append((index, x / (np.sqrt(x @ x) or 1.0)))
    y = np.array([labels.index(k) for k in rows["lang"]], dtype=np.int64)
    cut = len(xs) - int(len(xs) * options.calibration_share)
    weights, bias = fit_ftrl(xs[:cut], y[:cut], len(labels), options)
    held = np.array([x @ weights[i] + bias for i, x in xs[cut:]]).reshape(-1, len(labels))
    return LanguageModel(labels, idf, weights.astype(np.float32), bias, fit_temperature(held, y[cut:]), options)


def predicted(docs: DataFrame, model: LanguageModel | None, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns with ``lang_pred`` and ``score``."""
    schema = [docs.schema[c] for c in columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    body = docs.select(*[F.col(c) for c in columns], F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__body"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) if model and t.is_valid else (UNKNOWN, 0.0) for t in batch.column("__body")]
            own = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*columns, "lang_pred", "score"])

    return body.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, options: LanguageOptions = LanguageOptions(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row."""
    model = train_language_model(docs, options, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    held = F.coalesce(fold_of("doc_id", options.folds) == 0, F.lit(False))
    return predicted(rows.withColumn("held_out", held), model, ["doc_id", "held_out"], "__text").select("doc_id", "held_out", "lang_pred", "score")


def language_filter(docs: DataFrame, options: LanguageOptions = LanguageOptions(), keep: tuple[str, ...] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The input's rows in a kept language (any learned one by default) with a fair score.

    Where nothing could be learned the filter has no ground to reject and keeps every row.
    """
    model = train_language_model(docs, options, doc_id, text, lang)
    if model is None:
        return docs
    cols = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    out = predicted(named, model, named.columns, f"c{cols.index(text)}")
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= options.min_score)
    if keep is not None:
        good = good & F.col("lang_pred").isin(*keep)
    return out.where(good).select(*named.columns).toDF(*cols)
