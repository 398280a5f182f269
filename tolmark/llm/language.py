"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 code points of the text (A-Z lower-cased), with
weights (1 + log count) * log((1 + N) / (1 + df)), scaled to length 1. Document frequencies cover all training documents,
whole. Weights are trained by follow-the-regularised-leader with elastic-net penalties (FTRL-proximal: most weights
end at exactly 0) on a sample of about SAMPLE documents for each language, chosen by a hash of doc_id and in its order; one in
five of the sample is left out of the fit and sets the temperature by which scores are divided before the softmax.

Training documents are those with lang and doc_id whose crc32(doc_id as text) mod 5 is not 0; the others are held out. A
prediction uses the text alone.

Defined results: ``und`` with score 0 for null texts, for texts without a letter (a character of a category L*: numerals such as
a half or a Roman eight are none), and for all if there is nothing to learn
from; of equal scores the alphabetically first language; with one language, that language with score 1. held_out is null for null doc_id. Repeated rows are predicted alike (and count
twice in training). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tolmark.llm._tables import table

#: Hashed features; bounds the model and the document frequencies.
BITS = 15
FEATURES = 1 << BITS
#: Documents of a language from which weights are learnt, in expectation.
SAMPLE = 400
UNKNOWN = "und"
_U = np.uint32
#: Code points that are mixed at once; n-grams go over the ends of such a run.
AT_ONCE = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their counts."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    for s in range(0, len(points), AT_ONCE):
        own = points[s : s + AT_ONCE + 2]  # with the n-grams that begin in this run
        own = np.where((own >= 65) & (own <= 90), own + _U(32), own)
        run = min(AT_ONCE, len(points) - s)
        gram = np.full(len(own), 1, _U)
        for n in (1, 2, 3):
            if len(own) < n:
                break
            gram = gram[: len(own) - n + 1] * _U(0x9E3779B1) + own[n - 1 :]
            mixed = (gram ^ (gram >> _U(15))) * _U(2_246_822_519)
            mixed = (mixed ^ (mixed >> _U(13))) * _U(3_266_489_917)
            total += np.bincount((mixed ^ (mixed >> _U(16)))[:run] >> _U(32 - BITS), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[found]
    return x / (np.sqrt((x * x).sum()) or 1.0)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # by feature and language; the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found, counts = features(text)
        p = softmax((weighted(found, counts, self.idf) @ self.weights[found] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates; rows are (features, values) and the bias, a feature that is always 1, has no L1 penalty."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (found, x), y in zip(rows, target):
            at, x = np.append(found, FEATURES), np.append(x, 1.0)
            penalty = np.full((len(at), 1), l1)
            penalty[-1] = 0
            w = weights(z[at], n[at], penalty)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error[None, :]
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    penalty = np.full((FEATURES + 1, 1), l1)
    penalty[-1] = 0
    return weights(z, n, penalty)


def temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden section over its logarithm."""
    if not len(target):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(target)), target], 1e-12)).mean()
    low, high, golden = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each feature occurs, and at the end the number of texts. FEATURES + 1 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                for text in b.column(0).slice(s, 256).to_pylist():
                    total[features(text)[0]] += 1
                    total[-1] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    sums = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out[sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return out


def train(df: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """df: the training documents."""
    own = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n = _frequencies(own.select("text"))
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) if n[-1] else np.zeros(FEATURES)
    per = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    shares = df.sparkSession.createDataFrame([(k, min(1.0, sample / v)) for k, v in per.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = own.withColumn("draw", draw).join(F.broadcast(shares), "lang").where("draw < share").select("doc", "lang", "text", "draw")  # a row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                rows = [features(t) for t in part.column(2).to_pylist()]
                found, counts = (pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), found, counts], names=["doc", "lang", "draw", "found", "counts"])

    local = chosen.mapInArrow(run, "doc long, lang string, draw double, found array<int>, counts array<int>").toPandas()
    local["order"] = [(d * 977) % 1 for d in local["draw"]]  # mixes the languages, which have different shares
    local = local.sort_values(["order", "doc", "lang"], kind="stable")
    rows = [(f, weighted(f, np.asarray(c), idf)) for f, c in ((np.asarray(f, np.int64), c) for f, c in zip(local["found"], local["counts"]))]
    target = np.array([languages.index(x) for x in local["lang"]], np.int64)
    aside = np.arange(len(rows)) % 5 == 4
    weights = ftrl([r for r, a in zip(rows, aside) if not a], target[~aside], len(languages))
    scores = np.array([x @ weights[f] + weights[-1] for (f, x), a in zip(rows, aside) if a]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(scores, target[aside]))


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """doc, held_out, lang_pred, score: a row for each row of df. No shuffle; the model has FEATURES + 1 rows for each language."""
    slim = df.select(F.col(key).cast("long").alias("doc"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                made = [own.predict(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, "doc long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    return predict(docs, "doc_id", "text", model).withColumnRenamed("doc", "doc_id")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
