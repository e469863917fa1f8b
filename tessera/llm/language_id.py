"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased text, weighted by their share of
the text times their inverse document frequency, which counts every training document. The weights come from
follow-the-regularised-leader with an elastic net (most of them are exactly zero); a temperature fitted on
labelled documents kept from the training calibrates the probabilities.

The classifier is fitted on a bounded sample of the labelled rows: ``sample_rows`` in all, dealt evenly over the
languages (one row each at least), and in each language those of least hash of (doc_id, text), so that copies
of a text under different ids are drawn like any other row; exact repeats of a row count as one. Its features
come to the driver, six bytes for each distinct bucket of a text, and no more than ``sample_bytes`` in all, dealt over
the languages likewise: rows are taken in order of their hash while they fit (the first of a language always).
Every learned language is predicted; fitting takes 1.5 MB on the driver for each language, the broadcast weights 0.25 MB. Prediction
reads every whole text and needs no shuffle.

A text that is null or has no letter is 'und' with score 0. Without labelled rows every text is 'und'. Ties go
to the language first in order of name. Rows with equal or null ids each keep their own row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.sources.tables import table

BITS, ORDERS, SCALE = 16, 3, 40.0
UNKNOWN = "und"
_M = np.uint64(0x9E3779B97F4A7C15)
_letter = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """The hash buckets of all n-grams of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, run = [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        run = (run[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _M
        out.append((run ^ (run >> np.uint64(29))) * _M >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with any n-gram, and for each bucket the number of texts that have it; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 1, np.int64)  # the last counts the texts
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = grams(text)
                if len(at):
                    here = np.zeros(len(seen), bool)
                    here[at] = here[-1] = True
                    seen += here
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row for each bucket at most
    seen = np.zeros((1 << BITS) + 1)
    seen[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy()
    return int(seen[-1]), seen[:-1]


def labelled_features(docs: DataFrame) -> DataFrame:
    """lang, fold, h, and the distinct buckets of a text with their counts, as 16-bit and 32-bit numbers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 3)):
            found = [np.unique(grams(t), return_counts=True) for t in part.column(3).to_pylist()]
            at, n = ([x[k].astype(kind).tobytes() for x in found] for k, kind in ((0, np.uint16), (1, np.uint32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "fold", "h", "at", "n"])

    return docs.select("lang", "fold", "h", "text").mapInArrow(run, "lang string, fold int, h long, at binary, n binary")


def sample(usable: DataFrame, counts: dict[str, int], sample_rows: int, sample_bytes: int) -> DataFrame:
    """Features of the rows of least hash in each language, ``sample_rows`` and ``sample_bytes`` over the number of languages at most; no text is shuffled."""
    each = max(1, sample_rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * each + 50) / n))])  # surely enough of them
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    near = labelled_features(usable.withColumn("h", h).filter(F.col("h") / (1 << 62) < share[F.col("lang")]))
    inside = Window.partitionBy("lang").orderBy("h")
    first = near.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= each)
    size = F.sum(F.length("at") + F.length("n")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("size", size).filter((F.col("size") <= sample_bytes // len(counts)) | (F.col("place") == 1)).drop("place", "size")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5, epochs: int = 3, seed: int = 0) -> np.ndarray:
    """Weights (buckets x classes) by FTRL-proximal steps over (buckets, values, class) rows."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, (np.sign(z_) * l1 - z_) / ((beta + np.sqrt(n_)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The temperature in 0.05 to 20 of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(margins / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """classes in order of name, weights already multiplied by IDF and scale, bias-free, and a temperature."""

    def __init__(self, classes: list[str], weights: np.ndarray, temperature: float):
        self.classes, self.weights, self.temperature = classes, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or text is None or not _letter.search(text):
            return UNKNOWN, 0.0
        at = grams(text)
        z = np.zeros(len(self.classes))
        for i in range(0, len(at), 1 << 16):
            z += self.weights.take(at[i : i + (1 << 16)], axis=0).sum(axis=0, dtype=np.float64)
        p = softmax(z / len(at) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def train(docs: DataFrame, sample_rows: int = 6_000, sample_bytes: int = 100_000_000) -> Model:
    """docs: doc_id, lang, text and fold (0 to 4; fold 1 calibrates, the others but 0 train, 0 is never read)."""
    usable = docs.filter("fold <> 0 and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a number for each language
    if not counts:
        return Model([], np.zeros((0, 0)), 1.0)
    classes = sorted(counts)
    total, seen = document_frequencies(usable)
    idf = np.log((1 + total) / (1 + seen)) + 1
    number = {c: i for i, c in enumerate(classes)}
    rows = []
    for r in sample(usable, counts, sample_rows, sample_bytes).collect():  # the documented bound
        if r["at"]:
            at, n = np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.uint32)
            rows.append((r["fold"], at, (n / n.sum() * idf[at] * SCALE).astype(np.float32), number[r["lang"]]))
    rows.sort(key=lambda r: (r[3], r[1].tobytes(), r[2].tobytes()))  # the fit does not depend on the order of arrival
    weights = follow_the_leader([r[1:] for r in rows if r[0] != 1], len(classes))
    kept = [r for r in rows if r[0] == 1]
    temperature = fit_temperature(np.array([x @ weights[a] for _, a, x, _ in kept]).reshape(len(kept), len(classes)), np.array([r[3] for r in kept], np.int64))
    return Model(classes, (weights * idf[:, None] * SCALE).astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for c in keep for f in docs.schema if f.name == c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(len(keep)).to_pylist()]
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def with_fold(docs: DataFrame) -> DataFrame:
    """fold: crc32 of doc_id as text, modulo 5; null ids train (fold 2)."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5
    return docs.withColumn("fold", F.coalesce(fold.cast("int"), F.lit(2)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    found = predict(docs.withColumn("held_out", F.col("fold") == 0), train(docs), ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
