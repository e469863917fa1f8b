"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, lower-cased, and runs of other printable characters; a token in capitals, or
with a capital behind its first letter, is preceded by a mark of its shape, and a word that repeats the one before is a
mark itself. Features are the buckets of the crc32 of runs of one to ``ORDER`` tokens; a feature's value is the root of its
share of the text's. A score is the logistic function of the sparse dot product with the weights, plus a bias.

The model is fitted on a bounded sample of the labelled rows: those of least hash of (doc_id, text) in each class,
``sample_rows`` in all at most, and no more than ``sample_bytes`` of features (eight bytes each), so neither many rows
nor long texts can exceed the driver; exact repeats of a row count as one. A fifth of it chooses the strength of the
penalties. Classes are drawn alike; the bias brings scores back to the shares of all labelled rows. A document labelled
twice is bad if any of its labels is. Scoring reads every whole text without a shuffle.

A null or empty text, or one without tokens, is scored by the bias alone: the share of good rows. Without a labelled document every score is 0.5; with one class only, scores stay near it. Labels with null id or
quality are ignored, documents with null id train nothing but are scored; rows with equal ids keep their own rows;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.language_id import with_fold
from tessera.sources.tables import staged, table

BITS, ORDER = 18, 2
#: predicted is 1 from this score on
THRESHOLD = 0.3
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 64_000_000
#: long texts are read in blocks of so many tokens
BLOCK = 1 << 16
_token = re.compile(r"[^\W_]+|[^\w\s]+|_+")
Vector = tuple[np.ndarray, np.ndarray]


def tokens(text: str) -> Iterator[str]:
    """Lower-cased words, runs of signs, a mark before words with capitals behind the first letter, and one in place of words that repeat the last."""
    last = ""
    for m in _token.finditer(text):
        word = m.group()
        if word[0].isalnum():
            if word == last:
                yield "="
                continue
            last = word
        if not word[1:].islower() and word[1:] != (low := word[1:].lower()):
            yield "A" if word.isupper() else "aA"
            word = word[0] + low
        yield word.lower()


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a text, block by block."""
    before: list[bytes] = []
    found = tokens(text)
    while words := [w.encode("utf-8", "surrogatepass") for _, w in zip(range(BLOCK), found, strict=False)]:
        run = before + words
        grams, crcs = list(map(crc32, run)), []
        for n in range(1, ORDER + 1):
            if n > 1:
                grams = list(map(crc32, run[n - 1 :], map(crc32, repeat(b" "), grams)))
            crcs += grams[max(0, len(before) - n + 1) :]  # the others ended in an earlier block
        yield (np.array(crcs, np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)
        before = run[max(0, len(run) - ORDER + 1) :]


def counted(text: str | None) -> Vector:
    """The distinct buckets of a text and their counts."""
    parts = [np.unique(b.astype(np.uint32), return_counts=True) for b in buckets(text or "")]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    at, back = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return at, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def values(n: np.ndarray) -> np.ndarray:
    """Square roots of the counts' shares: of length one, so that a text's length plays no part."""
    return np.sqrt(n / n.sum())


class Model:
    """Weights by bucket and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, found: Vector) -> float:
        at, n = found
        z = self.bias + (float(self.weights[at] @ values(n)) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], bias: float, alpha: float, l1: float, l2: float, beta: float = 1.0, epochs: int = 3, seed: int = 0) -> Model:
    """FTRL-proximal steps over rows of (buckets, values, 0 or 1); the bias is given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, (np.sign(z_) * l1 - z_) / ((beta + np.sqrt(n_)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(z[at], n[at])
            g = x * (1 / (1 + np.exp(-np.clip(bias + x @ w, -30, 30))) - y)
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return Model(weights(z, n).astype(np.float32), bias)


def log_loss(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    z = np.array([model.bias + model.weights[at] @ x for at, x, _ in rows])
    y = np.array([y for *_, y in rows])
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(h, y, and features of labelled rows: those of least hash in each class, within both bounds; the labelled ids of each class).

    Only hashes meet the labels; the texts are read once more for the rows drawn, whose keys are broadcast.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows at most
    each, most = sample_rows // max(1, len(counts)), sample_bytes // max(1, len(counts))
    share = {y: min(1.0, (1.3 * each + 50) / n) for y, n in counts.items()} or {1: 1.0}  # enough of them, if most labels have a document
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", h)
    part = F.col("h") / (1 << 62)
    near = rows.select("doc_id", "h").filter(part < max(share.values())).join(marks, "doc_id")
    near = near.filter(part < F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("y")]).select("y", "h").distinct()
    inside = Window.partitionBy("y").orderBy("h")
    keys = staged(near.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= each).select("y", "h"), "sample")  # sample_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a row count as one
        for batch in batches:
            for h, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h not in seen:
                    seen.add(h)
                    at, n = (x.astype(np.uint32).tobytes() for x in counted(text))
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([y], pa.int32()), pa.array([at], pa.binary()), pa.array([n], pa.binary())], ["h", "y", "at", "n"])

    drawn = rows.select("h", "text").join(F.broadcast(keys), "h").select("h", "y", "text").mapInArrow(run, "h long, y int, at binary, n binary").dropDuplicates(["h"])
    size = F.sum(F.length("at") + F.length("n")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return drawn.withColumn("size", size).filter(F.col("size") <= most).drop("size"), counts


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The classifier of labelled documents (doc_id, text), within the bounds of ``sample``."""
    found, counts = sample(docs, labels, sample_rows, sample_bytes)
    drawn = []
    for r in found.collect():  # the documented bound
        n = np.frombuffer(r["n"], np.uint32)
        if len(n):
            drawn.append((r["h"], np.frombuffer(r["at"], np.uint32), values(n), r["y"]))
    drawn.sort(key=lambda r: (r[0], r[3]))  # the fit does not depend on the order of arrival
    rows = [r[1:] for r in drawn]
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    odds = lambda good, bad: float(np.log((good + 1) / (bad + 1)))
    good = sum(y for *_, y in rows)
    bias = odds(good, len(rows) - good)
    judge, learn = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    choices = [(alpha, l1, l2) for alpha in (10.0, 30.0) for l1, l2 in ((0.02, 0.01), (0.2, 0.1))]
    best = min(choices, key=lambda c: log_loss(follow_the_leader(learn, bias, *c), judge)) if learn else choices[0]
    model = follow_the_leader(rows, bias, *best)
    model.bias = odds(counts.get(1, 0), counts.get(0, 0))
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [sent.value.score(counted(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(docs.filter("fold <> 0"), with_fold(table(spark, sf_dir, "labels").select("doc_id", "quality")).filter("fold <> 0"))
    found = scored(docs.withColumn("held_out", F.col("fold") == 0), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
