"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers stands first or last. That depends on
the k-mer alone, so an edit elsewhere in the text moves no anchor. A fingerprint keeps, for each of 64 hash
ranges, the anchor of least hash with the place where it first stands; two fingerprints are matched by place:
the likeness is the share of ranges whose anchors agree and lie in the same order in both texts.

A text shorter than k is one anchor; an empty or null text has no anchor and the fingerprint ''. The likeness
of two empty fingerprints is 1, of an empty and another 0. Equal texts have equal fingerprints. Documents follow
each other by (doc_id, hash of the text, text), null ids first, so that a hot id (or many null ids) is cut into
runs like any other part of the order. Of rows with the same id and text all but the last are followed by their own
like: where there are over ``HOT`` of them they are counted, compared once, and written out as often by many tasks,
so no run is longer for them. Rows with equal or null ids each keep their own row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import staged, table

K, S, RANGES = 16, 8, 64  # S and K are powers of two
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT, _TOP = np.uint64(32), np.uint64(58)
#: what a null id counts as in the order
FIRST = -(1 << 63)
#: equal rows beyond this number, or beyond a 20,000th of all rows, are counted; they are written out in parts of PART
HOT, PART = 4_000, 100_000


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of 2 * width from hashes of runs of width."""
    x = h[:-width] * _A + h[width:]
    x ^= x >> _SHIFT
    x *= _B
    return x


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (in code points) and hashes of the closed syncmers of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if n < K:
        return np.zeros(min(n, 1), np.int64), np.array([int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")][: min(n, 1)], np.uint64)
    h = (points.astype(np.uint64) + np.uint64(1)) * _B
    width = 1
    while width < S:
        h = _joined(h, width)
        width *= 2
    small, whole = h, h
    while width < K:
        whole = _joined(whole, width)
        width *= 2
    least, have, inner = small, 1, K - S + 1  # the least of each run of ``inner`` s-mers, by doubling
    while have < inner:
        step = min(have, inner - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    last = small[K - S :]
    at = np.flatnonzero((small[: len(least)] == least) | (last == least))
    return at, whole[at]


def sketch(text: str) -> str:
    """Fingerprint: for each range that has an anchor its number (2 hex digits), hash (5) and place (8: Spark's strings are shorter than 2^31)."""
    at, h = anchors(text)
    if not len(h):
        return ""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    _, first = np.unique(h >> _TOP, return_index=True)
    return "".join(f"{v >> 58:02x}{(v >> 38) & 0xFFFFF:05x}{p:08x}" for v, p in zip(h[first].tolist(), at[first].tolist(), strict=True))


def likeness(a: str, b: str) -> float:
    """Share of the ranges of either fingerprint whose anchors agree and keep their order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = ({s[i : i + 2]: s[i + 2 : i + 15] for i in range(0, len(s), 15)} for s in (a, b))
    same = sorted((int(v[5:], 16), int(y[r][5:], 16)) for r, v in x.items() if r in y and y[r][:5] == v[:5])
    chain: list[int] = []  # longest run of places that rise in both
    for _, q in same:
        i = bisect_left(chain, q)
        chain[i : i + 1] = [q]
    return len(chain) / len(x.keys() | y.keys())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch(t) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def keyed(docs: DataFrame) -> DataFrame:
    """k, h, doc_id, text: rows with their place in the order."""
    return docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")


def with_next(docs: DataFrame, rows_per_run: int = 4_000, most_runs: int = 20_000, draws: int = 20) -> DataFrame:
    """Each row in a run of rows near it in the order, and the first row of each run again at the end of the run before.

    Runs are cut at (doc_id, hash) of a hash sample of about ``draws`` rows for each run, which has no bearing on the
    result: each text is shuffled once, no task holds the whole order, and larger tables get longer runs, which
    Spark sorts with spilling. Columns: run, halo (the repeated row), k, h, doc_id, text, ordered by k (the id), h
    and text. The last run ends with the very first row.
    """
    spark = docs.sparkSession
    whole = keyed(docs)
    keys = whole.select("k", "h")
    n = docs.count()
    runs = min(most_runs, max(1, ceil(n / rows_per_run)))
    share = min(1.0, draws * runs / max(1, n))
    drawn = keys.filter(F.pmod(F.xxhash64("h", "k"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas() if runs > 1 else pd.DataFrame({"k": [], "h": []}, dtype=np.int64)  # draws * runs rows or so
    drawn = drawn.drop_duplicates().sort_values(["k", "h"])
    cuts = drawn.iloc[[len(drawn) * i // runs for i in range(1, runs)] if len(drawn) else []].drop_duplicates()
    cut_k, cut_h = cuts["k"].to_numpy(np.int64), cuts["h"].to_numpy(np.int64)

    @F.pandas_udf("int")
    def run_of(k: pd.Series, h: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(cut_k, k.to_numpy(), side=s) for s in ("left", "right"))
        at = high.copy()
        for i in np.flatnonzero(low < high).tolist():  # ids at which runs are cut
            at[i] = bisect_right(cut_h, h[i], low[i], high[i])
        return pd.Series(at)

    placed = keys.withColumn("run", run_of("k", "h")).groupBy("run").agg(F.min(F.struct("k", "h")).alias("first")).orderBy("run").collect()  # a row for each run
    before = [(r["first"]["k"], r["first"]["h"], placed[i - 1]["run"]) for i, r in enumerate(placed)]
    halo = spark.createDataFrame(before, "first_k long, first_h long, halo_run int")
    marked = whole.withColumn("run", run_of("k", "h")).join(F.broadcast(halo), (F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h")), "left")
    places = F.array(F.struct(F.col("run"), F.lit(False).alias("halo")), F.struct(F.col("halo_run").alias("run"), F.lit(True).alias("halo")))
    return marked.select(F.explode(F.filter(places, lambda p: p["run"].isNotNull())).alias("p"), "k", "h", "doc_id", "text").select("p.run", "p.halo", "k", "h", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


RESULT = [x.split()[0] for x in COMPARED.split(", ")]
_kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compared(doc_id: int | None, text: str, mark: str, following: str, following_mark: str) -> tuple:
    """A row of the result: a text with its fingerprint beside the text that follows it with its own."""
    other = edited(text, following)
    other_mark = sketch(other)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mark, other_mark, likeness(mark, other_mark), likeness(mark, following_mark)


def counted_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the rows to put in order, one of each set of hot equal rows; these with their number as ``copies``, None without any)."""
    rows = keyed(docs)
    counts = rows.groupBy("k", "h").agg(F.count("*").alias("n"))
    most = max(HOT, docs.count() // 20_000)
    hot = staged(counts.filter(F.col("n") > most), "hot")  # fewer than 20,000 keys
    if not hot.limit(1).count():
        return docs, None
    keys = F.broadcast(hot.select("k", "h"))
    one = staged(rows.join(keys, ["k", "h"], "left_semi").groupBy("k", "h", "doc_id", "text").agg(F.count("*").alias("copies")), "copies")
    return rows.join(keys, ["k", "h"], "left_anti").select("doc_id", "text").union(one.select("doc_id", "text")), one.select("doc_id", "text", "copies")


def compare_with_itself(copies: DataFrame) -> DataFrame:
    """The result of all but the last of equal rows, which are followed by their like. copies: doc_id, text, copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = sketch(text)
                out.append((*compared(doc_id, text, mark, text, mark), n - 1))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*_kinds, pa.int64()), strict=True)], [*RESULT, "n"])

    found = copies.filter("copies > 1").mapInArrow(run, f"{COMPARED}, n long")
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PART) - 1)))
    size = F.least(F.lit(PART).cast("long"), F.col("n") - F.col("part") * PART)
    return parts.withColumn("n", size).repartition("doc_id", "part").withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*RESULT)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (run, doc_id, text, fingerprint) of the row that waits for the next
        done = None  # the run whose repeated first row has come
        for batch in batches:
            out = []
            for number, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if number == done:  # rows that tie with the repeated one
                    continue
                own = sketch(text)
                if held and held[0] == number:
                    out.append(compared(*held[1:], text, own))
                held, done = (None, number) if halo else ((number, doc_id, text, own), None)
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _kinds, strict=True)], RESULT)

    single, copies = counted_apart(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    ordered = with_next(single).repartition("run").sortWithinPartitions("run", "halo", "k", "h", "text")
    found = ordered.select("run", "halo", "doc_id", "text").mapInArrow(run, COMPARED)
    return found if copies is None else found.union(compare_with_itself(copies))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
