"""Windowed and pairwise scoring with plug-in models, resumable."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import windows
from tessera.operators import guards
from tessera.operators.rank import ordered_index
from tessera.sources.tables import children, move, remove


#: least number of join keys of the full product
KEYS = 256


def padded_slices(lengths: list[int], rows: int, padding: float) -> Iterator[tuple[int, int]]:
    """(start, end) of batches over rising lengths: at most ``rows`` each, of which at most the share ``padding`` is filled up to the longest."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == rows or (i - start + 1) * n - total - n > padding * (i - start + 1) * n):
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def length_batches(items: Iterator[tuple], rows: int = 64, padding: float = 0.1, held: int = 4_000_000) -> Iterator[list[tuple]]:
    """Items (..., text) as batches for a model, of equal length wherever they can be.

    Items wait in buckets by length; a bucket that fills is a batch without padding, whatever texts its windows come
    from. When more than ``held`` characters wait, and at the end, what waits goes out by rising length in batches
    within the ``padding`` budget. Memory is bounded by ``held`` and one item.
    """
    waiting: dict[int, list[tuple]] = {}
    size = 0

    def rest() -> Iterator[list[tuple]]:
        left = [item for n in sorted(waiting) for item in waiting[n]]
        for a, b in padded_slices([len(item[-1]) for item in left], rows, padding):
            yield left[a:b]
        waiting.clear()

    for item in items:
        n = len(item[-1])
        bucket = waiting.setdefault(n, [])
        bucket.append(item)
        size += n
        if len(bucket) == rows:
            yield waiting.pop(n)
            size -= n * rows
        elif size > held:
            yield from rest()
            size = 0
    yield from rest()


def score_windows(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], size: int = 1022, overlap: int = 200, batch: int = 64, padding: float = 0.1) -> DataFrame:
    """key, start, length, score of every window. The model sees batches of equal or like length (``length_batches``); its score of a window must not depend on the others.

    Windows are exploded next to their text (no shuffle). Texts that are null or empty have no window.
    """
    tall = rows.select(F.col(key).alias("key"), F.explode(windows(text, size, overlap)).alias("w")).select("key", F.col("w.start").alias("start"), F.col("w.window").alias("window"))
    key_type = pa_type(rows, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (item for b in batches for item in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for part in length_batches(items, batch, padding):
            keys, starts, texts = map(list, zip(*part, strict=True))
            scores = np.asarray(model(texts), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(starts, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(scores)], ["key", "start", "length", "score"])

    return tall.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, start long, length long, score double")


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def roll_up_windows(scores: DataFrame, digits: int = 9) -> DataFrame:
    """key, n_windows, mean, max, and the window of the maximum; of ties the shortest, then the earliest."""
    top = F.struct(F.round("score", digits).alias("s"), (-F.col("length")).alias("l"), (-F.col("start")).alias("a"))
    return scores.groupBy("key").agg(F.count("*").alias("n_windows"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.max_by(F.struct("start", "length"), top).alias("_w")).select("key", "n_windows", "mean_score", "max_score", F.col("_w.start").alias("max_start"), (F.col("_w.start") + F.col("_w.length")).alias("max_end"))


def pair_universe(left: DataFrame, left_key: str, right: DataFrame, right_key: str, block: int = 10_000) -> DataFrame:
    """Every (left, right) with pair_index = left_index * n_right + right_index, indexes by ascending key.

    The product is what the operator is. The right side goes into rows of ``block`` keys each, as arrays, and each
    left row meets every block by the block's number (an equi join on a number that the left rows are exploded to),
    then its keys; so neither side is broadcast or collected, whatever its size. With few blocks the number alone would
    send all left rows to few tasks: each block is copied so often that there are ``KEYS`` keys at least, and a left
    row meets one copy, by its own index.
    """
    indexed = ordered_index(right.select(F.col(right_key).alias("right_id")).distinct(), F.asc("right_id"), name="_at").withColumn("right_index", F.col("_at") - 1).drop("_at")
    n = indexed.count()
    n_blocks = max(1, -(-n // block))
    copies = -(-KEYS // n_blocks)
    blocks = indexed.withColumn("_block", F.floor(F.col("right_index") / block).cast("long")).groupBy("_block").agg(F.collect_list(F.struct("right_index", "right_id")).alias("_keys"))
    blocks = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = ordered_index(left.select(left_key).distinct(), F.asc(left_key), name="left_index")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    met = rows.select(F.col(left_key).alias("left_id"), (F.col("left_index") - 1).alias("left_index"), numbers.alias("_block")).withColumn("_copy", F.pmod("left_index", F.lit(copies)).cast("int")).join(blocks, ["_block", "_copy"])
    pairs = met.select("left_id", "left_index", F.explode("_keys").alias("_k")).select("left_id", "left_index", "_k.right_index", "_k.right_id")
    return pairs.withColumn("pair_index", F.col("left_index") * n + F.col("right_index"))


def pair_gate(pairs: DataFrame, score: str, length_sum: str, least: float = 0.99, longest: int = 1600) -> DataFrame:
    """Pairs whose score is above ``least`` (strictly) and whose lengths sum to at most ``longest``."""
    return pairs.filter((F.col(score) > least) & (F.col(length_sum) <= longest))


def pending(pairs: DataFrame, done: DataFrame, key: str = "pair_index") -> DataFrame:
    """Pairs not yet scored."""
    return pairs.join(done.select(key), key, "left_anti")


def checked_pairs(pairs: DataFrame, n_right: int, score: str, length_sum: str, least: float = 0.99, longest: int = 1600) -> DataFrame:
    """Selected pairs as they are; a repeated pair_index, one that is not left_index * n_right + right_index, a score not above ``least`` or a longer pair fails the job."""
    mapped = (F.col("left_index") * n_right + F.col("right_index") == F.col("pair_index")) & (F.col("right_index") < n_right) & (F.col("right_index") >= 0)
    out = guards.require(pairs, mapped, "pair index is not that of its ends: ", "pair_index")
    out = guards.require(out, (F.col(score) > least) & (F.col(length_sum) <= longest), "pair outside the gate: ", "pair_index")
    return guards.unique_rows(out, ["pair_index"], "repeated pair_index: ")


def score_pairs(pairs: DataFrame, model: Callable[[list[str], list[str]], np.ndarray], threshold: float = 0.9, batch: int = 64, padding: float = 0.1) -> DataFrame:
    """pair_index, score and the flag score > threshold; pairs: pair_index, left_text, right_text. The model scores batches of like length; further columns come along."""
    more = [c for c in pairs.columns if c not in ("pair_index", "left_text", "right_text")]
    kinds = [pa_type(pairs, c) for c in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ((*row, a + b) for r in batches for *row, a, b in zip(*(c.to_pylist() for c in r.columns), r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True))
        for part in length_batches(items, batch, padding):
            index, left, right, *rest, _ = map(list, zip(*part, strict=True))
            scores = np.asarray(model(left, right), np.float64)
            own = [pa.array(index, pa.int64()), pa.array(scores), pa.array((scores > threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], ["pair_index", "score", "flag", *more])

    schema = ", ".join(["pair_index long, score double, flag int", *(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in more)])
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("left_text", "right_text")]
    return pairs.select(F.col("pair_index").cast("long").alias("pair_index"), *blank, *more).mapInArrow(run, schema)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The shards whose scores are in place."""
    return sorted(int(name.split("=")[1]) for name in children(spark, f"{folder}/scores") if name.startswith("shard="))


def score_shards(pairs: DataFrame, model: Callable[[list[str], list[str]], np.ndarray], folder: str, shards: int = 1_000, wave: int = 100, threshold: float = 0.9) -> DataFrame:
    """Scores of all pairs, resumable: pair_index, score, flag, shard. A run that was stopped goes on where it was.

    The pairs (pair_index, left_text, right_text) are written once as a work list by shard (index modulo ``shards``).
    ``wave`` shards are scored by one job, a task each, by rising length sum; then each shard's folder is renamed
    into place. The folders in place are the log: a later run reads the list of them, never scores them again, and
    redoes at most the wave that was stopped. A repeated pair_index, and a later run with another set of pairs or
    number of shards, are errors. One run at a time writes to a folder of the shared store.
    """
    spark, work = pairs.sparkSession, f"{folder}/work/shards={shards}"
    if not children(spark, work):
        if children(spark, f"{folder}/work"):
            raise ValueError(f"{folder} was begun with another number of shards")
        dealt = guards.unique_rows(pairs.select(F.col("pair_index").cast("long").alias("pair_index"), "left_text", "right_text"), ["pair_index"], "repeated pair_index: ")
        attempt = f"{folder}/attempts/{uuid.uuid4().hex}"
        dealt.withColumn("shard", F.pmod("pair_index", F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(attempt)
        move(spark, attempt, work)
    listed = spark.read.schema("pair_index long, left_text string, right_text string, shard int").parquet(work)
    content = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(F.col("pair_index").cast("long"), "left_text", "right_text").cast("decimal(38,0)"))).first())
    if content(listed) != content(pairs):
        raise ValueError(f"{folder} was begun with other pairs")
    names = [int(n.split("=")[1]) for n in children(spark, work) if n.startswith("shard=")]
    done = set(committed(spark, folder))
    todo = sorted(n for n in names if n not in done)
    for at in range(0, len(todo), wave):
        now = todo[at : at + wave]
        own = (F.array_position(F.array(*map(F.lit, now)), F.col("shard")) - 1).cast("int")
        rows = listed.filter(F.col("shard").isin(now)).repartitionById(len(now), own)
        ordered = rows.sortWithinPartitions("shard", F.length("left_text") + F.length("right_text"), "pair_index")
        attempt = f"{folder}/attempts/{uuid.uuid4().hex}"
        score_pairs(ordered, model, threshold).write.partitionBy("shard").parquet(attempt)
        for n in now:
            move(spark, f"{attempt}/shard={n}", f"{folder}/scores/shard={n}")
    remove(spark, f"{folder}/attempts")
    if not names:
        return spark.createDataFrame([], "pair_index long, score double, flag int, shard int")
    return spark.read.schema("pair_index long, score double, flag int, shard int").option("basePath", f"{folder}/scores").parquet(f"{folder}/scores")


def symmetric_mean(forward: Column, backward: Column) -> Column:
    """(f(a, b) + f(b, a)) / 2; average over members for an ensemble."""
    return (forward + backward) / 2
