"""Substring search by trigram postings, with the same rows as a scan.

The index of a table has segments, each of some rows that lie together: a row (gram, n, keys) for each distinct run of
three characters of their searched text, in folders by the gram's hash and sorted by gram; the empty gram counts all rows.
Each task writes the segments of what it reads: nothing is shuffled. A search adds up the numbers of its own grams, then reads
the postings of the rarest few, keeps the keys that have them all, and verifies these rows by the text itself. A text shorter
than three characters has no gram, and one whose rarest gram is in more than ``SCANNED`` of the rows spares little: the table
is scanned, which moves no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.explore import search

GRAM, BUCKETS = 3, 64
#: so many of the rarest grams are intersected
RAREST = 3
#: up to so many candidates, a number known before, their keys are pushed to the table's scan
PUSHED = 1_000
#: a text whose rarest gram more than this share of the rows have is looked for in all
SCANNED = 0.05
#: rows and bytes of text of a segment
SEGMENT, BYTES = 2_000, 4_000_000


def searched(columns: list[str]) -> Column:
    """The text that ``explore.search`` looks in."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def segment(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Each distinct run of three characters of the texts with the keys of those that have it."""
    known = [t or "" for t in texts.to_pylist()]
    chars = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in known], np.int64)
    of = np.repeat(np.arange(len(known)), lengths)
    at = np.flatnonzero(of[: -GRAM + 1] == of[GRAM - 1 :]) if len(chars) >= GRAM else np.zeros(0, np.int64)  # runs within a text
    code, of = chars[at] << 42 | chars[at + 1] << 21 | chars[at + 2], of[at]
    order = np.argsort(code, kind="stable")  # the texts of a run in order
    code, of = code[order], of[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    code, of = code[new], of[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    runs = code[starts]
    said = np.stack([runs >> 42, runs >> 21 & 0x1FFFFF, runs & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    ends = np.concatenate([[0], starts, [len(code)]]).astype(np.int32)  # first the empty run, which lists no key
    columns = [pa.array(["", *(said[i : i + GRAM] for i in range(0, len(said), GRAM))]), pa.array(np.concatenate([[len(known)], np.diff(ends[1:])]).astype(np.int64))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array(of)))], ["gram", "n", "keys"])


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """The postings of a table, by the tasks that read it."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(SEGMENT, batch.num_rows - at)
                while n > 1 and (pc.sum(pc.binary_length(batch.column(1).slice(at, n))).as_py() or 0) > BYTES:
                    n //= 2
                yield segment(batch.column(0).slice(at, n), batch.column(1).slice(at, n))
                at += n

    found = rows.select(F.col(key).alias("key"), searched(columns).alias("text")).mapInArrow(segments, f"gram string, n long, keys array<{rows.schema[key].dataType.simpleString()}>")
    found.withColumn("bucket", bucket(F.col("gram"))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, text: str, key_type: str) -> tuple[DataFrame | None, int]:
    """(keys that have the text's rarest grams, how many there are at most); (None, 0) if the text is too short or its grams too frequent."""
    text = text.lower()
    own = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not own:
        return None, 0
    at = F.col("gram").isin([*own, ""]) & F.col("bucket").isin([r[0] for r in spark.createDataFrame([(g,) for g in [*own, ""]], "gram string").select(bucket(F.col("gram"))).distinct().collect()])
    stored = spark.read.schema(f"gram string, n long, keys array<{key_type}>, bucket int").parquet(f"{path}/postings").filter(at)
    numbers = {r["gram"]: r["n"] for r in stored.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the text
    total = numbers.pop("", 0)
    rare = sorted((n, gram) for gram, n in numbers.items())[:RAREST]
    if len(numbers) < len(own):
        rare = []  # a gram that no row has
    elif rare[0][0] > max(PUSHED, SCANNED * total):
        return None, 0
    listed = stored.filter(F.col("gram").isin([g for _, g in rare]) if rare else F.lit(False)).select("gram", F.explode("keys").alias("key"))
    keys = listed.groupBy("key").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(rare)).select("key")
    return keys, rare[0][0] if rare else 0


def indexed_search(rows: DataFrame, key: str, columns: list[str], path: str, text: str, facets: dict[str, object] | None = None) -> DataFrame:
    """What ``explore.search`` finds, by the index of the same rows, key and columns."""
    keys, most = candidates(rows.sparkSession, path, text, rows.schema[key].dataType.simpleString())
    if keys is None:
        return search(rows, text, columns, facets)
    if most <= PUSHED:  # the keys are at most ``most``
        wanted = [r["key"] for r in keys.collect()]
        near = rows.filter(F.col(key).isin(wanted) if wanted else F.lit(False))
    else:
        near = rows.join(keys, F.col(key) == F.col("key"), "left_semi")
    return search(near, text, columns, facets)
