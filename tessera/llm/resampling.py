"""Importance resampling toward a target distribution, by hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every other ASCII byte that is no letter or digit; the rest of UTF-8 stays,
so ``bytes.split`` yields the words. The crc32 of an n-gram goes on from the one of its first words: crc32 takes it
as its seed, so no n-gram is ever joined. A task keeps one Counter of buckets (``BUCKETS`` keys at most), Spark adds
those of all tasks, and the gains of all buckets, one number each, are broadcast for the second pass over the texts.

A document's weight is the floored mean of its features' gains; its score adds a Gumbel number that only depends on
its id, so that the highest scores are a draw without replacement in proportion to the exponential of the weights.
The draw ranks the documents by a range-partitioned order, no key of which can be hot.

A null or empty text, or one without words, has no features and weight 0; it takes part in the draw only if
``min_words`` is 0. Long texts are read in blocks, so memory beyond the text itself is bounded. A null id reads as
empty text in the hash and ranks after all others. Rows that repeat are documents of their own: they tie, and get
consecutive ranks. An empty target, or an empty table, gives gains from the added counts alone; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rank import ordered_index
from tessera.sources.tables import staged, table

BUCKETS, ORDER = 10_000, 2
#: of the documents of so many words or more, so many in a hundred are drawn
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: a byte of UTF-8 as it is split: lower-cased, or blank
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
#: long texts are read in blocks of about so many bytes
BLOCK = 1 << 20


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, block by block; words are never cut."""
    plain = text.translate(BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def buckets(text: bytes, order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text its number of new words and the buckets of the n-grams that end in it."""
    before: list[bytes] = []
    for words in word_blocks(text):
        run = before + words
        crcs = list(map(crc32, words))
        grams = list(map(crc32, run))
        for n in range(2, order + 1):  # those of n words go on from those of n - 1
            grams = list(map(crc32, run[n - 1 :], map(crc32, repeat(b" "), grams)))
            crcs += grams[max(0, len(before) - n + 1) :]  # the others ended in an earlier block
        yield len(words), np.array(crcs, np.uint32) % BUCKETS
        before = run[max(0, len(run) - order + 1) :]


def bucket_counts(texts: DataFrame, order: int = ORDER) -> np.ndarray:
    """How many features of the column ``text`` fall in each bucket; a row for each task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, found in buckets(text or b"", order):
                    seen.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of a bucket to the source's, one added to each count; floored."""
    of_source, of_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight of every whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for text in batch.column(1).to_pylist():
                n = size = total = 0
                for new, found in buckets(text or b"", order):
                    n, size, total = n + new, size + len(found), total + int(sent.value[found].sum())
                words.append(n)
                features.append(size)
                weight.append(total // size if size else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``weights`` with score and rank: 1, 2, 3... for those drawn, null for the others."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = staged(weights.withColumn("score", F.col("weight") + gumbel), "weights")
    fit = rows.filter(F.col("n_words") >= min_words)
    place = ordered_index(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), name="rank")
    ranked = place.withColumn("rank", F.when(F.col("rank") <= percent * fit.count() // 100, F.col("rank")))
    return ranked.unionByName(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn toward the distribution of ``target``'s texts."""
    gains = bucket_gains(bucket_counts(docs, order), bucket_counts(target, order))
    return drawn(weighed(docs, gains, order), percent, min_words, seed)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 in SQL: its table of 256 remainders by eight halvings, then one step a byte, over distinct features only
OP11_SQL = r"""
with recursive bits(i, k, v) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8),
crc_table as materialized (select list(v order by i) as v from bits where k = 8),
texts as materialized (
  select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
words as materialized (
  select side, id, row_number() over () as row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
features as materialized (
  select side, row_id, unnest(w) as f from words
  union all select side, row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words),
distinct_features as materialized (select f, hex(encode(f)) as x from (select distinct f from features)),
bucket_of as materialized (
  select f, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
                            lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1]::bigint)), 4294967295::bigint) % 10000 as bucket
  from distinct_features, crc_table),
counted as materialized (
  select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from features join bucket_of using (f) group by bucket),
totals as (select count(*) filter (side = 0) as ss, count(*) filter (side = 1) as tt from features),
gains as materialized (
  select bucket, floor(1000 * ln((t + 1.0::double) * (ss + 10000)::double / ((s + 1.0::double) * (tt + 10000)::double)))::bigint as gain from counted, totals),
summed as (
  select row_id, count(*) as n_features, sum(gain)::double as total from features join bucket_of using (f) join gains using (bucket) where side = 0 group by row_id),
weighed as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(floor(total / n_features), 0)::bigint as weight,
         ('0x' || substr(sha256('7:' || coalesce(id::varchar, '')), 1, 8))::bigint as h
  from words left join summed using (row_id) where side = 0),
scored as materialized (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from weighed),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features, weight) as place,
         count(*) filter (n_words >= 20) over () as n from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= 20 and place <= 25 * n // 100 then place end as rank from ranked
"""
