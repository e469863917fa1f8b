"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the corpus' frequent chunks (pre-tokens with the space before them) and their
lengths in tokens, found by bounded summaries in every task, merged as whole summaries, and broadcast: at most
``table_size`` entries of at most ``LONGEST`` characters. Tier 2 is each worker's bounded cache, which encodes
what tier 1 misses. No pre-token is ever shuffled; texts with any white space go the same way.

Null texts count as empty (0 bytes, 0 tokens); rows with equal or null ids each keep their own row; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe
from tessera.sources.tables import table

RANKS = "byte_bpe_50k.tiktoken"
#: Longer chunks are not held in the table, and so many summaries meet in one group.
LONGEST, FAN = 64, 64
SUMMARY = "slot int, keys binary, ends binary, counts binary"


def _pack(slot: int, counter: Counter, size: int) -> pa.RecordBatch:
    top = [x for x in counter.most_common(size) if len(x[0]) <= LONGEST]
    raw = [k.encode() for k, _ in top]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    columns = [[slot], [b"".join(raw)], [ends.tobytes()], [np.array([n for _, n in top], dtype=np.int64).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["slot", "keys", "ends", "counts"])


def _unpack(keys: bytes, ends: bytes, counts: bytes) -> dict[str, int]:
    stops = np.frombuffer(ends, np.int64).tolist()
    return {keys[a:b].decode(): n for a, b, n in zip([0, *stops], stops, np.frombuffer(counts, np.int64).tolist(), strict=False)}


def frequent_pretokens(docs: DataFrame, size: int) -> dict[str, int]:
    """At most ``size`` chunks with about the highest counts over all texts.

    Every task holds at most 16 * size counters (the rarest go when they overflow) and hands on one summary
    of ``size``; summaries merge by a tree in which at most ``FAN`` meet in a group.
    """
    tasks = docs.rdd.getNumPartitions()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        slot = 0
        for batch in batches:
            slot = batch.column(1)[0].as_py() if batch.num_rows else slot
            for text in batch.column(0).to_pylist():
                seen.update(byte_bpe.chunks(text or "")[1])
                if len(seen) > 16 * size:
                    seen = Counter(dict(seen.most_common(4 * size)))
        yield _pack(slot, seen, size)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for row in rows.to_pylist():
            seen.update(_unpack(row["keys"], row["ends"], row["counts"]))
        return pa.Table.from_batches([_pack(key[0].as_py(), seen, size)])

    parts = docs.select("text", F.spark_partition_id().alias("slot")).mapInArrow(count, SUMMARY)
    while tasks > 1:
        tasks = ceil(tasks / FAN)
        parts = parts.withColumn("slot", F.col("slot") % tasks).groupBy("slot").applyInArrow(merge, SUMMARY)
    rows = parts.collect()  # one summary of at most ``size`` entries
    return _unpack(rows[0]["keys"], rows[0]["ends"], rows[0]["counts"]) if rows else {}


class TwoTier(dict):
    """The broadcast table; what it lacks goes to the worker's cache."""

    def __init__(self, frequent: dict[str, int], cache: byte_bpe.Memo):
        super().__init__(frequent)
        self.cache = cache

    def __missing__(self, key: str) -> int:
        return self.cache[key]


@lru_cache(maxsize=1)
def _lengths(ranks_file: str) -> byte_bpe.Lookup:
    encode = byte_bpe.encoder(ranks_file).encode_ordinary
    return byte_bpe.Lookup(lambda s: len(encode(s)))


def token_counts(docs: DataFrame, ranks_file: str, limit: int = 512, table_size: int = 16_384) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    encode = byte_bpe.encoder(ranks_file).encode_ordinary
    frequent = frequent_pretokens(docs, table_size)
    words = [w for w in frequent if "\x00" not in w]
    blob = docs.sparkSession.sparkContext.broadcast(("\x00".join(words), np.array([len(encode(byte_bpe.spelled(w))) for w in words], dtype=np.uint32).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = blob.value
        cache = _lengths(ranks_file)
        first = TwoTier(dict(zip(names.split("\x00"), np.frombuffer(sizes, np.uint32).tolist(), strict=True)) if sizes else {}, cache.after_space).__getitem__

        def count(text: str) -> int:
            head, rest = byte_bpe.chunks(text)
            return (cache.plain[head] if head else 0) + sum(map(first, rest))

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = []
            for text in texts.to_pylist():
                if byte_bpe.END_OF_TEXT in text:
                    parts = text.split(byte_bpe.END_OF_TEXT)
                    n.append(sum(map(count, parts)) + len(parts) - 1)
                else:
                    n.append(count(text))
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS))
