"""Language-model scores by Elias-Fano n-gram tries.

The model is a word bigram model with hierarchical Dirichlet smoothing:

    p(w)     = (c(w) + 0.5) / Z,  Z = N + 0.5 (V + 1)
    p(w | h) = (c(h, w) + m p(w)) / (c(h) + m)

Its logarithm falls into a part that needs (h, w) and w, and a part that needs h alone. So the trie is kept
word by word: the first level holds words, the second the contexts seen before each. It is cut into cells by
the word's hash, and every occurrence is answered in the cell of its word: the numerator for the word itself,
the denominator for the word as the context of what follows. Documents get sums; no table of the corpus is
broadcast or collected, and the tries grow with the input.

What moves is a row for each block of documents and shard of cells. There are at most ``block_tokens`` /
``row_occurrences`` shards, so that a row holds about ``row_occurrences`` occurrences or more at any size, and rows
and bytes grow with the tokens. A shard of a large corpus has many cells: its task sorts its occurrences by cell
on its own disk, answers one cell (``shard_tokens`` tokens) after another, and merges the answers. Files of a task,
the mapped levels of a trie among them, are unlinked as they are made and are lost with the task only.

Words are 64-bit hashes of their lower-cased bytes, contexts 40 bits of them. The chance that any two of a
billion words share a hash is about 3 %; an unseen context is taken for a seen one of the same word with a
chance of 1e-6 for each million contexts that the word has in the cell. Words with more than ``hot_tokens``
training tokens are dealt by word and context; pairs of words with more (found in one document of
``pair_sample``, then counted in all) are answered where they stand and never move. Counts of both are broadcast,
about N / hot_tokens of each at most and 50,000 by default.

Null texts count as empty: one token, the end. Rows with equal or null ids each keep their own row (a null id
is in the training part, as its remainder is null). An empty table gives an empty result; without training
rows all counts are zero. Further columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from array import array
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.sources.tables import staged, table

U64 = np.uint64
CONTEXT_BITS, QUANTA = 40, 4096  # 24 bits are left for a word's place: a trie's words must number less than 2**24
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_P = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(base: U64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, base, U64)]))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts with an END after each text, and the number of tokens of each text.

    A word's hash is the polynomial of its bytes, taken from running sums over the whole buffer.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)  # a text's end also ends its last word
    cut[ends] = True
    begin = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    stop = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    sums = np.zeros(n + 1, U64)
    if n:
        np.cumsum(_BYTE[raw] * _powers(_P, n)[:n], out=sums[1:])
    hashes = mixed((sums[stop] - sums[begin]) * _powers(_INVERSE, n)[begin] + (stop - begin).astype(U64)) if len(begin) else np.zeros(0, U64)
    counts = np.diff(np.searchsorted(begin, np.concatenate([[0], ends])))
    places = np.cumsum(counts)
    return np.insert(hashes, places, END), counts + 1


class EliasFano:
    """A rising sequence of unsigned numbers: low bits packed, high bits in unary, both in one buffer that can be mapped from a file."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        ones = np.bitwise_count(highs).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])  # ones and zeros before each word of highs
        self.zeros = np.arange(len(highs) + 1) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, min(57, (universe // max(1, n)).bit_length() - 1))
        lows = np.zeros(n * low // 64 + 2, U64)
        if low and n:
            part = values & U64((1 << low) - 1)
            bit = np.arange(n, dtype=np.int64) * low
            at, shift = bit >> 6, (bit & 63).astype(U64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            lows[at[starts]] |= np.bitwise_or.reduceat(part << shift, starts)
            over = np.where(shift > 0, part >> (U64(64) - np.maximum(shift, U64(1))), U64(0))
            lows[at[starts] + 1] |= np.bitwise_or.reduceat(over, starts)
        high = (values >> U64(low)).astype(np.int64)
        size = int(high[-1] if n else 0) + n + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, low, lows, np.packbits(bits, bitorder="little").view(U64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the values at places i."""
        if not self.low:
            return np.zeros(len(i), U64)
        bit = i * self.low
        at, shift = bit >> 6, (bit & 63).astype(U64)
        x = self.lows[at] >> shift
        x |= np.where(shift > 0, self.lows[at + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return x & U64((1 << self.low) - 1)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The position of the k-th one or zero (from 0) in the high bits."""
        rank = self.ones if one else self.zeros
        at = np.searchsorted(rank, k, side="right") - 1
        k = (k - rank[at]).astype(np.int64)
        word = self.highs[np.minimum(at, len(self.highs) - 1)]
        word = word if one else ~word
        pos = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            found = np.bitwise_count((word >> pos.astype(U64)) & U64((1 << width) - 1)).astype(np.int64)
            go = k >= found
            k -= found * go
            pos += width * go
        return at * 64 + pos

    def value(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        return ((self.select(i, True) - i).astype(U64) << U64(self.low)) | self.get(i)

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value of at least x between places first and last (last if none), and whether it equals x."""
        high = (x >> U64(self.low)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        h = np.minimum(high, most)
        start = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        end = self.select(h, False) - h
        stop = np.full(len(x), self.n) if last is None else last
        left, bound = np.clip(start, first, stop), np.clip(end, first, stop)
        left, bound = np.where(high > most, stop, left), np.where(high > most, stop, bound)
        want, right = x & U64((1 << self.low) - 1), bound.copy()
        while (open_ := np.flatnonzero(left < right)).size:
            mid = (left[open_] + right[open_]) >> 1
            less = self.get(mid) < want[open_]
            left[open_[less]] = mid[less] + 1
            right[open_[~less]] = mid[~less]
        hit = left < bound
        hit[hit] = self.get(left[hit]) == want[hit]
        return left, hit


class Levels:
    """Arrays written one after another to a file of the task's temporary folder and mapped back read-only; the file is unlinked at once."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.parts: list[tuple[int, np.dtype, int]] = []

    def add(self, x: np.ndarray) -> int:
        self.file.seek(0, os.SEEK_END)
        at = -(-self.file.tell() // 8) * 8
        self.file.seek(at)
        self.file.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
        self.parts.append((at, x.dtype, len(x)))
        return len(self.parts) - 1

    def map(self) -> list[np.ndarray]:
        self.file.write(b"\0" * 16)
        self.file.flush()
        view = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        return [np.frombuffer(view, d, n, at) for at, d, n in self.parts]


class Trie:
    """Words, and for each the contexts seen before it, with quantised log10 numerators."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, owner: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, mass: float, z: float):
        """words rise; (owner, contexts) rise, owner being a place in words; pairs are the counts of each."""
        backoff = np.log10(mass * (counts + 0.5) / z)
        value = np.log10(pairs + mass * (counts[owner] + 0.5) / z) if len(pairs) else np.zeros(0)
        self.least, most = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        self.step = (most - self.least) / (QUANTA - 1) or 1.0
        level = Levels()
        keys = EliasFano.build(words, 1 << 64)
        pointers = EliasFano.build(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(U64), len(owner) + 1)
        # a context is kept relative to its word, whose place goes before it, so that the whole level rises
        below = EliasFano.build((owner.astype(U64) << U64(CONTEXT_BITS)) | contexts, max(1, len(words)) << CONTEXT_BITS)
        for x in (keys, pointers, below):
            level.add(x.lows)
            level.add(x.highs)
        level.add(np.rint((value - self.least) / self.step).astype(np.uint16))
        level.add(counts.astype(np.int64))
        level.add(backoff.astype(np.float32))
        a, b, c, d, e, f, self.quanta, self.counts, self.backoff = level.map()
        self.keys, self.pointers, self.below = EliasFano(keys.n, keys.low, a, b), EliasFano(pointers.n, pointers.low, c, d), EliasFano(below.n, below.low, e, f)
        self.unseen = log10(mass * 0.5 / z)

    def query(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(w), and log10 of the numerator of p(w | h)."""
        count, value = np.zeros(len(words), np.int64), np.full(len(words), self.unseen)
        if not self.keys.n:
            return count, value
        place, known = self.keys.successor(words)
        ask = np.flatnonzero(known)
        at = place[ask]
        count[ask], value[ask] = self.counts[at], self.backoff[at]
        first, last = (self.pointers.value(i).astype(np.int64) for i in (at, at + 1))
        found, hit = self.below.successor((at.astype(U64) << U64(CONTEXT_BITS)) | contexts[ask], first, last)
        value[ask[hit]] = self.least + self.step * self.quanta[found[hit]]
        return count, value


#: Of the rows of a block of documents, numbered from ``first``, one also has what belongs to the documents: ids, lengths,
#: which are in training, and the sums of the pairs answered on the spot. ``docs`` are numbers in the block, times two, plus one for training.
OWN = "ids array<long>, lengths binary, trained binary, local binary"
OWN_KINDS = (pa.list_(pa.int64()), *[pa.binary()] * 3)
OCCURRENCES = f"shard int, first long, {OWN}, docs binary, words binary, contexts binary"
#: For the documents of a block that have words in a shard: known tokens, sums of log10 (c + 0.5) and of the model.
ANSWERS = f"first long, {OWN}, docs binary, known binary, base binary, lm binary"
SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double"
SUM_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
#: Documents of a block at most, and tokens that a trie is built for at most (its words are fewer than 2**24).
BLOCK_DOCS, TRIE_TOKENS = 32_000, 1 << 23


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def contexts_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context of each token: the shortened hash of the word before it in its text."""
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = START
    contexts >>= U64(64 - CONTEXT_BITS)
    return contexts


def place_in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in a rising table, and whether it does."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def counted(docs: DataFrame, words: bool, pairs: np.ndarray | None = None) -> DataFrame:
    """(kind, key, n) over all texts, pre-aggregated in each task: kind 0 words and ends; kind 1 pairs, those in ``pairs`` or, without it, all."""
    wanted = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if parts:
                    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts.clear()
                    unique, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, counts, len(unique)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(unique.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for whole in batches:
            for batch in slices(whole, 0):
                found, lengths = tokens(batch.column(0))
                if words:
                    held[0].append(np.unique(found, return_counts=True))
                if wanted.value is None or len(wanted.value):
                    pair = mixed(found + contexts_of(found, lengths))
                    if wanted.value is not None:
                        pair = pair[place_in(wanted.value, pair)[1]]
                    held[1].append(np.unique(pair, return_counts=True))
            if sum(len(k) for parts in held for k, _ in parts) > 2_000_000:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Cells:
    """A shard's occurrences by cell; on the task's disk where they are many."""

    KINDS = (U64, U64, np.uint16, np.uint32)  # words, contexts, docs, rows

    def __init__(self, cells: int, held: int = 6_000_000):
        self.memory: list[list[tuple]] = [[] for _ in range(cells)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(cells)]
        self.most, self.waiting, self.file = held, 0, None

    def add(self, cell: int, *arrays: np.ndarray) -> None:
        self.memory[cell].append(arrays)
        self.waiting += len(arrays[0])
        if self.waiting > self.most and len(self.memory) > 1:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, os.SEEK_END)
            for parts, places in zip(self.memory, self.disk, strict=True):
                if parts:
                    joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    places.append((self.file.tell(), len(joined[0])))
                    for x, kind in zip(joined, self.KINDS, strict=True):
                        self.file.write(x.astype(kind).tobytes())
                    parts.clear()
            self.waiting = 0

    def load(self, cell: int) -> list[np.ndarray]:
        parts, self.memory[cell] = self.memory[cell], []
        for at, n in self.disk[cell]:
            self.file.seek(at)
            parts.append(tuple(np.frombuffer(self.file.read(n * np.dtype(k).itemsize), k) for k in self.KINDS))
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in self.KINDS]


def added(code: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct codes in order, and the sums of the values of each."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return [code[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)]


def language_model_scores(docs: DataFrame, mass: float = 8.0, shard_tokens: int = 2_500_000, hot_tokens: int | None = None, block_tokens: int = 2_500_000, row_occurrences: int = 250, pair_sample: int = 20) -> DataFrame:
    """Scores of all documents by a model of those with ``held_out`` false.

    docs: doc_id, held_out, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    and mean_score: the score by token, which does not depend on a text's length.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "held_out", F.coalesce("text", F.lit("")).alias("text"))
    training = docs.filter("not held_out")
    some = staged(counted(training.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(pair_sample)) == 0), words=False), "some-pairs")
    about = pair_sample * (some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    often = (hot_tokens or max(shard_tokens // 20, about // 50_000)) / pair_sample / 2
    likely = np.sort(np.array([r["key"] for r in some.filter(F.col("n") > often).collect()], np.int64).view(U64))  # at most 2 N / hot_tokens pairs
    counts = staged(counted(training, words=True, pairs=likely), "counts")
    n, v = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if hot_tokens is None:
        hot_tokens = max(shard_tokens // 20, n // 50_000)  # so that the broadcast has at most 50,000 words and pairs
    starts, rows = docs.agg(F.count_if(~F.col("held_out")), F.count("*")).first()
    z = n + 0.5 * (v + 1)
    all_tokens = n * max(1.0, rows / max(1, starts))
    shards = max(1, min(ceil(all_tokens / shard_tokens), block_tokens // row_occurrences))
    cells = max(1, ceil(all_tokens / (shards * shard_tokens)))  # of each shard

    def table_of(kind: int) -> tuple[np.ndarray, np.ndarray]:
        hot = counts.filter((F.col("kind") == kind) & (F.col("n") > hot_tokens)).collect()  # at most N / hot_tokens keys
        keys = np.array([r["key"] for r in hot], np.int64).view(U64)
        order = np.argsort(keys)
        return keys[order], np.array([r["n"] for r in hot], np.int64)[order]

    hot = spark.sparkContext.broadcast((*table_of(0), *table_of(1)))

    def cell_of(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The cell of each occurrence, numbered through all shards; hot words go by their context too."""
        is_hot = place_in(hot.value[0], words)[1]
        key = np.where(is_hot, mixed(words + contexts), words)
        return (((key >> U64(32)) * U64(shards * cells)) >> U64(32)).astype(np.uint32)

    def seen(count: np.ndarray) -> np.ndarray:
        """Of a word seen so often: what it takes off as the context of the next."""
        return np.log10(count + mass)

    def block(first: int, ids: list, held: list, parts: list) -> pa.RecordBatch:
        """The occurrences of a run of documents, one row for each shard that has any; ids go with the first of them."""
        words, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        contexts = contexts_of(words, lengths)
        trained = ~np.array(held, bool)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        many, totals, pairs, together = hot.value
        at, answered = place_in(pairs, mixed(words + contexts))
        local = np.zeros((3, len(ids)))
        if answered.any():  # pairs so frequent that they are answered here
            word, own = words[answered], doc[answered]
            count = totals[place_in(many, word)[0]]  # a hot pair's word is hot
            value = np.log10(together[at[answered]] + mass * (count + 0.5) / z) - np.where(word != END, seen(count), 0.0)
            local = np.stack([np.bincount(own, w, len(ids)) for w in (np.ones(len(own)), np.log10(count + 0.5), value)])
            words, contexts, doc = words[~answered], contexts[~answered], doc[~answered]
        cell = cell_of(words, contexts)
        order = np.lexsort((words, cell))
        words, contexts, shard = words[order], contexts[order], cell[order] // np.uint32(cells)
        marked = (2 * doc + trained[doc])[order].astype(np.uint16)
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        narrow = contexts.view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8]
        own = (ids, lengths.astype(np.uint32).tobytes(), np.packbits(trained).tobytes(), local.tobytes())
        out = []
        for s in np.flatnonzero(np.diff(bounds)).tolist() or [first % shards]:
            a, b = bounds[s], bounds[s + 1]
            starts_ = np.flatnonzero(np.concatenate([[True], words[a + 1 : b] != words[a : b - 1]])) if b > a else np.zeros(0, np.int64)
            repeats = np.diff(starts_, append=b - a).astype(np.uint32)
            out.append((s, first, *((None,) * 4 if out else own), marked[a:b].tobytes(), words[a:b][starts_].tobytes() + repeats.tobytes(), narrow[a:b].tobytes()))
        kinds = (pa.int32(), pa.int64(), *OWN_KINDS, *[pa.binary()] * 3)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names(OCCURRENCES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, held, parts, waiting = 0, [], [], [], 0
        for whole in batches:
            for batch in slices(whole, 3):
                if not ids:
                    first = batch.column(0)[0].as_py()
                parts.append(tokens(batch.column(3)))
                ids += batch.column(1).to_pylist()
                held += batch.column(2).to_pylist()
                waiting += len(parts[-1][0])
                if waiting > block_tokens or len(ids) > BLOCK_DOCS - 1_000:
                    yield block(first, ids, held, parts)
                    ids, held, parts, waiting = [], [], [], 0
        if ids:
            yield block(first, ids, held, parts)

    def unpack(docs_: bytes, words_: bytes, contexts_: bytes) -> tuple[np.ndarray, ...]:
        doc, unique = np.frombuffer(docs_, np.uint16), len(words_) // 12
        words = np.repeat(np.frombuffer(words_, U64, unique), np.frombuffer(words_, np.uint32, unique, 8 * unique))
        wide = np.zeros((len(doc), 8), np.uint8)
        wide[:, : CONTEXT_BITS // 8] = np.frombuffer(contexts_, np.uint8).reshape(-1, CONTEXT_BITS // 8)
        return words, wide.view(U64).ravel(), doc

    def build(words: np.ndarray, contexts: np.ndarray) -> Trie:
        order = np.lexsort((contexts, words))
        words, contexts = words[order], contexts[order]
        at = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])])) if len(words) else order
        pairs = np.diff(at, append=len(words))
        words, contexts = words[at], contexts[at]
        unique, owner = np.unique(words, return_inverse=True)
        count = np.bincount(owner, weights=pairs, minlength=len(unique)).astype(np.int64)
        there, is_hot = place_in(hot.value[0], unique)  # a hot word's count is that of all its cells
        if is_hot.any():
            count = np.where(is_hot, hot.value[1][there], count)
        return Trie(unique, count, owner, contexts, pairs, mass, z)

    def answers(words: np.ndarray, contexts: np.ndarray, doc: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """Of one cell: the sums by row and document, in order of row << 16 | document."""
        part = (mixed(words) % U64(len(words) // TRIE_TOKENS + 1)).astype(np.int64)
        if len(words) > TRIE_TOKENS and part.min() < part.max():  # perhaps more than one trie's words: by hash, one part after another
            done = [answers(*(x[part == p] for x in (words, contexts, doc, row))) for p in np.unique(part)]
            return added(*(np.concatenate(x) for x in zip(*done, strict=True)))
        trained = (doc & 1).astype(bool)
        trie, sums = build(words[trained], contexts[trained]), []
        for at in range(0, len(words), 500_000):  # summed part by part: the temporary arrays stay small
            part = slice(at, at + 500_000)
            count, value = trie.query(words[part], contexts[part])
            there, is_hot = place_in(hot.value[0], words[part])
            if is_hot.any():  # a hot word may lack any training pair here
                lacking = is_hot & (count == 0)
                count = np.where(is_hot, hot.value[1][there], count)
                value = np.where(lacking, np.log10(mass * (count + 0.5) / z), value)
            value -= np.where(words[part] != END, seen(count), 0.0)
            code = row[part].astype(U64) << U64(16) | (doc[part] >> 1).astype(U64)
            sums.append(added(code, (count > 0).astype(np.float64), np.log10(count + 0.5), value))
        if not sums:
            return [np.zeros(0, U64), *[np.zeros(0)] * 3]
        return added(*(np.concatenate(x) for x in zip(*sums, strict=True))) if len(sums) > 1 else sums[0]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, firsts, owns = Cells(cells), array("q"), {}  # eight bytes for each block; what is its own only where it came to this shard
        for batch in batches:
            own = [batch.column(name) for name in ("first", *names(OWN), "docs", "words", "contexts")]
            for i in range(batch.num_rows):
                first, *other, docs_, words_, contexts_ = (c[i].as_py() for c in own)
                words, contexts, doc = unpack(docs_, words_, contexts_)
                row = np.full(len(doc), len(firsts), np.uint32)
                if other[0] is not None:
                    owns[len(firsts)] = other
                firsts.append(first)
                if cells == 1:
                    spool.add(0, words, contexts, doc, row)
                    continue
                bounds = np.searchsorted(cell_of(words, contexts) % np.uint32(cells), np.arange(cells + 1))
                for c in np.flatnonzero(np.diff(bounds)).tolist():
                    spool.add(c, *(x[bounds[c] : bounds[c + 1]] for x in (words, contexts, doc, row)))
        runs = []
        for c in range(cells):
            found = answers(*spool.load(c))
            if cells > 1:
                level = Levels()
                for x in found:
                    level.add(x)
                found = level.map()
            runs.append(found)
        total = sum(len(r[0]) for r in runs)
        step = max(1, len(firsts) * 1_000_000 // max(1, total))
        for low in range(0, len(firsts), step):
            high = min(len(firsts), low + step)
            near = [[x[a:b] for x in r] for r in runs for a, b in [np.searchsorted(r[0], np.array([low << 16, high << 16], U64)).tolist()]]
            code, known, base, lm = (np.concatenate(x) for x in zip(*near, strict=True))
            if cells > 1:
                code, known, base, lm = added(code, known, base, lm)
            bounds = np.searchsorted(code, np.arange(low, high + 1).astype(U64) << U64(16)).tolist()
            packed = ((code & U64(0xFFFF)).astype(np.uint16), known.astype(np.uint32), base, lm.astype(np.float32))
            out = [(firsts[low + i], *owns.pop(low + i, (None,) * 4), *(x[a:b].tobytes() for x in packed)) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = (pa.int64(), *OWN_KINDS, *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names(ANSWERS))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of one block: the sums of what its shards answered."""
        known, base, lm = np.zeros(1 << 16, np.int64), np.zeros(1 << 16), np.zeros(1 << 16)
        ids, lengths, trained, local = [], b"", b"", b""
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["docs"], np.uint16)
                known[at] += np.frombuffer(row["known"], np.uint32)
                base[at] += np.frombuffer(row["base"], np.float64)
                lm[at] += np.frombuffer(row["lm"], np.float32)
                if row["ids"] is not None:
                    ids, lengths, trained, local = (row[x] for x in names(OWN))
        n = len(ids)
        here = np.frombuffer(local, np.float64).reshape(3, n)
        out = np.unpackbits(np.frombuffer(trained, np.uint8))[:n] == 0
        columns = (ids, out, np.frombuffer(lengths, np.uint32).astype(np.int64), known[:n] + here[0].astype(np.int64), base[:n] + here[1], lm[:n] + here[2])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, SUM_KINDS, strict=True)], names(SUMS))

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.select("row", "doc_id", "held_out", "text").mapInArrow(deal, OCCURRENCES)
    sums = dealt.groupBy("shard").applyInArrow(answer, ANSWERS).groupBy("first").applyInArrow(combine, SUMS)
    known = F.lit(int(n)).cast("long").alias("train_tokens")
    base = (F.col("base") - F.col("n_tokens") * F.lit(log10(z))).alias("base_score")
    score = (F.col("lm") - F.lit(log10(starts + mass))).alias("score")
    found = sums.select("doc_id", "held_out", "n_tokens", "n_known", known, base, score)
    return found.withColumn("mean_score", F.col("score") / F.col("n_tokens"))  # a text has one token at least, its end


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model_scores(docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))))
