"""Best-fit packing of documents into sequences by swap-based local search.

Texts become ids on the map side; what moves is one small row for each piece. Pieces are dealt at random to
shards of a fixed size, so a shard's work and memory do not grow with the corpus, and each shard packs its
pieces best-fit decreasing. Local search then moves one piece, or exchanges one for one or two for one, between
any two underfull sequences where the sum of squared fills increases, and stops only when no such step is left;
sequences that become empty go. A shard leaves about one underfull sequence; that is the whole cost of sharding.

A null text is an empty document (only its closing id). Rows with equal or null doc_id are packed each for
itself; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe
from tessera.sources.tables import staged, table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_U32 = struct.Struct("<I")


@lru_cache(maxsize=1)
def _ids(ranks_file: str) -> byte_bpe.Lookup:
    encode = byte_bpe.encoder(ranks_file).encode_ordinary

    def value(s: str) -> bytes:
        ids = encode(s)
        return struct.pack(f"<{len(ids)}I", *ids)

    return byte_bpe.Lookup(value)


def document_ids(text: str, lookup: byte_bpe.Lookup, closing: int = 0) -> bytes:
    """The document's ids as little-endian 32-bit numbers, the closing id last."""
    special = _U32.pack(byte_bpe.END_OF_TEXT_ID)
    return special.join(b"".join(lookup(part)) for part in text.split(byte_bpe.END_OF_TEXT)) + _U32.pack(closing)


def pieces(docs: DataFrame, ranks_file: str, capacity: int) -> DataFrame:
    """One row for each piece; only documents over ``capacity`` are cut, and only their first piece is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _ids(ranks_file)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = document_ids(text or "", lookup)
                n = len(ids) // 4
                end = n % capacity or capacity
                start = piece = 0
                while start < n:
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Sequences of one shard: their items, their free room, and which of them have a given free room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit f: some open bin has f free

    def add(self, item: int) -> None:
        """Into the open bin with the least free room that is enough, or into a new one."""
        length = self.lengths[item]
        rest = self.mask >> length
        if rest:
            free = length + (rest & -rest).bit_length() - 1
            b = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask &= ~(1 << free)
        else:
            free, b = self.capacity, len(self.items)
            self.items.append([])
            self.free.append(0)
        self.items[b].append(item)
        self.free[b] = free - length
        self.by_free[self.free[b]].append(b)
        self.mask |= 1 << self.free[b]


def best_fit(lengths: list[int], capacity: int) -> Bins:
    bins = Bins(lengths, capacity)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins.add(item)
    return bins


class Donors:
    """Bins by what they can give (a length, or the sum of two) and their fill."""

    def __init__(self, capacity: int):
        self.mask = 0  # bit s: some bin can give s
        self.fills = [0] * (capacity + 1)  # bit f of fills[s]: a bin of fill f can give s
        self.bins: dict[tuple[int, int], set[int]] = {}

    def add(self, s: int, fill: int, b: int) -> None:
        self.bins.setdefault((s, fill), set()).add(b)
        self.fills[s] |= 1 << fill
        self.mask |= 1 << s

    def discard(self, s: int, fill: int, b: int) -> None:
        held = self.bins[s, fill]
        held.discard(b)
        if not held:
            del self.bins[s, fill]
            self.fills[s] &= ~(1 << fill)
            if not self.fills[s]:
                self.mask &= ~(1 << s)

    def emptiest(self, s: int, below: int, but: int) -> int:
        """The bin of least fill, less than ``below``, that can give s, or -1."""
        rest = self.fills[s] & ((1 << below) - 1)
        while rest:
            for b in self.bins[s, (rest & -rest).bit_length() - 1]:
                if b != but:
                    return b
            rest &= rest - 1
        return -1


class LocalSearch:
    """Exchanges between underfull bins until none increases the sum of squared fills.

    An exchange increases it exactly if the bin that gains becomes fuller than both were. So for each bin and
    each of its items, pairs of items, or nothing, given away, the donors are asked for the largest gain that
    fits, the emptiest donor first. Items of equal length are alike: a bin offers each of its distinct lengths and
    sums of two once, some two thousand at most at a capacity of 2048.
    """

    def __init__(self, bins: Bins):
        self.capacity = bins.capacity
        self.content: list[dict[int, list[int]]] = []
        for items in bins.items:
            by_length: dict[int, list[int]] = {}
            for i in items:
                by_length.setdefault(bins.lengths[i], []).append(i)
            self.content.append(by_length)
        self.fill = [bins.capacity - f for f in bins.free]
        self.one, self.two = Donors(bins.capacity), Donors(bins.capacity)
        self.open: set[int] = set()
        for b in range(len(self.fill)):
            self._offer(b)

    def _pairs(self, b: int) -> dict[int, tuple[int, int]]:
        """Sums of two items of a bin, with their lengths."""
        own = sorted(self.content[b])
        return {x + y: (x, y) for k, x in enumerate(own) for y in own[k:] if x != y or len(self.content[b][x]) > 1}

    def _offer(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            self.open.add(b)
            for x in self.content[b]:
                self.one.add(x, self.fill[b], b)
            for s in self._pairs(b):
                self.two.add(s, self.fill[b], b)

    def _withdraw(self, b: int) -> None:
        self.open.discard(b)
        for x in self.content[b]:
            self.one.discard(x, self.fill[b], b)
        for s in self._pairs(b):
            self.two.discard(s, self.fill[b], b)

    def _exchange(self, a: int, give: tuple[int, ...], c: int, take: tuple[int, ...]) -> None:
        """Bin a gives items of these lengths to bin c and takes others from it."""
        self._withdraw(a)
        self._withdraw(c)
        moved = [(c, x, self._pop(a, x)) for x in give] + [(a, x, self._pop(c, x)) for x in take]
        for b, x, i in moved:
            self.content[b].setdefault(x, []).append(i)
        change = sum(give) - sum(take)
        self.fill[a] -= change
        self.fill[c] += change
        self._offer(a)
        self._offer(c)

    def _pop(self, b: int, x: int) -> int:
        own = self.content[b][x]
        i = own.pop()
        if not own:
            del self.content[b][x]
        return i

    def improve(self, c: int) -> bool:
        """Make the exchange that fills bin c most."""
        fill, room = self.fill[c], self.capacity - self.fill[c]
        outs: list[tuple[int, tuple[int, ...]]] = [(0, ()), *((x, (x,)) for x in self.content[c]), *self._pairs(c).items()]
        best, chosen = fill, None
        for s, out in outs:
            for donors in (self.one,) if len(out) == 2 else (self.one, self.two):
                least = best - fill + s + 1  # a smaller gift fills c no more than what is found
                rest = (donors.mask & ((1 << (s + room + 1)) - 1)) >> least
                while rest:
                    gift = rest.bit_length() - 1
                    a = donors.emptiest(least + gift, fill - s + least + gift, c)
                    if a >= 0:
                        best, chosen = fill - s + least + gift, (a, donors, least + gift, out)
                        break
                    rest ^= 1 << gift
            if best == self.capacity:
                break
        if not chosen:
            return False
        a, donors, gift, out = chosen
        self._exchange(a, (gift,) if donors is self.one else self._pairs(a)[gift], c, out)
        return True

    def run(self) -> None:
        changed = True
        while changed:
            changed, failed = False, set()  # bins of equal content fail alike until something changes
            for c in sorted(self.open, key=lambda b: -self.fill[b]):
                while c in self.open:
                    pattern = tuple(sorted((x, len(i)) for x, i in self.content[c].items()))
                    if pattern in failed:
                        break
                    if not self.improve(c):
                        failed.add(pattern)
                        break
                    changed = True
                    failed.clear()


def local_search(bins: Bins) -> None:
    """Exchange between underfull bins until no exchange increases the sum of squared fills."""
    search = LocalSearch(bins)
    search.run()
    bins.items = [[i for own in content.values() for i in own] for content in search.content]


def pack_shard(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each item its bin and its offset there."""
    bins = best_fit(lengths, capacity)
    local_search(bins)
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            bin_of[i], offset[i] = b, at
            at += lengths[i]
    return bin_of, offset


def pack_documents(docs: DataFrame, ranks_file: str, capacity: int = 2048, shard_pieces: int = 60_000) -> DataFrame:
    """Every piece with its sequence and its gapless offset there."""
    cut = staged(pieces(docs, ranks_file, capacity), "pieces")
    shards = max(1, ceil(cut.count() / shard_pieces))
    wide = pow(2, 32)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        bin_of, offset = pack_shard(rows["length"].to_pylist(), capacity)
        first = key[0].as_py() * wide
        out = rows.drop_columns("shard").append_column("sequence_id", pa.array([first + b for b in bin_of], pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, PACKED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS))
