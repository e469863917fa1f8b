"""SimHash near-duplicates by vantage-point trees.

Fingerprints: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of the text's 3-word
shingles. Equal fingerprints are one node. A vantage-point tree cuts the fingerprints into shards by Hamming
distance; it is fitted to a sample of nodes that grows with the shards, ``draws`` for each, up to ``most_shards``
(65,536: two million numbers on the driver), beyond which shards grow instead (tens of bytes for each node, and a
tree of its own inside); a node whose distance lies within the radius below a boundary
is sent beyond it too (triangle bound: two nodes within the radius differ by at most the radius in their
distance to any pivot), so every pair within the radius meets in some shard. A shard goes on with its own
tree, compares exactly, and returns each node with the least node of its group there, never all pairs. The
groups of all shards meet by alternating min-label joins over those few links; no link, component or
fingerprint of all documents comes to the driver.

A null text counts as empty: its fingerprint is zero, linked like any other. Rows with equal doc_id share what
the component of any of them gives; a null doc_id takes part in links but is never a component's id unless no
other id is in it. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import staged, table

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Blocks above this size that no pivot splits are searched by bit flips, not pair by pair.
DENSE = 20_000


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of the word shingles, repeats included; bytes.lower and bytes.split know ASCII letters and space only."""
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def simhash(text: str) -> int:
    """The 64-bit fingerprint, unsigned; zero without words."""
    h = np.array(shingle_hashes(text), np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 200):  # per bit in bytes: 200 rows add up without overflow
        block = np.unpackbits(h[at : at + 200].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(block, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t or "") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


Tree = tuple  # (pivot, boundary, near subtree, far subtree), or (leaf number,)


def _distance(x: np.ndarray, pivot: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(pivot))


def fit_tree(sample: np.ndarray, leaves: int, radius: int = RADIUS) -> tuple[Tree, int]:
    """A tree of about ``leaves`` leaves with boundaries at the sample's medians; its depth grows with their logarithm."""
    count = 0

    def grow(x: np.ndarray, depth: int) -> Tree:
        nonlocal count
        if depth and len(x) >= 16:
            for pivot in x[:3]:
                d = _distance(x, pivot)
                at = int(np.median(d))
                near = d <= at
                if 0 < near.sum() < len(x):
                    return int(pivot), at, grow(x[near], depth - 1), grow(x[d > at - radius], depth - 1)
        count += 1
        return (count - 1,)

    tree = grow(sample, max(0, ceil(log2(max(1, leaves)))))
    return tree, count


def route(tree: Tree, x: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, fingerprints) of every leaf that some of them reach."""
    if not len(x):
        return
    if len(tree) == 1:
        yield tree[0], x
        return
    pivot, at, near, far = tree
    d = _distance(x, pivot)
    yield from route(near, x[d <= at], radius)
    yield from route(far, x[d > at - radius], radius)


def _blocks(x: np.ndarray, radius: int, small: int = 512) -> Iterator[np.ndarray]:
    """Subsets of positions in which all pairs within the radius meet, by a tree local to the shard."""
    stack = [np.arange(len(x))]
    while stack:
        own = stack.pop()
        if len(own) > small:
            pivot = x[own[len(own) // 2]]
            d = _distance(x[own], pivot)
            at = int(np.median(d))
            near, far = own[d <= at], own[d > at - radius]
            if max(len(near), len(far)) <= 0.9 * len(own):
                stack += [near, far]
                continue
        yield own


def _links(x: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs of distinct fingerprints within the radius, in bounded pieces."""
    n = len(x)
    if n <= DENSE or radius != 2:
        step = max(1, 4_000_000 // max(1, n))
        for a in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(x[a : a + step, None] ^ x[None, :]) <= radius)
            i += a
            yield i[i < j], j[i < j]
    else:  # a dense block: look up every flip of one or two bits instead of comparing all
        order = np.argsort(x)
        ordered = x[order]
        bits = [np.uint64(1 << b) for b in range(64)]
        for p in range(64):
            for q in range(p, 64):
                other = x ^ bits[p] ^ (bits[q] if q > p else np.uint64(0))
                at = np.minimum(np.searchsorted(ordered, other), n - 1)
                hit = np.flatnonzero(ordered[at] == other)
                yield hit, order[at[hit]]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of positions i and j; ``root`` holds each position's group, the first one in it."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def groups(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct fingerprints the position of its group's first one."""
    root = np.arange(len(x))
    for own in _blocks(x, radius):
        for i, j in _links(x[own], radius):
            merge(root, own[i], own[j])
    return root


def shard_links(nodes: DataFrame, tree: Tree, shards: int, radius: int = RADIUS) -> DataFrame:
    """Links (fp, to) of each node to the least node of its group in a shard; to < fp as unsigned numbers."""
    sent = nodes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.full(len(x), leaf, np.int32), x) for leaf, x in route(sent.value, batch.column(0).to_numpy().view(np.uint64), radius)]
            if found:
                leaf, x = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x.view(np.int64))], ["leaf", "fp"])

    def compare(rows: pa.Table) -> pa.Table:
        x = np.unique(rows["fp"].to_numpy().view(np.uint64))
        root = groups(x, radius)
        joined = root != np.arange(len(x))
        return pa.table({"fp": x[joined].view(np.int64), "to": x[root[joined]].view(np.int64)})

    return nodes.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInArrow(compare, "fp long, to long")


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(fp, root) of every node that has a link: alternating large-star and small-star joins until nothing changes.

    Each round leaves every link pointing to a smaller node; the number of rounds grows with the logarithm of
    the longest chain. Links of a hot node are aggregated before they are joined.
    """
    now = staged(links.filter("fp <> to").select(F.greatest("fp", "to").alias("fp"), F.least("fp", "to").alias("to")).distinct(), "links")
    for _ in range(rounds):
        both = now.union(now.select("to", "fp"))
        least = both.groupBy("fp").agg(F.min("to").alias("m")).select("fp", F.least("fp", "m").alias("m"))
        large = both.join(least, "fp").filter("to > fp").select(F.col("to").alias("fp"), F.col("m").alias("to")).distinct()
        best = large.groupBy("fp").agg(F.min("to").alias("m"))
        small = large.join(best, "fp")
        after = small.select("fp", F.col("m").alias("to")).union(small.filter("to <> m").select(F.col("to").alias("fp"), F.col("m").alias("to"))).filter("fp <> to").distinct()
        after = staged(after, "links")
        # a forest of stars: each node links once, and no target links on
        n, distinct = after.agg(F.count("*"), F.count_distinct("fp")).first()
        now = after
        if n == distinct and not after.join(after.select(F.col("to").alias("fp")), "fp", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select("fp", F.col("to").alias("root")).union(now.select("to", "to").distinct())


def near_duplicates(docs: DataFrame, shard_nodes: int = 4_000, most_shards: int = 65_536, draws: int = 32, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links of at most ``radius`` bits).

    The tree is fitted to about ``draws`` nodes for each shard, chosen by hash; every node is dealt and compared.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    n = nodes.count()
    leaves = min(most_shards, max(1, n // shard_nodes))
    share = min(1.0, draws * leaves / max(1, n))
    picked = nodes.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).toArrow()  # at most about draws * most_shards numbers
    sample = np.sort(picked["fp"].to_numpy()).view(np.uint64)
    tree, shards = fit_tree(np.random.default_rng(0).permutation(sample), leaves, radius)
    found = components(shard_links(nodes, tree, shards, radius))
    least = found.join(nodes, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = found.join(least, "root").select("fp", "component_id")
    by_node = staged(nodes.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "labels")
    return prints.join(by_node, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
