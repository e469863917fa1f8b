"""Bounded proximity over bipartite and directed graphs: unrolled frontier joins, never pairs within a term."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rank import first_k, first_per_key, ordered_index
from tessera.sources.tables import staged


def term_statistics(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """term, degree, seed_count, and its path weight 1 + ln(1 + degree) / ln(1 + N), N being the entities of all pairs.

    pairs: distinct (entity, term); seeds: entity.
    """
    tagged = pairs.join(seeds.select("entity").distinct().withColumn("_seed", F.lit(1)), "entity", "left")
    n = pairs.agg(F.count_distinct("entity").alias("n"))
    terms = tagged.groupBy("term").agg(F.count("*").alias("degree"), F.coalesce(F.sum("_seed"), F.lit(0)).alias("seed_count"))
    return terms.join(F.broadcast(n)).withColumn("weight", 1 + F.log1p("degree") / F.log1p("n"))  # n: one row


def seed_distance(pairs: DataFrame, terms: DataFrame, seeds: DataFrame, cutoff: float = 6.0) -> DataFrame:
    """entity, distance: the least weighted way to a seed through shared terms, within the cutoff.

    A way from entity to entity crosses a term twice and so costs over 2; floor(cutoff / 2) rounds less one at a
    tie are exact. Each round is a min by term and a min by entity.
    """
    best = seeds.select("entity").distinct().withColumn("distance", F.lit(0.0))
    weighted = pairs.join(terms.select("term", "weight"), "term")
    rounds = floor(cutoff / 2) - (cutoff % 2 == 0)
    for _ in range(rounds):
        at_term = weighted.join(best, "entity").groupBy("term").agg(F.min(F.col("distance") + F.col("weight")).alias("_d"))
        step = weighted.join(at_term, "term").groupBy("entity").agg(F.min(F.col("_d") + F.col("weight")).alias("distance")).filter(F.col("distance") <= cutoff)
        best = best.union(step).groupBy("entity").agg(F.min("distance").alias("distance"))
    return best


def shared_seed_weight(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """entity, shared: sum over its terms of seeds / others * max(0, ln((1 + N) / (1 + others))), the entity itself left out.

    For entities that are no seeds, so that only the degree loses one.
    """
    others = F.col("degree") - 1
    part = F.when(others > 0, F.col("seed_count") / others * F.greatest(F.lit(0.0), F.log((1 + F.col("n")) / (1 + others)))).otherwise(0.0)
    return pairs.join(terms, "term").groupBy("entity").agg(F.sum(part).alias("shared"))


def directed_edges(rows: DataFrame, a: str, b: str, order: str, keep: Column | None = None) -> DataFrame:
    """source, target, first_order, and the last row's attributes; rows failing ``keep`` or with a blank end go."""
    good = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    good = good if keep is None else good.filter(keep)
    first = good.groupBy(a, b).agg(F.min(order).alias("first_order"))
    last = first_per_key(good, [a, b], [F.desc(order)])
    return last.join(first, [a, b]).withColumnRenamed(a, "source").withColumnRenamed(b, "target")


def hops_to_seed(edges: DataFrame, seeds: DataFrame, limit: int = 4) -> DataFrame:
    """node, hops: the fewest directed steps to a seed, up to ``limit``; a seed has 0."""
    back = edges.select("source", "target").distinct()
    found = seeds.select(F.col("node")).distinct().withColumn("hops", F.lit(0))
    frontier = found.select("node")
    for k in range(1, limit + 1):
        frontier = staged(back.join(frontier, F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("node")).distinct().join(found, "node", "left_anti"), "frontier")
        found = found.union(frontier.withColumn("hops", F.lit(k)))
    return found


def reachable_seeds(edges: DataFrame, origins: DataFrame, seeds: DataFrame, limit: int = 3) -> DataFrame:
    """node, reach: how many other seeds each origin reaches in at most ``limit`` directed steps; origins with none are absent.

    The search goes backwards from the seeds, so the rows kept are (node, seed it reaches) and nothing else.
    """
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("_before")).distinct()
    seen = seeds.select(F.col("node").alias("at"), F.col("node").alias("seed")).distinct()
    frontier = seen
    for _ in range(limit):
        frontier = staged(frontier.join(back, "at").select(F.col("_before").alias("at"), "seed").distinct().join(seen, ["at", "seed"], "left_anti"), "reach")
        seen = seen.union(frontier)
    reached = seen.filter("at <> seed").select(F.col("at").alias("node"), "seed")
    return reached.join(origins.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.count("*").alias("reach"))


def first_steps(edges: DataFrame, k: int = 8) -> DataFrame:
    """node, out_edges, first_targets: the first k distinct targets by first insertion."""
    degree = edges.groupBy("source").agg(F.count("*").alias("out_edges"))
    first = first_k(edges.select("source", "first_order", "target"), ["source"], "target", ["first_order", "target"], k, "_first")
    return degree.join(first, "source").select(F.col("source").alias("node"), "out_edges", F.array_join(F.transform("_first", lambda t: t.cast("string")), ";").alias("first_targets"))


def neighbourhood(edges: DataFrame, focus: DataFrame, hops: int = 1) -> DataFrame:
    """node, hop: nodes within 1 or 2 undirected steps of the focus nodes."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).union(edges.select("target", "source")).distinct()
    found = focus.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = found.select("node")
    for k in range(1, hops + 1):
        frontier = both.join(frontier, "node", "left_semi").select(F.col("_next").alias("node")).distinct().join(found, "node", "left_anti")
        found = found.union(frontier.withColumn("hop", F.lit(k)))
    return found


def within_budget(rows: DataFrame, cell: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows by the columns ``cell`` (ascending), then ``order``; all without a limit.

    Rows are counted by cell first; whole cells are kept up to the one in which the limit falls, and only
    that one's rows are ordered.
    """
    if limit is None:
        return rows
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    upto = staged(ordered_index(sizes, *map(F.asc, cell), name="_upto", amount=F.col("_n")), "cells")
    last = upto.filter(F.col("_upto") >= limit).orderBy("_upto").limit(1).collect()  # the cell in which the limit falls
    if not last:
        return rows
    edge = F.struct(*cell) == F.struct(*[F.lit(last[0][c]).cast(rows.schema[c].dataType).alias(c) for c in cell])
    before = F.struct(*cell) < F.struct(*[F.lit(last[0][c]).cast(rows.schema[c].dataType).alias(c) for c in cell])
    rest = limit - (last[0]["_upto"] - last[0]["_n"])
    return rows.filter(before).unionByName(rows.filter(edge).orderBy(*order).limit(rest))


def explored(edges: DataFrame, focus: DataFrame, hops: int = 1, nodes: int | None = 150, links: int | None = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, totals) around the focus: node, hop, degree; source, target; available_nodes, available_links, limited.

    Nodes nearer to the focus come first, then those with more links among all that are available, then by id; links
    between kept nodes come by the hops of their ends, then by their ids. None lifts a limit.
    """
    near = staged(neighbourhood(edges, focus, hops), "near")
    pair = edges.select("source", "target").distinct()
    side = lambda end: near.select(F.col("node").alias(end), F.col("hop").alias(f"_{end}"))
    inside = staged(pair.join(side("source"), "source").join(side("target"), "target"), "links")
    degree = inside.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = near.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).withColumn("_less", -F.col("degree"))
    kept = staged(within_budget(ranked, ["hop", "_less"], [F.asc("node")], nodes).drop("_less"), "kept")
    only = lambda end: kept.select(F.col("node").alias(end))
    linked = inside.join(only("source"), "source", "left_semi").join(only("target"), "target", "left_semi")
    linked = linked.select("source", "target", F.greatest("_source", "_target").alias("_far"), F.least("_source", "_target").alias("_near"))
    shown = within_budget(linked, ["_far", "_near"], [F.asc("source"), F.asc("target")], links).select("source", "target")
    totals = near.agg(F.count("*").alias("available_nodes")).join(F.broadcast(inside.agg(F.count("*").alias("available_links"))))  # one row each
    over = F.lit(False) if nodes is None else F.col("available_nodes") > nodes
    return kept, shown, totals.withColumn("limited", over | (F.lit(False) if links is None else F.col("available_links") > links))


def shortest_paths(edges: DataFrame, origins: DataFrame, targets: DataFrame, limit: int = 4) -> DataFrame:
    """node, status, hops, path: the directed shortest way to the nearest target, the least of equals; -1 and '' without one.

    The search goes backwards from the targets, a step a round; a node keeps the least of its shortest ways (its own
    id before the least way of a next node), so there is one row for each node that reaches a target.
    """
    steps = edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).distinct()
    found = targets.select("node").distinct().withColumn("path", F.array("node"))
    frontier = found
    for _ in range(limit):
        ways = steps.join(frontier.select(F.col("node").alias("_next"), "path"), "_next").join(found.select("node"), "node", "left_anti")
        frontier = staged(ways.groupBy("node").agg(F.min("path").alias("_least")).select("node", F.concat(F.array("node"), "_least").alias("path")), "paths")
        found = found.union(frontier)
    out = origins.select("node").distinct().join(found, "node", "left")
    return out.select("node", F.when(F.col("path").isNull(), "NO_REACHABLE_ANCHOR").otherwise("FOUND").alias("status"), (F.size("path") - 1).cast("long").alias("hops"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")).withColumns({"hops": F.when(F.col("status") == "FOUND", F.col("hops")).otherwise(-1), "path": F.coalesce("path", F.lit(""))})


def graph_statistics(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """metric, value: nodes, edges, seeds in the graph."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return one(nodes, "nodes").union(one(edges.select("source", "target").distinct(), "edges")).union(one(nodes.join(seeds.select("node").distinct(), "node", "left_semi"), "seeds"))
