"""Filters with reasons, labelled universes, case audits, grouped extensions, agreement between summary and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, joined
from tessera.operators import guards
from tessera.operators.rank import first_per_key

#: The evidence codes that count as experimental.
EXPERIMENTAL = ("EXP", "IDA", "IMP", "IGI")


def project(df: DataFrame, front: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed, the front ones first, the rest kept in order."""
    out = df.withColumnsRenamed(rename or {})
    return out.select(*front, *[c for c in out.columns if c not in front])


def partition_fields(df: DataFrame, in_a: Column, evidence: Column, version: str) -> DataFrame:
    """df with its class A or B, a 0/1 flag, the joined evidence text and the rule's version."""
    flag = F.coalesce(in_a, F.lit(False))
    return df.withColumns({"partition_class": F.when(flag, "A").otherwise("B"), "partition_flag": flag.cast("int"), "partition_evidence": joined(evidence), "rule_version": F.lit(version)})


def evidence_code(code: str, qualifier: str, disallowed: tuple[str, ...] = ("NOT",), allowed: tuple[str, ...] = EXPERIMENTAL) -> Column:
    """'include', or why not; a disallowed qualifier wins over the code. Qualifiers are separated by '|'."""
    bad = F.arrays_overlap(F.transform(F.split(blank(qualifier), r"\|"), lambda q: F.upper(F.trim(q))), F.array(*map(F.lit, disallowed)))
    return F.when(bad, "disallowed_qualifier").when(~F.upper(blank(code)).isin(*allowed), "code_not_allowed").otherwise("include")


def event_filter(df: DataFrame, inferred: str, disease: str, species: str, wanted: str) -> DataFrame:
    """Rows that are neither inferred nor of disease and are of the wanted species; a null flag counts as false."""
    return df.filter(~F.coalesce(F.col(inferred), F.lit(False)) & ~F.coalesce(F.col(disease), F.lit(False)) & (F.col(species) == wanted))


def edge_rows(edges: DataFrame, a: str, b: str, universe: DataFrame, key: str, directed: str | None = None, prefix: str = "COMPLEX:") -> DataFrame:
    """Edges without blank ends, prefixed ends, ends outside the universe or the direction text 'False' (a missing column counts as True)."""
    out = edges
    for end in (a, b):
        out = out.filter((blank(end) != "") & ~blank(end).startswith(prefix)).join(universe.select(F.col(key).alias("_u")).distinct(), F.col(end) == F.col("_u"), "left_semi")
    return out.filter(blank(directed) != "False") if directed in edges.columns else out


def universe_with_labels(screens: dict[str, DataFrame], key: str, passed: str, reference: DataFrame) -> DataFrame:
    """The union of screens with their route and label (seed or failure), joined with a reference; repeated keys are counted in ``n_rows``."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(route).alias("route"), F.when(F.col(passed) == "yes", "seed").otherwise("failure").alias("label")) for route, df in screens.items()])
    merged = rows.groupBy(key).agg(joined(F.collect_set("route")).alias("routes"), F.when(F.max((F.col("label") == "seed").cast("int")) == 1, "seed").otherwise("failure").alias("label"), F.count("*").alias("n_rows"))
    return merged.join(reference, key, "left")


def labelled_universe(screens: dict[str, DataFrame], key: str, passed: str, reference: DataFrame) -> DataFrame:
    """key, route, label (seed or failure) and the reference's columns; a key in two screens, twice in one, or absent from the reference fails the job."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(route).alias("route"), F.when(F.col(passed) == "yes", "seed").otherwise("failure").alias("label")) for route, df in screens.items()])
    once = guards.unique_rows(rows, [key], "in two screens or twice in one: ")
    found = once.join(reference.withColumn("_there", F.lit(True)), key, "left")
    return guards.require(found.withColumn("_ok", F.col("_there").isNotNull() & F.col("route").isNotNull()), F.col("_ok"), "not in the reference: ", key).drop("_there", "_ok")


def case_audit(targets: DataFrame, key: str, universe: DataFrame, extended: DataFrame, edges: DataFrame, priorities: list[str], order: str) -> DataFrame:
    """Each target's status (pass, extended, not_extended, not_in_universe) and its best edge by boolean priorities, input order last."""
    best = first_per_key(edges, [key], [*[F.desc(p) for p in priorities], F.asc(order)])
    out = targets.select(key).distinct().join(universe.select(key, "label"), key, "left").join(extended.select(key).distinct().withColumn("_x", F.lit(True)), key, "left").join(best, key, "left")
    status = F.when(F.col("label").isNull(), "not_in_universe").when(F.col("label") == "seed", "pass").when(F.col("_x"), "extended").otherwise("not_extended")
    return out.withColumn("status", status).drop("_x", "label")


def group_by_seed(rows: DataFrame, seed: str, candidate: str) -> DataFrame:
    """Members with their place in the group of their best seed and the group's size; rows stay rows, so a group may be of any size."""
    sizes = rows.groupBy(seed).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(seed).orderBy(candidate))
    return rows.select(seed, candidate).withColumn("place", place).join(sizes, seed)


def evidence_sets(rows: DataFrame, entity: str, item: str, aspect: str, included: Column, aspects: list[str]) -> DataFrame:
    """entity with, for each aspect, its distinct included items as sorted text (``<aspect>_items``) and their number.

    An entity's items of an aspect must be bounded (annotation ids).
    """
    own = rows.filter(F.coalesce(included, F.lit(False)))
    every = rows.select(entity).distinct()
    sets = [F.collect_set(F.when(F.col(aspect) == a, F.col(item).cast("string"))).alias(a) for a in aspects]
    out = every.join(own.groupBy(entity).agg(*sets), entity, "left")
    none = F.array().cast("array<string>")
    return out.select(entity, *[joined(F.coalesce(a, none)).alias(f"{a}_items") for a in aspects], *[F.size(F.coalesce(a, none)).cast("long").alias(f"n_{a}") for a in aspects])


def pair_coverage(pairs: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose (route, candidate) the candidate table lacks; should be empty."""
    return pairs.join(candidates.select(*keys).distinct(), keys, "left_anti")


def uncovered_pairs(counts: DataFrame, candidates: DataFrame, keys: list[str], count: str) -> DataFrame:
    """missing_pairs: the number of pairs that ``pair_coverage`` finds, of a table of each candidate's number of pairs (one row)."""
    rest = counts.join(candidates.select(*keys).distinct(), keys, "left_anti")
    return rest.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("missing_pairs"))


def subset_disagreements(counts: DataFrame, subset: DataFrame, key: str, count: str) -> DataFrame:
    """Candidates whose anchors differ from those of a part of the same evidence: then, and only then, their numbers differ."""
    part = subset.select(key, F.col(count).alias("_own"))
    return counts.select(key, count).join(part, key, "left").filter(F.col(count) != F.coalesce("_own", F.lit(0)))


def summary_disagreements(summary: DataFrame, detail: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose summary count differs from the number of detail rows; a missing side counts 0."""
    n = detail.groupBy(key).agg(F.count("*").alias("_n"))
    return summary.select(key, count).join(n, key, "full").filter(F.coalesce(F.col(count), F.lit(0)) != F.coalesce(F.col("_n"), F.lit(0)))


def pair_disagreements(candidates: DataFrame, pairs: DataFrame, key: str, anchors: str, anchor: str) -> DataFrame:
    """Candidates whose anchor text (sorted, ';') differs from the set of anchors in the pair table."""
    own = pairs.groupBy(key).agg(joined(F.collect_set(F.col(anchor).cast("string"))).alias("_own"))
    return candidates.select(key, anchors).join(own, key, "full").filter(F.coalesce(F.col(anchors), F.lit("")) != F.coalesce("_own", F.lit("")))
