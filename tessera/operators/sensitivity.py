"""Threshold grids, rule ablation, histograms and version summaries; empty cells stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.similarity import class_ends

#: what an edge between classes has for its ends
CLASS_ENDS = ("a", "b", "n_edges", "lo_a", "hi_a", "lo_b", "hi_b")


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """Every combination of a few threshold values."""
    rows: list[tuple] = [()]
    for values in axes.values():
        rows = [(*r, v) for r in rows for v in values]
    return spark.createDataFrame(rows, ", ".join(f"{a} double" for a in axes))


def endpoints(edges: DataFrame, a: str = "left_id", b: str = "right_id") -> Column:
    return F.explode(F.array(a, b))


def counted(passing: DataFrame, by: list[str], a: str, b: str, members: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(edges, distinct ids at their ends) by the columns ``by``. With ``members`` the edges are those of classes (``similarity.class_edges``) and are not listed."""
    if members is None:
        return passing.groupBy(*by).agg(F.count("*").alias("n_edges")), passing.select(*by, endpoints(passing, a, b).alias("id")).distinct().groupBy(*by).agg(F.count("*").alias("n_ids"))
    return passing.groupBy(*by).agg(F.sum("n_edges").alias("n_edges")), class_ends(passing, members, *by).groupBy(*by).agg(F.count_distinct("id").alias("n_ids"))


def threshold_grid(edges: DataFrame, cells: DataFrame, axes: dict[str, str], a: str = "left_id", b: str = "right_id", members: DataFrame | None = None) -> DataFrame:
    """For each cell: passing edges and distinct ids at their ends. An edge passes where every measure reaches its threshold.

    Edges are first counted at the highest thresholds they reach, so the grid meets cells, not edges: each edge
    is exploded to the cells it passes through a bounded array of all cells (a few dozen). With ``members`` the edges
    are those of classes: cells meet pairs of classes, and ids by their class.
    """
    names = list(axes)
    spark = edges.sparkSession
    values = [tuple(r) for r in cells.select(*names).collect()]  # the grid itself
    array = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, row, strict=True)]) for row in values])
    passing = edges.withColumn("_cell", F.explode(F.filter(array, lambda c: _all(F.col(m) >= c[n] for n, m in axes.items())))).select("_cell.*", *([a, b] if members is None else CLASS_ENDS))
    counts, ids = counted(passing, names, a, b, members)
    base = spark.createDataFrame(values, ", ".join(f"{n} double" for n in names))
    out = base.join(counts, names, "left").join(ids, names, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_edges", "n_ids")})


def _all(conditions) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def fraction_text(part: Column, whole: Column, digits: int = 8) -> Column:
    """part / whole with fixed digits, NA for an empty denominator."""
    return F.when(whole == 0, "NA").otherwise(F.format_string(f"%.{digits}f", part / whole))


def grid_fractions(cells: DataFrame, evaluated: DataFrame, eligible: DataFrame, count: str = "n_ids") -> DataFrame:
    """Grid cells with the share of their ids among all evaluated and among the eligible ones, as text; NA where there is none to take a share of. Both tables: a row for each id."""
    n = evaluated.agg(F.count("*").alias("evaluated")).join(F.broadcast(eligible.agg(F.count("*").alias("eligible"))))  # one row each
    found = cells.join(F.broadcast(n))
    return found.withColumns({"overall": fraction_text(F.col(count), F.col("evaluated")), "conditional": fraction_text(F.col(count), F.col("eligible"))})


def rule_ablation(edges: DataFrame, profiles: dict[str, Column], a: str = "left_id", b: str = "right_id", members: DataFrame | None = None) -> DataFrame:
    """profile, n_edges, n_ids: what each set of rules lets through; profiles without any stay with 0. With ``members`` the edges are those of classes."""
    spark = edges.sparkSession
    hits = F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in profiles.items()])))
    tall = edges.withColumn("profile", hits)
    counts, ids = counted(tall, ["profile"], a, b, members)
    base = spark.createDataFrame([(p,) for p in profiles], "profile string")
    return base.join(counts, "profile", "left").join(ids, "profile", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_edges", "n_ids")})


def best_per_endpoint(edges: DataFrame, score: str, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """id, best: the highest score of the edges at each id."""
    return edges.select(endpoints(edges, a, b).alias("id"), score).groupBy("id").agg(F.max(score).alias("best"))


def fixed_bins(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin (its lower end), n: counts in half-open bins, the last closed above only by infinity; zero bins stay."""
    bins = None
    for e in edges:
        bins = F.when(F.col(value) >= e, F.lit(float(e))) if bins is None else F.when(F.col(value) >= e, F.lit(float(e))).otherwise(bins)
    counts = values.withColumn("bin", bins).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    base = values.sparkSession.createDataFrame([(float(e),) for e in edges], "bin double")
    return base.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def set_jaccard_to(baseline: DataFrame, tall: DataFrame, cell: str, key: str) -> DataFrame:
    """cell, jaccard of its keys with the baseline keys; 1 if both are empty. tall: cell, key (null key: an empty cell)."""
    base = baseline.select(F.col(key)).distinct()
    n = base.agg(F.count("*").alias("_n"))
    rows = tall.select(cell, key).distinct().join(base.withColumn("_in", F.lit(1)), key, "left")
    sums = rows.groupBy(cell).agg(F.count(key).alias("_own"), F.coalesce(F.sum("_in"), F.lit(0)).alias("_both"))
    union = F.col("_own") + F.col("_n") - F.col("_both")
    return sums.join(F.broadcast(n)).select(cell, F.when(union == 0, 1.0).otherwise(F.col("_both") / union).alias("jaccard"))  # n: one row
