"""Ranks, percentiles and top fractions without a single-partition window.

A global order is made by range partitioning; each range numbers its rows and adds the size of the ranges
before it (one number for each range). Percentiles come from counts by value, so ties cost nothing.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import staged


def ordered_index(df: DataFrame, *order: Column, name: str = "position", amount: Column | None = None) -> DataFrame:
    """df with its place (from 1) in a total order; with ``amount``, the running sum of it up to and including the row.

    Rows that tie in the whole order get different places, or the same running sum plus their own amount.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    size = F.count("*") if amount is None else F.sum(amount)
    sizes = ranged.groupBy("_range").agg(size.alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    local = Window.partitionBy("_range").orderBy(*order)
    own = F.row_number().over(local) if amount is None else F.sum(amount).over(local.rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def segment_sums(df: DataFrame, segment: list[str], order: list[Column], amounts: list[str], prefix: str = "upto_") -> DataFrame:
    """df with the running sum of each amount within its segment, up to and including the row, as ``upto_<amount>``.

    Rows are range-partitioned by segment and order together, so a segment may be of any size and many share a range.
    A range adds the sums that its first segment has in the ranges before; it is the only one that may have begun
    there, so what is carried is one row for each range. Rows that tie in the whole order are summed in any order.
    """
    ranged = staged(df.repartitionByRange(*segment, *order).withColumn("_range", F.spark_partition_id()), "segments")
    own = Window.partitionBy("_range", *segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*segment).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range", *segment).agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    carried = parts.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_seg_{c}") for c in segment], F.count("*").over(before).alias("_n"), *[F.sum(f"_sum_{a}").over(before).alias(f"_before_{a}") for a in amounts]).filter("_n > 0")  # a row for each range at most
    same = F.col("_range") == F.col("_at")
    for c in segment:
        same = same & F.col(c).eqNullSafe(F.col(f"_seg_{c}"))
    out = ranged.withColumns({f"{prefix}{a}": F.sum(a).over(own) for a in amounts}).join(F.broadcast(carried), same, "left")
    return out.select(*df.columns, *[(F.col(f"{prefix}{a}") + F.coalesce(f"_before_{a}", F.lit(0))).alias(f"{prefix}{a}") for a in amounts])


def value_ranks(df: DataFrame, value: str, descending: bool, n: int | None = None) -> DataFrame:
    """For each value (null last) its min-rank, the number of rows up to its end (max-rank), and all rows: value, rank, upto, n."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    counts = df.groupBy(value).agg(F.count("*").alias("_rows"))
    summed = ordered_index(counts, order, name="upto", amount=F.col("_rows"))
    total = summed.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))
    return summed.join(F.broadcast(total)).select(value, (F.col("upto") - F.col("_rows") + 1).alias("rank"), "upto", "n")  # total: one row


#: a value that more than a HOT-th of the rows have is hot; there are fewer than HOT
HOT = 1_000


def _with_ranks(df: DataFrame, value: str, descending: bool, base: DataFrame | None = None) -> DataFrame:
    """df with rank, upto and n of its value. Hot values (0 or null, as a rule) come by broadcast and their rows are then spread; the others meet by a join on the value."""
    ranks = staged(value_ranks(df if base is None else base, value, descending).withColumnRenamed(value, "_value"), "ranks")
    often = (F.col("upto") - F.col("rank") + 1) * HOT > F.col("n")
    hot = ranks.filter(often).select(F.col("_value").alias("_hot"), *[F.col(c).alias(f"_{c}") for c in ("rank", "upto", "n")])
    found = df.join(F.broadcast(hot), F.col(value).eqNullSafe(F.col("_hot")), "left")
    spread = found.withColumn("_salt", F.when(F.col("_rank").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(HOT)) + 1))
    cold = ranks.filter(~often).withColumn("_cold", F.lit(0).cast("long"))
    out = spread.join(cold, F.col(value).eqNullSafe(F.col("_value")) & (F.col("_salt") == F.col("_cold")), "left")
    return out.select(*df.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in ("rank", "upto", "n")])


def rank_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """1 for the highest value down to 0; ties share the best rank; missing values rank last."""
    share = 1 - (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return _with_ranks(df, value, True).withColumn(name, share).drop("rank", "upto", "n")


def positive_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of rows with at most this value; 0 where the value is not above 0 or missing."""
    filled = df.withColumn("_filled", F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType)))
    share = F.when(F.coalesce(F.col(value), F.lit(0)) <= 0, 0.0).otherwise(F.col("upto") / F.col("n"))
    return _with_ranks(filled, "_filled", False).withColumn(name, share).drop("rank", "upto", "n", "_filled")


def beneficial_percentile(df: DataFrame, value: str, name: str, higher_is_better: bool = True, zero_is_no_evidence: bool = False, base: DataFrame | None = None) -> DataFrame:
    """1 for the best value down to 0; missing values rank last, count in n and score 0; with one row 1.

    ``base``: the same rows, cheaper to read (a staged table), from which values are counted, so that several
    percentiles in a row do not each repeat the joins of those before.
    """
    share = F.when(F.col("n") <= 1, 1.0).when(F.col(value).isNull(), 0.0).otherwise(1 - (F.col("rank") - 1) / (F.col("n") - 1))
    if zero_is_no_evidence:
        share = F.when((F.col("n") > 1) & (F.col(value) <= 0), 0.0).otherwise(share)
    return _with_ranks(df, value, higher_is_better, base).withColumn(name, F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))).drop("rank", "upto", "n")


def fused_rank(df: DataFrame, percentiles: list[str], key: str, digits: int = 9) -> DataFrame:
    """Mean of percentiles as ``fused``, and ``position`` 1..n by fused, then each percentile, then key."""
    fused = F.round(sum((F.col(p) for p in percentiles), F.lit(0.0)) / len(percentiles), digits)
    return ordered_index(df.withColumn("fused", fused), F.desc("fused"), *[F.desc(p) for p in percentiles], F.asc(key))


def weighted_fusion(columns: list[str], weights: list[float]) -> Column:
    """Weighted mean, clipped to 0..1; missing counts as 0."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / sum(weights)))


def top_fraction(df: DataFrame, fraction: float, position: str = "position") -> DataFrame:
    """Rows whose position is at most ceil(n * fraction)."""
    n = df.count()
    return df.filter(F.col(position) <= ceil(round(n * fraction, 9)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by an explicit order. The last wins if the order is reversed."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def systematic_sample(df: DataFrame, order: list[Column], size: int = 32) -> DataFrame:
    """Rows at the positions round(i * (n - 1) / (size - 1)), i from 0, halves to even; all rows if fewer."""
    indexed = ordered_index(df, *order)
    n = indexed.agg(F.max("position")).first()[0] or 0
    wanted = sorted({round(i * (n - 1) / max(1, size - 1)) + 1 for i in range(size)} if n else set())
    return indexed.filter(F.col("position").isin(wanted))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a stable order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_k(df: DataFrame, by: list[str], value: str, order: list[str], k: int, name: str) -> DataFrame:
    """For each group its first k values by order, as an array; k rows of a group are listed, whatever its size.

    The rows are ranked first, so Spark keeps k of each group in every task before it shuffles.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.withColumn("_nth", nth).filter(F.col("_nth") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.col(value).alias("_v")))), lambda s: s["_v"])
    return first.groupBy(*by).agg(listed.alias(name))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in its group, by an order that leaves no ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def natural_key(x: Column) -> Column:
    """A sort key in which numbers inside a text order by value: digits padded to 20 places, letters in lower case."""
    padded = F.regexp_replace(F.regexp_replace(F.lower(x), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return padded
