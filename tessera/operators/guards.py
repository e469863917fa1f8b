"""Guards inside the plan: a row that breaks a contract fails the job that reads it, so nothing is counted before.

Each guard is one expression over the rows it must see; where a join finds what is missing, keeping and failing are
decided in the same expression. The expression counts as non-deterministic, so the optimizer moves neither the guard
below the filters before it nor later filters below the guard: it judges just the rows it was given. Messages name the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _said(message: str, key: str | Column | None = None) -> Column:
    value = F.lit("") if key is None else F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    return F.raise_error(F.concat(F.lit(message), value))


def _judged(keep: Column) -> Column:
    """``keep``, in a place in the plan of its own."""
    return keep & (F.monotonically_increasing_id() >= 0)


def require(df: DataFrame, holds: Column, message: str, key: str | Column | None = None) -> DataFrame:
    """df; a row for which ``holds`` is false or unknown fails the job."""
    return df.filter(_judged(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(_said(message, key).cast("boolean"))))


def unique_rows(df: DataFrame, keys: list[str], message: str = "repeated key: ") -> DataFrame:
    """df; a null or repeated key fails the job. One shuffle on the key; a key's rows are counted as they stream, not held."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    filled = F.lit(True)
    for k in keys:
        filled = filled & F.col(k).isNotNull()
    return require(df.withColumn("_nth", nth), (F.col("_nth") == 1) & filled, message, F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).drop("_nth")


def exclude_set(universe: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows of the universe whose key is not excluded; an excluded key that the universe lacks fails the job. One full join."""
    out = excluded.select(F.col(key).alias("_x")).distinct().withColumn("_out", F.lit(True))
    both = universe.withColumn("_in", F.lit(True)).join(out, F.col(key).eqNullSafe(F.col("_x")), "full")
    keep = F.when(F.col("_in").isNull(), _said("excluded but not in the universe: ", "_x").cast("boolean")).otherwise(F.col("_out").isNull())
    return both.filter(_judged(keep)).drop("_in", "_out", "_x")


def cover(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """df; a key that ``expected`` has and df lacks, or the other way round, fails the job. One full join."""
    want = expected.select(F.col(key).alias("_x")).distinct().withColumn("_want", F.lit(True))
    both = df.withColumn("_in", F.lit(True)).join(want, F.col(key).eqNullSafe(F.col("_x")), "full")
    keep = F.when(F.col("_in").isNull(), _said("missing key: ", "_x").cast("boolean")).when(F.col("_want").isNull(), _said("unexpected key: ", key).cast("boolean")).otherwise(F.lit(True))
    return both.filter(_judged(keep)).drop("_in", "_want", "_x")


def of_length(text: Column, declared: Column, key: str) -> Column:
    """``text``; a length other than the declared one fails the job."""
    return F.when(F.length(text) == declared, text).otherwise(_said("length differs from the declared one: ", key))


def nested(df: DataFrame, flags: list[str], key: str) -> DataFrame:
    """df; a row whose later 0/1 flag is set without the one before fails the job. Whether levels differ is ``strict_nesting``."""
    out = df
    for outer, inner in zip(flags, flags[1:], strict=False):
        out = require(out, (F.col(inner) == 0) | (F.col(outer) == 1), f"{inner} outside {outer}: ", key)
    return out


def strict_nesting(df: DataFrame, flags: list[str], name: str) -> DataFrame:
    """A gate row (name, violations): rows outside the level before, and levels no smaller than the one before."""
    pairs = list(zip(flags, flags[1:], strict=False))
    outside = sum((F.count_if((F.col(b) == 1) & (F.col(a) != 1)) for a, b in pairs), F.lit(0))
    same = sum(((F.sum(b) >= F.sum(a)).cast("long") for a, b in pairs), F.lit(0))
    return df.agg(F.coalesce(outside + same, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")
