"""Data-quality gates: each returns a one-row DataFrame (name, violations); a receipt gathers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def unique_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a null or blank key, and rows beyond the first of a key."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    by = df.groupBy(key).agg(F.count("*").alias("n")).select(F.sum(F.when(blank, F.col("n")).otherwise(F.col("n") - 1)).alias("v"))
    return by.select(F.lit(name).alias("name"), F.coalesce("v", F.lit(0)).cast("long").alias("violations"))


def exact_cover(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of one side that the other lacks."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return _row(x.join(y, key, "left_anti").union(y.join(x, key, "left_anti")), name)


def complete(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Nulls in required columns."""
    total = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return df.agg(total.cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")


def composition(df: DataFrame, by: str, expected: DataFrame, name: str) -> DataFrame:
    """Classes whose count differs from the expected one (expected: the class, n); absent classes count 0."""
    found = df.groupBy(by).agg(F.count("*").alias("_found"))
    both = found.join(expected, by, "full")
    return _row(both.filter(F.coalesce("_found", F.lit(0)) != F.coalesce("n", F.lit(0))), name)


def disjoint(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    return _row(a.select(key).distinct().join(b.select(key), key, "left_semi"), name)


def subset(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of a that b lacks."""
    return _row(a.select(key).distinct().join(b.select(key), key, "left_anti"), name)


def rule(df: DataFrame, holds: Column, name: str) -> DataFrame:
    """Rows for which the rule is false or unknown."""
    return _row(df.filter(~F.coalesce(holds, F.lit(False))), name)


def equal_tables(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, order ignored."""
    return _row(a.exceptAll(b).union(b.exceptAll(a)), name)


def near_values(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float, name: str) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or that one side lacks."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    return _row(both.filter(~F.coalesce((F.abs(F.col("_a") - F.col("_b")) <= tolerance) | (F.col("_a").isNull() & F.col("_b").isNull()), F.lit(False))), name)


def same_order(a: DataFrame, b: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Keys whose place in the two orders differs, or that one side lacks."""
    both = a.select(key, F.col(position).alias("_a")).join(b.select(key, F.col(position).alias("_b")), key, "full")
    return _row(both.filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))), name)


def same_attributes(a: DataFrame, b: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Keys of both whose columns differ, null being equal to null."""
    other = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return _row(a.join(other, key).filter(~same), name)


def consecutive(df: DataFrame, position: str, name: str) -> DataFrame:
    """1 if the positions are not 1..n each once, else 0."""
    agg = df.agg(F.count("*").alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    bad = (F.col("n") != F.col("d")) | ((F.col("n") > 0) & ((F.col("lo") != 1) | (F.col("hi") != F.col("n"))))
    return agg.select(F.lit(name).alias("name"), bad.cast("long").alias("violations"))


def head_of_order(order: DataFrame, position: str, top: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Keys by which the first k of a full order and the top set differ."""
    return exact_cover(order.filter(F.col(position) <= k), top, key, name)


def locked(now: DataFrame, expected: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """Inputs whose content hash is not the expected one, or that one side lacks."""
    pair = now.select(key, F.col(digest).alias("_a")).join(expected.select(key, F.col(digest).alias("_b")), key, "full")
    return _row(pair.filter(~F.col("_a").eqNullSafe(F.col("_b"))), name)


def receipt(*checks: DataFrame) -> DataFrame:
    """name, violations, status PASS or FAIL of every check, and a row ALL."""
    rows = reduce(DataFrame.union, checks)
    total = rows.agg(F.lit("ALL").alias("name"), F.sum("violations").alias("violations"))
    return rows.union(total).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def fingerprint(df: DataFrame, name: str, key: str) -> DataFrame:
    """name, rows, keys, content: an order-insensitive hash of all values, for tables of any size."""
    values = F.xxhash64(*[F.col(c) if not isinstance(t, str) or not t.startswith("map") else F.to_json(c) for c, t in df.dtypes])
    return df.select(key, values.cast("decimal(38,0)").alias("_h")).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.coalesce(F.sum("_h"), F.lit(0)).cast("string").alias("content")).select(F.lit(name).alias("name"), "rows", "keys", "content")


def dataset_record(df: DataFrame, name: str, key: str, role: str, run: str) -> DataFrame:
    """The fingerprint of a data set with its role in a run (input, output...) and the run's id."""
    return fingerprint(df, name, key).select(F.lit(run).alias("run"), F.lit(role).alias("role"), "name", "rows", "keys", "content")


def changed(stored: DataFrame, now: DataFrame, name: str) -> DataFrame:
    """Fingerprints that differ from the stored ones, or that one side lacks."""
    return equal_tables(stored, now, name)
