"""Column functions over sets, intervals and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import blank, col


def kmer_set(x: str | Column, k: int = 4, least_letters: int = 3) -> Column:
    """Distinct k-mers with at least so many distinct letters; empty for texts shorter than k."""
    text = blank(x)
    starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))), lambda m: F.size(F.array_distinct(F.filter(F.split(m, ""), lambda c: c != ""))) >= least_letters)


def containment(a: str | Column, b: str | Column) -> Column:
    """Shared share of the smaller set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.least(F.size(col(a)), F.size(col(b)))), F.lit(0.0))


def jaccard(a: str | Column, b: str | Column, empty: float = 0.0) -> Column:
    """Shared share of the union; ``empty`` if both sets are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))), F.lit(empty))


def length_ratio(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(F.least(col(a), col(b)), F.greatest(col(a), col(b))), F.lit(0.0))


def interval_iou(a: Column, a_length: Column, b: Column, b_length: Column) -> Column:
    """Overlap over hull of two intervals scaled by their lengths; 0 if a length is not positive."""
    lo = lambda i, n: (i["start"] - 1) / n
    hi = lambda i, n: i["end"] / n
    shared = F.greatest(F.least(hi(a, a_length), hi(b, b_length)) - F.greatest(lo(a, a_length), lo(b, b_length)), F.lit(0.0))
    hull = F.greatest(hi(a, a_length), hi(b, b_length)) - F.least(lo(a, a_length), lo(b, b_length))
    return F.when((a_length > 0) & (b_length > 0), F.coalesce(F.try_divide(shared, hull), F.lit(0.0))).otherwise(0.0)


def compare_architectures(left: str, right: str, threshold: float = 0.8) -> Column:
    """Struct (min_iou, reason) of two architectures, structs of status, source, ids, intervals, length; the first failing check names the reason."""
    a, b = F.col(left), F.col(right)
    ious = F.zip_with(a["intervals"], b["intervals"], lambda x, y: interval_iou(x, a["length"].cast("double"), y, b["length"].cast("double")))
    least = F.array_min(ious)
    reason = (
        F.when((F.coalesce(a["status"], F.lit("")) != "available") | (F.coalesce(b["status"], F.lit("")) != "available"), "missing")
        .when((F.size(a["ids"]) <= 0) | (F.size(b["ids"]) <= 0), "empty")
        .when(a["source"] != b["source"], "source_mismatch")
        .when(a["ids"] != b["ids"], "order_or_copy_mismatch")
        .when(F.size(a["intervals"]) != F.size(b["intervals"]), "coordinate_count_mismatch")
        .when(least < threshold, "low_overlap")
        .otherwise("pass")
    )
    return F.struct(F.when(reason.isin("low_overlap", "pass"), least).alias("min_iou"), reason.alias("reason"))


def functional_pass(event_jaccard: Column, event_shared: Column, first_jaccard: Column, first_shared: Column, weighted: Column, all_shared: Column) -> Column:
    """Struct (passed, reason): the first of three rules that holds."""
    said = lambda ok, reason: F.struct(F.lit(ok).alias("passed"), F.lit(reason).alias("reason"))
    return (
        F.when((event_jaccard >= 0.5) & (event_shared >= 1), said(True, "event"))
        .when((first_jaccard >= 0.5) & (first_shared >= 2), said(True, "first_set"))
        .when((weighted >= 0.25) & (all_shared >= 3), said(True, "weighted"))
        .otherwise(said(False, "none"))
    )
