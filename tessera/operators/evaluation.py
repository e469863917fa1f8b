"""Fold summaries, thresholds chosen on the other folds, and classification metrics without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rank import ordered_index, segment_sums


def fold_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("folds"))


def confusion(rows: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """keys, tp, fp, fn, tn."""
    return rows.groupBy(*keys).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and mcc; 0 where a denominator is 0."""
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    mcc = safe(d["tp"] * d["tn"] - d["fp"] * d["fn"], F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"])))
    return counts.withColumn("precision", safe(d["tp"], d["tp"] + d["fp"])).withColumn("recall", safe(d["tp"], d["tp"] + d["fn"])).withColumn("f1", safe(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"])).withColumn("mcc", mcc)


def best_thresholds(rows: DataFrame, fold: str, score: str, truth: str, grid: list[float]) -> DataFrame:
    """fold, threshold: of the grid, that of the highest MCC (rule score > t) on all other folds; ties take the lowest."""
    folds = rows.select(F.col(fold).alias("fold")).distinct()
    cells = F.array(*[F.lit(float(t)) for t in grid])
    y, over = F.col(truth) == 1, F.col(score) > F.col("threshold")
    counts = confusion(rows.withColumn("threshold", F.explode(cells)), [fold, "threshold"], y, over)
    totals = counts.groupBy("threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn", "tn")])
    own = counts.withColumnRenamed(fold, "fold")
    others = own.join(totals, "threshold").select("fold", "threshold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    best = F.struct(F.round("mcc", 9), -F.col("threshold"))
    return folds.join(rates(others).groupBy("fold").agg(F.max_by("threshold", best).alias("threshold")), "fold")


def roc_auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision, from counts by score."""
    by = rows.groupBy(score).agg(F.sum(F.col(truth)).cast("double").alias("p"), (F.count("*") - F.sum(F.col(truth))).cast("double").alias("q"))
    up = ordered_index(by, F.desc(score), name="n_upto", amount=F.col("p") + F.col("q"))
    tp = ordered_index(up, F.desc(score), name="tp_upto", amount=F.col("p"))
    ahead = F.col("tp_upto") - F.col("p")
    parts = tp.agg(F.sum((ahead + F.col("p") / 2) * F.col("q")).alias("area"), F.sum(F.col("tp_upto") / F.col("n_upto") * F.col("p")).alias("ap"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return parts.select(F.try_divide(F.col("area"), F.col("np") * F.col("nq")).alias("roc_auc"), F.try_divide(F.col("ap"), F.col("np")).alias("pr_auc"))


COUNTS = ("tp", "fp", "fn", "tn")


def exact_thresholds(rows: DataFrame, segment: list[str], fold: str, score: str, truth: str, digits: int = 9) -> DataFrame:
    """segment, fold, threshold: of all distinct scores of the other folds, the one of highest MCC on them (rule score > t).

    ``segment`` names the columns that are calibrated apart (label, model...). MCCs are compared to ``digits`` digits;
    ties take the lowest threshold. Rows are first counted by (segment, fold, score); each count then goes to the
    folds that are not its own (folds are few), and running sums within (segment, left-out fold) by falling score
    give the confusion of every threshold. No segment, fold or score is held by one task.
    """
    counts = rows.groupBy(*segment, F.col(fold).alias("_own"), F.col(score).alias("threshold")).agg(F.sum(F.col(truth)).cast("long").alias("p"), (F.count("*") - F.sum(F.col(truth))).cast("long").alias("q"))
    folds = rows.groupBy(*segment).agg(F.collect_set(fold).alias("_folds"))  # a few numbers for each segment
    other = counts.join(folds, segment).withColumn(fold, F.explode(F.array_remove("_folds", F.col("_own"))))
    cells = other.groupBy(*segment, fold, "threshold").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    summed = segment_sums(cells, [*segment, fold], [F.desc("threshold")], ["p", "q"])
    totals = cells.groupBy(*segment, fold).agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    tp, fp = F.col("upto_p") - F.col("p"), F.col("upto_q") - F.col("q")  # those above the threshold itself
    said = summed.join(totals, [*segment, fold]).select(*segment, fold, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("_p") - tp).alias("fn"), (F.col("_q") - fp).alias("tn"))
    best = F.struct(F.round("mcc", digits), -F.col("threshold"))
    return rates(said).groupBy(*segment, fold).agg(F.max_by("threshold", best).alias("threshold"))


def fold_metrics(rows: DataFrame, thresholds: DataFrame, segment: list[str], fold: str, score: str, truth: str) -> DataFrame:
    """segment, fold, threshold, the confusion and the rates of each fold at the threshold that the others chose."""
    keys = [*segment, fold]
    counts = confusion(rows.join(thresholds, keys), [*keys, "threshold"], F.col(truth) == 1, F.col(score) > F.col("threshold"))
    return rates(counts)


def averaged_f1(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, micro_f1 (of the summed confusion of all labels) and macro_f1 (the mean of the labels' F1)."""
    sums = metrics.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], F.avg("f1").alias("macro_f1"))
    return sums.select(*keys, F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("micro_f1"), "macro_f1")


def ranking_by(rows: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """keys, roc_auc (ties count half) and pr_auc (average precision) of each group, from counts by score; null without both classes (or without a positive one)."""
    by = rows.groupBy(*keys, score).agg(F.sum(F.col(truth)).cast("double").alias("p"), (F.count("*") - F.sum(F.col(truth))).cast("double").alias("q"))
    up = segment_sums(by, keys, [F.desc(score)], ["p", "q"])
    ahead, above = F.col("upto_p") - F.col("p"), F.col("upto_p") + F.col("upto_q")
    parts = up.groupBy(*keys).agg(F.sum((ahead + F.col("p") / 2) * F.col("q")).alias("area"), F.sum(F.col("upto_p") / above * F.col("p")).alias("ap"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return parts.select(*keys, F.try_divide(F.col("area"), F.col("np") * F.col("nq")).alias("roc_auc"), F.try_divide(F.col("ap"), F.col("np")).alias("pr_auc"))


def model_comparison(values: DataFrame, metric: str, model: str, value: str, base: str, other: str) -> DataFrame:
    """metric, mean and population standard deviation of both models over the folds, and the difference of the means in percentage points."""
    side = lambda name: F.col(model) == name
    aggregates = [f(F.when(side(m), F.col(value))).alias(f"{at}_{n}") for at, m in (("base", base), ("other", other)) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return values.groupBy(metric).agg(*aggregates).withColumn("difference_pp", 100 * (F.col("other_mean") - F.col("base_mean")))
