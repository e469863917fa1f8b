"""Folds, thresholds and metrics over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.plans.registry import query
from tessera.sources.tables import staged, table

GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
SCORED_SQL = """x as (select l.doc_id, l.doc_id % 5 as fold, cast(max(quality) as bigint) as y, round(least(1, max(n_chars) / 5000.0), 6) as score from labels l join documents d on l.doc_id = d.doc_id group by 1)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy("doc_id").agg(F.max("quality").cast("long").alias("y"), F.round(F.least(F.lit(1.0), F.max("n_chars") / F.lit(5000.0)), 6).alias("score")).withColumn("fold", F.col("doc_id") % 5)


@query(f"with {SCORED_SQL}, f as (select fold, y, avg(score) as m from x group by 1, 2) select y, round(avg(m), 9) as mean, round(stddev_pop(m), 9) as std, count(*) as folds from f group by 1")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population standard deviation over folds."""
    f = scored(spark, sf_dir).groupBy("fold", "y").agg(F.avg("score").alias("m"))
    return evaluation.fold_summary(f, ["y"], "m").withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query(f"""with {SCORED_SQL}, g as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as threshold), fs as (select distinct fold from x),
c as (select fs.fold, cast(g.threshold as double) as threshold, cast(sum(case when y = 1 and score > threshold then 1 else 0 end) as double) as tp, cast(sum(case when y = 0 and score > threshold then 1 else 0 end) as double) as fp,
  cast(sum(case when y = 1 and not score > threshold then 1 else 0 end) as double) as fn, cast(sum(case when y = 0 and not score > threshold then 1 else 0 end) as double) as tn from fs join x on x.fold <> fs.fold, g group by 1, 2),
m as (select *, case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end as mcc from c),
b as (select fold, threshold, row_number() over (partition by fold order by round(mcc, 9) desc, threshold) as nth from m),
own as (select x.fold, b.threshold, sum(case when y = 1 and score > threshold then 1 else 0 end)::bigint as tp, sum(case when y = 0 and score > threshold then 1 else 0 end)::bigint as fp, sum(case when y = 1 and not score > threshold then 1 else 0 end)::bigint as fn,
  sum(case when y = 0 and not score > threshold then 1 else 0 end)::bigint as tn from x join b on x.fold = b.fold and nth = 1 group by 1, 2)
select fold, threshold, tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end, 9) as "precision", round(case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end, 9) as recall from own""")
def fold_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold for each fold from the others, and the fold's counts and rates at it."""
    x = scored(spark, sf_dir)
    t = evaluation.best_thresholds(x, "fold", "score", "y", GRID)
    counts = evaluation.confusion(x.join(t, "fold"), ["fold", "threshold"], F.col("y") == 1, F.col("score") > F.col("threshold"))
    return evaluation.rates(counts).select("fold", "threshold", "tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""with {SCORED_SQL}, pairs as (select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) as area, count(*) as n from (select score from x where y = 1) a, (select score from x where y = 0) b),
v as (select score, cast(sum(y) as double) as p, cast(count(*) as double) as c from x group by 1), u as (select *, sum(p) over (order by score desc) as tp, sum(c) over (order by score desc) as n from v)
select round(cast(area as double) / n, 6) as roc_auc, round((select sum(tp / u.n * p) / sum(p) from u), 6) as pr_auc from pairs""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve and average precision."""
    return evaluation.roc_auc(scored(spark, sf_dir), "score", "y").select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


#: two models score three labels of every labelled document: by length, and by the share of letters
MODELS_SQL = """d as (select l.doc_id, l.doc_id % 5 as fold, max(quality)::bigint as quality, max(toxic)::bigint as toxic, max(cast(coalesce(lang, '') = 'en' as bigint)) as english, max(coalesce(length(text), 0)) as n,
  max(coalesce(length(regexp_replace(text, '[^a-z]', '', 'g')), 0)) as letters from labels l join documents d on l.doc_id = d.doc_id group by 1),
m as (select *, 'length' as model, round(least(1, n / 5000.0::double), 6) as score from d union all select *, 'letters', round(letters / greatest(n, 1)::double, 6) from d),
x as (select doc_id, fold, model, 'quality' as label, quality as y, score from m union all select doc_id, fold, model, 'toxic', toxic, score from m union all select doc_id, fold, model, 'english', english, score from m)"""

EXACT_SQL = f"""{MODELS_SQL}, fs as (select distinct model, label, fold from x),
o as (select fs.model, fs.label, fs.fold, score as threshold, sum(y) as p, count(*) - sum(y) as q from fs join x on x.model = fs.model and x.label = fs.label and x.fold <> fs.fold group by all),
r as (select *, sum(p) over w as up, sum(q) over w as uq, sum(p) over g as np, sum(q) over g as nq from o window w as (partition by model, label, fold order by threshold desc), g as (partition by model, label, fold)),
c as (select model, label, fold, threshold, (up - p)::double as tp, (uq - q)::double as fp, (np - up + p)::double as fn, (nq - uq + q)::double as tn from r),
b as (select model, label, fold, threshold, row_number() over (partition by model, label, fold order by round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end, 9) desc, threshold) as nth from c),
own as (select model, label, x.fold, threshold, count(*) filter (y = 1 and score > threshold)::double as tp, count(*) filter (y = 0 and score > threshold)::double as fp, count(*) filter (y = 1 and score <= threshold)::double as fn, count(*) filter (y = 0 and score <= threshold)::double as tn from x join b using (model, label, fold) where nth = 1 group by all),
fm as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as "precision", case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1,
  case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end as mcc from own)"""


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fold, model, label, y, score: two models by three labels."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).cast("long").alias("english"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.coalesce(F.length(F.regexp_replace("text", "[^a-z]", "")), F.lit(0)).alias("letters"))
    d = table(spark, sf_dir, "labels").join(text, "doc_id").groupBy("doc_id").agg(*[F.max(c).cast("long").alias(c) for c in ("quality", "toxic", "english", "n", "letters")])
    models = F.explode(F.array(F.struct(F.lit("length").alias("model"), F.round(F.least(F.lit(1.0), F.col("n") / F.lit(5000.0)), 6).alias("score")), F.struct(F.lit("letters").alias("model"), F.round(F.col("letters") / F.greatest("n", F.lit(1)), 6).alias("score"))))
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in ("quality", "toxic", "english")]))
    tall = d.select("doc_id", (F.col("doc_id") % 5).alias("fold"), "quality", "toxic", "english", models.alias("m")).select("doc_id", "fold", "m.*", labels.alias("l"))
    return tall.select("doc_id", "fold", "model", "l.label", "l.y", "score")


def calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scored rows, and the metrics of each (model, label, fold) at the threshold of the other folds."""
    x = staged(labelled_scores(spark, sf_dir), "scores")
    t = evaluation.exact_thresholds(x, ["model", "label"], "fold", "score", "y")
    return x, evaluation.fold_metrics(x, t, ["model", "label"], "fold", "score", "y")


@query(f"with {EXACT_SQL} select model, label, fold, threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(\"precision\", 9) as \"precision\", round(recall, 9) as recall, round(f1, 9) as f1, round(mcc, 9) as mcc from fm")
def exact_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model, label and fold the threshold of highest MCC among all scores of the other folds, and the fold's own metrics at it."""
    _, metrics = calibrated(spark, sf_dir)
    return metrics.select("model", "label", "fold", "threshold", *evaluation.COUNTS, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mcc")])


@query(f"""with {EXACT_SQL}, v as (select v.score, x.model, x.label, x.fold, sum(x.y) as p, count(*) - sum(x.y) as q from x join (select distinct model, label, fold, score from x) v using (model, label, fold, score) group by all),
u as (select *, sum(p) over w as up, sum(q) over w as uq from v window w as (partition by model, label, fold order by score desc)),
auc as (select model, label, fold, sum((up - p + p / 2.0::double) * q) as area, sum(up / (up + uq)::double * p) as ap, sum(p) as np, sum(q) as nq from u group by all),
f as (select model, fold, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) as micro, avg(f1) as macro from fm group by all),
w as (select model, fold, 'micro_f1' as metric, coalesce(micro, 0) as value from f union all select model, fold, 'macro_f1', macro from f
  union all select model, fold, label || '_' || k, v from (select model, fold, label, unnest(['precision', 'recall', 'f1', 'mcc']) as k, unnest(["precision", recall, f1, mcc]) as v from fm)
  union all select model, fold, label || '_roc_auc', case when np * nq > 0 then area / (np * nq) end from auc union all select model, fold, label || '_pr_auc', case when np > 0 then ap / np end from auc)
select metric, round(avg(value) filter (model = 'length'), 6) as base_mean, round(stddev_pop(value) filter (model = 'length'), 6) as base_std, round(avg(value) filter (model = 'letters'), 6) as other_mean, round(stddev_pop(value) filter (model = 'letters'), 6) as other_std,
 round(100 * (avg(value) filter (model = 'letters') - avg(value) filter (model = 'length')), 6) as difference_pp from w group by 1""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a five-fold comparison of two models: micro and macro F1, and for each label precision, recall, F1, MCC and both areas."""
    x, metrics = calibrated(spark, sf_dir)
    metrics = staged(metrics, "metrics")
    unpivot = lambda df, name, columns: df.select("model", "fold", F.explode(F.array(*[F.struct(name(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("m")).select("model", "fold", "m.*")
    by_label = lambda c: F.concat("label", F.lit(f"_{c}"))
    both = unpivot(evaluation.averaged_f1(metrics, ["model", "fold"]), F.lit, ["micro_f1", "macro_f1"])
    rates = unpivot(metrics, by_label, ["precision", "recall", "f1", "mcc"])
    areas = unpivot(evaluation.ranking_by(x, ["model", "label", "fold"], "score", "y"), by_label, ["roc_auc", "pr_auc"])
    found = evaluation.model_comparison(both.union(rates).union(areas), "metric", "model", "value", "length", "letters")
    return found.select("metric", *[F.round(c, 6).alias(c) for c in found.columns if c != "metric"])
