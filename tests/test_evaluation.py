"""Exact thresholds, segmented sums and grouped areas against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import evaluation, rank
from tessera.operators.rank import segment_sums


@pytest.mark.parametrize("n, groups", [(0, 1), (1, 1), (300, 1), (300, 7), (60, 60)])
def test_segment_sums(spark, n, groups):
    """A segment over many ranges and many segments in one range."""
    rng = random.Random(n + groups)
    rows = [(None if (g := rng.randrange(groups)) == 3 else g, i, rng.randint(-5, 9), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, v long, one long").repartition(5)
    want = {}
    total = {}
    for g, i, v, _ in sorted(rows, key=lambda r: -r[1]):
        a, b = total.get(g, (0, 0))
        total[g] = want[i] = (a + v, b + 1)
    got = segment_sums(df, ["g"], [F.desc("i")], ["v", "one"])
    assert got.columns == ["g", "i", "v", "one", "upto_v", "upto_one"]
    assert {r.i: (r.upto_v, r.upto_one) for r in got.collect()} == want


def counts(rows, t):
    tp, fp, fn, tn = (sum(c) for c in zip(*((y == 1 and s > t, y == 0 and s > t, y == 1 and s <= t, y == 0 and s <= t) for _, _, s, y in rows), strict=True)) if rows else (0, 0, 0, 0)
    return tp, fp, fn, tn


def mcc(tp, fp, fn, tn):
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / math.sqrt(d) if d else 0.0


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(5)
    rows = [(label, i % 4, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.3))), 2), y) for label in ("a", "b", "rare") for i in range(80 if label != "rare" else 9) for y in [int(rng.random() < (0.1 if label == "b" else 0.5))]]
    return rows + [("single", 0, 0.5, 1), ("flat", 0, 0.5, 1), ("flat", 1, 0.5, 0)]


@pytest.fixture(scope="module")
def scored_df(spark, scored):
    return spark.createDataFrame(scored, "label string, fold int, score double, y int").repartition(3)


def chosen(rows):
    out = {}
    for label, fold in {r[:2] for r in rows}:
        other = [r for r in rows if r[0] == label and r[1] != fold]
        if other:
            out[label, fold] = max({r[2] for r in other}, key=lambda t: (round(mcc(*counts(other, t)), 9), -t))
    return out


def test_exact_thresholds(scored, scored_df):
    got = evaluation.exact_thresholds(scored_df, ["label"], "fold", "score", "y").collect()
    assert {(r.label, r.fold): r.threshold for r in got} == chosen(scored)  # a label of one fold has no other to learn from
    assert len(got) == len(chosen(scored)) and ("single", 0) not in chosen(scored)


def test_fold_metrics_and_averages(scored, scored_df):
    t = chosen(scored)
    own = {(label, fold): counts([r for r in scored if r[:2] == (label, fold)], cut) for (label, fold), cut in t.items()}
    metrics = evaluation.fold_metrics(scored_df, evaluation.exact_thresholds(scored_df, ["label"], "fold", "score", "y"), ["label"], "fold", "score", "y")
    assert {(r.label, r.fold): (r.tp, r.fp, r.fn, r.tn) for r in metrics.collect()} == own
    f1 = lambda tp, fp, fn, tn: 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    for r in evaluation.averaged_f1(metrics, ["fold"]).collect():
        mine = [c for (_, fold), c in own.items() if fold == r.fold]
        assert r.micro_f1 == pytest.approx(f1(*map(sum, zip(*mine, strict=True)))) and r.macro_f1 == pytest.approx(sum(f1(*c) for c in mine) / len(mine))


def test_ranking_by(scored, scored_df):
    for r in evaluation.ranking_by(scored_df, ["label"], "score", "y").collect():
        own = [(s, y) for label, _, s, y in scored if label == r.label]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        if pos and neg:
            assert r.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        else:
            assert r.roc_auc is None
        cuts = [sum(y for s, y in own if s >= t) / sum(s >= t for s, _ in own) for t in pos]
        assert r.pr_auc == (pytest.approx(sum(cuts) / len(pos)) if pos else None)


def test_model_comparison(spark):
    rows = [("f1", "a", 0.2), ("f1", "a", 0.4), ("f1", "b", 0.5), ("f1", "b", 0.7), ("auc", "a", 0.5)]
    got = {r.metric: r for r in evaluation.model_comparison(spark.createDataFrame(rows, "metric string, model string, value double"), "metric", "model", "value", "a", "b").collect()}
    assert got["f1"].base_mean == pytest.approx(0.3) and got["f1"].base_std == pytest.approx(0.1) and got["f1"].difference_pp == pytest.approx(30)
    assert got["auc"].other_mean is None and got["auc"].difference_pp is None


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_values_rank_like_the_others(spark, monkeypatch, hot):
    """Ranks by broadcast for frequent values and by join for the rest are the same."""
    monkeypatch.setattr(rank, "HOT", hot)
    rng = random.Random(hot)
    values = [rng.choice([None, 0.0, 0.0, 1.0, rng.random()]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(4)
    filled = [v if v is not None else -1 for v in values]
    got = {r.i: r.p for r in rank.rank_percentile(df, "v", "p").collect()}
    assert got == pytest.approx({i: 1 - sum(w > v for w in filled) / 199 for i, v in enumerate(filled)})
    share = {r.i: r.p for r in rank.positive_percentile(df, "v", "p").collect()}
    assert share == pytest.approx({i: sum(max(w, 0) <= v for w in filled) / 200 if v > 0 else 0.0 for i, v in enumerate(filled)})


def test_case_folding_in_full(spark):
    """Every letter that lower-casing changes less than folding does, and mixtures."""
    texts = [c for c in text.FOLDED] + ["Straße ΣΑΣ", "ﬁn İstanbul", "ǰ ΐ", "plain TEXT", "ᏸ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.normalized_label("t").alias("x")).collect()}
    assert {i: got[i] for i, t in enumerate(texts)} == {i: t.lower().casefold() for i, t in enumerate(texts)}
