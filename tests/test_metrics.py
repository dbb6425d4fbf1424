"""Golden rows, curves and exact ordered sums."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import metrics, prefix, report

GOLDEN = [
    (0, 0.1091), (1, 0.9967), (1, 0.9994), (0, 0.3157), (1, 0.9956),
    (0, 0.9199), (0, 0.9896), (1, 0.9909), (1, 0.9894), (0, 0.645),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame(GOLDEN, "y int, p double")
    return report.add_prediction(df)


def test_golden_metrics(golden):
    m = metrics.binary_metrics(golden).head()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (5, 3, 2, 0)
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.7, 0.625, 1.0)
    assert m["f1"] == pytest.approx(0.7692, abs=1e-4)
    assert metrics.roc_auc(golden).head()["auc"] == pytest.approx(0.96)
    assert metrics.pr_auc(golden).head()["auc"] == pytest.approx(0.963333, abs=1e-6)


def test_golden_thresholds(golden):
    best = metrics.best_threshold(metrics.threshold_sweep(golden)).head()
    assert (best["threshold"], best["tp"], best["fp"], best["tn"], best["fn"]) == (0.92, 5, 1, 4, 0)
    assert best["f1"] == pytest.approx(0.909091, abs=1e-6)
    coarse = metrics.best_threshold(metrics.threshold_sweep(golden, metrics.COARSE_GRID)).head()
    assert (coarse["threshold"], coarse["fp"]) == (0.65, 2)
    assert metrics.threshold_sweep(golden).count() == 99


def test_golden_report(golden):
    s = report.summary(golden).head()
    assert (s["correct"], s["incorrect"], s["correct_pct"], s["incorrect_pct"]) == (7, 3, 70.0, 30.0)
    assert report.misclassified(golden).count() == 3


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "y int, prediction int")
    m = metrics.binary_metrics(df).head()
    assert (m["precision"], m["recall"], m["f1"], m["specificity"]) == (0.0, 0.0, 0.0, 1.0)


def test_unknown_metric_is_refused(golden):
    with pytest.raises(ValueError):
        metrics.best_threshold(metrics.threshold_sweep(golden), "auc")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_with_a_hot_key(spark, descending):
    rng = random.Random(3)
    keys = [0.5 if i % 3 == 0 else round(rng.random() ** 6, 5) for i in range(4000)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k double, n long")
    got = {r["k"]: r["cum_n"] for r in prefix.running_sums(df, "k", ["n"], descending=descending).collect()}
    total, want = 0, {}
    for k in sorted(set(keys), reverse=descending):
        total += keys.count(k)
        want[k] = total
    assert got == want


def test_exact_quantiles_per_group(spark):
    rows = [("a", float(v)) for v in (1, 2, 4, 9)] + [("b", 5.0)] * 100 + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r["g"]: r for r in prefix.exact_quantiles(df, "v", {"q25": 0.25, "q50": 0.5}, "g").collect()}
    assert (q["a"]["q50"], q["a"]["q25"]) == (3.0, 1.75)
    assert q["b"]["q50"] == 5.0


def test_auc_with_skewed_scores_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), 0.0 if rng.random() < 0.4 else rng.random() ** 9) for _ in range(1500)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(df).head()["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_count_not_above(spark):
    cuts = [0.1, 0.2, 0.3, 0.4, 0.5]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.25, 0.5, 0.9)], "v double")
    got = df.select(prefix.count_not_above(F.col("v"), cuts, False).alias("a"), prefix.count_not_above(F.col("v"), cuts, True).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 0), (1, 0), (2, 2), (5, 4), (5, 5)]


def test_documents_without_words_have_a_score(spark, tmp_path):
    """Their share of repeated words was a division by zero, which ends the query."""
    from mailsift.plans import evaluation

    texts = [(1, " \n"), (2, "a b a b"), (3, None), (4, ""), (5, "a")]
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = evaluation.json_results(spark, str(tmp_path))
    assert {r.msg_id: json.loads(r.json)["probability"] for r in got.collect()} == {1: 0.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}
