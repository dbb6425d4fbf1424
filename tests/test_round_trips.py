"""Result tables written and read back: the same rows, types and nulls."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators import metrics, report, sampling, setops
from mailsift.sources import sinks

BODIES = ["plain", 'a "quoted", part', "two\nlines", "", None, " blanks ", "é ▁ \\ \\N", "a;b\tc"]


@pytest.fixture(scope="module")
def mail(spark):
    rows = [(k, f"s{k}", BODIES[k % len(BODIES)], "phishing" if k % 3 else "legitimate", (k % 10) / 10, k % 2) for k in range(40)]
    return spark.createDataFrame(rows, "msg_id long, subject string, body string, label string, p double, y int").cache()


def same(spark, df, path, fmt):
    back = sinks.read_table(spark, path, df.schema, fmt)
    assert back.dtypes == df.dtypes
    key = lambda r: repr(tuple(r))
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_combined_sample_and_predictions(spark, mail, tmp_path, fmt):
    combined = setops.union_outer([setops.tag_source(mail, "a"), setops.tag_source(mail.drop("body"), "b")])
    sample = sampling.sample_balanced(mail, 10)
    predictions = report.add_prediction(mail)
    for name, df in {"combined": combined, "sample": sample, "predictions": predictions}.items():
        sinks.write_table(df, str(tmp_path / name), fmt)
        same(spark, df, str(tmp_path / name), fmt)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_thresholds_and_the_chosen_one(spark, mail, tmp_path, fmt):
    sweep = metrics.threshold_sweep(mail)
    sinks.write_thresholds(sweep, str(tmp_path), fmt=fmt)
    same(spark, sweep, str(tmp_path / "thresholds"), fmt)
    assert sinks.read_table(spark, str(tmp_path / "thresholds"), sweep.schema, fmt).count() == 99
    chosen = sinks.read_table(spark, str(tmp_path / "chosen"), sweep.schema, fmt).collect()
    assert chosen == metrics.best_threshold(sweep).collect() and len(chosen) == 1


def test_curves_and_confusion(spark, mail, tmp_path):
    sinks.write_curves(mail, str(tmp_path))
    same(spark, metrics.roc_curve(mail), str(tmp_path / "roc"), "csv")
    same(spark, metrics.pr_curve(mail), str(tmp_path / "pr"), "csv")
    pred = mail.withColumn("prediction", (F.col("p") >= 0.5).cast("int"))
    same(spark, metrics.confusion_matrix(pred), str(tmp_path / "confusion"), "csv")
