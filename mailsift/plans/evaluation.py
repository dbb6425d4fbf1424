"""Metric, threshold and curve queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import metrics, report, sampling
from mailsift.plans import views
from mailsift.plans.book import Book, r6, rounded
from mailsift.plans.views import oracle

book = Book()
query = book.query

_METRICS = """round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn)::double ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::double ELSE 0 END, 6) AS f1,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::double ELSE 0 END, 6) AS specificity, tp, fp, tn, fn"""


def _cells(pred: str) -> str:
    return f"""sum(({pred}) = 1 AND y = 1)::bigint AS tp, sum(({pred}) = 1 AND y = 0)::bigint AS fp,
      sum(({pred}) = 0 AND y = 0)::bigint AS tn, sum(({pred}) = 0 AND y = 1)::bigint AS fn"""


_SWEEP = (
    "sweep",
    f"""SELECT t AS threshold, {_METRICS} FROM (SELECT t, {_cells('(p >= t)::int')} FROM scored,
      (SELECT i / 100.0::double AS t FROM range(1, 100) r(i)) GROUP BY t)""",
)
_COARSE = (
    "sweep",
    f"""SELECT t AS threshold, {_METRICS} FROM (SELECT t, {_cells('(p >= t)::int')} FROM scored,
      (SELECT i / 100.0::double AS t FROM range(10, 95, 5) r(i)) GROUP BY t)""",
)


@query("binary_metrics", oracle(f"SELECT {_METRICS} FROM (SELECT {_cells('prediction')} FROM scored_pred)", "scored_pred"))
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(views.scored_pred(spark, sf)))


@query("metrics_at_threshold", oracle(f"SELECT 0.3::double AS threshold, {_METRICS} FROM (SELECT {_cells('(p >= 0.3)::int')} FROM scored)", "scored"))
def metrics_at_threshold(spark, sf):
    return rounded(metrics.metrics_at(views.scored(spark, sf), 0.3))


@query("threshold_sweep", oracle("SELECT * FROM sweep", "scored", extra=[_SWEEP]))
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(views.scored(spark, sf)))


def _add_best(metric):
    sql = oracle(f'SELECT * FROM sweep ORDER BY "{metric}" DESC, threshold LIMIT 1', "scored", extra=[_SWEEP])

    @query(f"best_threshold_{metric}", sql)
    def best(spark, sf):
        return rounded(metrics.best_threshold(metrics.threshold_sweep(views.scored(spark, sf)), metric))


for _metric in ("f1", "accuracy", "precision", "recall"):
    _add_best(_metric)


@query("best_threshold_coarse", oracle("SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1", "scored", extra=[_COARSE]))
def best_threshold_coarse(spark, sf):
    sweep = metrics.threshold_sweep(views.scored(spark, sf), metrics.COARSE_GRID)
    return rounded(metrics.best_threshold(sweep))


@query(
    "threshold_long",
    oracle(
        """SELECT threshold, 'accuracy' AS metric, accuracy AS value FROM sweep UNION ALL SELECT threshold, 'precision', "precision" FROM sweep
          UNION ALL SELECT threshold, 'recall', recall FROM sweep UNION ALL SELECT threshold, 'f1', f1 FROM sweep
          UNION ALL SELECT threshold, 'specificity', specificity FROM sweep""",
        "scored",
        extra=[_SWEEP],
    ),
)
def threshold_long(spark, sf):
    return rounded(metrics.threshold_long(metrics.threshold_sweep(views.scored(spark, sf))))


_CURVE = (
    "curve",
    """SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC)::double AS cp, sum(neg) OVER (ORDER BY p DESC)::double AS cn,
      sum(pos) OVER ()::double AS np, sum(neg) OVER ()::double AS nn
      FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p)""",
)


@query("roc_curve", oracle("SELECT p AS threshold, round(cn / nn, 6) AS fpr, round(cp / np, 6) AS tpr FROM curve", "scored", extra=[_CURVE]))
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(views.scored(spark, sf)))


@query(
    "roc_auc",
    oracle(
        """SELECT round((sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM (
          SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::double AS r,
            sum(y) OVER ()::double AS np, sum(1 - y) OVER ()::double AS nn FROM scored) GROUP BY np, nn""",
        "scored",
    ),
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(views.scored(spark, sf)))


@query("pr_curve", oracle('SELECT p AS threshold, round(cp / (cp + cn), 6) AS "precision", round(cp / np, 6) AS recall FROM curve', "scored", extra=[_CURVE]))
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(views.scored(spark, sf)))


@query(
    "pr_auc",
    oracle(
        """SELECT round(sum((rec - prev_rec) * (pre + prev_pre) / 2), 6) AS auc FROM (
          SELECT rec, pre, coalesce(lag(rec) OVER (ORDER BY p DESC), 0) AS prev_rec, coalesce(lag(pre) OVER (ORDER BY p DESC), 1) AS prev_pre
          FROM (SELECT p, cp / np AS rec, cp / (cp + cn) AS pre FROM curve))""",
        "scored",
        extra=[_CURVE],
    ),
)
def pr_auc(spark, sf):
    return rounded(metrics.pr_auc(views.scored(spark, sf)))


_CLASSES = (
    "cls",
    """SELECT c AS cls, sum(prediction = c AND y = c)::double AS hit, sum(prediction = c)::double AS predicted, sum(y = c)::double AS actual
      FROM scored_pred, (SELECT unnest([0, 1]) AS c) GROUP BY c""",
)
_PER_CLASS = (
    "per_cls",
    """SELECT cls, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS pr, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS re,
      CASE WHEN predicted + actual > 0 THEN 2 * hit / (predicted + actual) ELSE 0 END AS f, actual, hit FROM cls""",
)


@query(
    "classification_report",
    oracle(
        """SELECT CASE cls WHEN 0 THEN 'legitimate' ELSE 'phishing' END AS "row", round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, actual::bigint AS support FROM per_cls
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(actual), 6), round(sum(hit) / sum(actual), 6), round(sum(hit) / sum(actual), 6), sum(actual)::bigint FROM per_cls
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(actual)::bigint FROM per_cls
        UNION ALL SELECT 'weighted avg', round(sum(pr * actual) / sum(actual), 6), round(sum(re * actual) / sum(actual), 6), round(sum(f * actual) / sum(actual), 6), sum(actual)::bigint FROM per_cls""",
        "scored_pred",
        extra=[_CLASSES, _PER_CLASS],
    ),
)
def classification_report(spark, sf):
    return rounded(metrics.classification_report(views.scored_pred(spark, sf)))


@query(
    "metrics_by_split",
    oracle(
        """SELECT split, round(acc, 6) AS accuracy, round((sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * nn), 6) AS auc, count(*) AS n FROM (
          SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0::double AS r,
            sum(y) OVER (PARTITION BY split)::double AS np, sum(1 - y) OVER (PARTITION BY split)::double AS nn,
            avg(((p >= 0.5)::int = y)::int) OVER (PARTITION BY split) AS acc
          FROM (SELECT *, CASE WHEN rn <= n - ceil(0.3 * n) THEN 'train' WHEN rn <= n - ceil(0.5 * ceil(0.3 * n)) THEN 'val' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY md5(msg_id || '-42')) AS rn, count(*) OVER () AS n FROM scored)))
        GROUP BY split, np, nn, acc""",
        "scored",
    ),
)
def metrics_by_split(spark, sf):
    return rounded(metrics.metrics_by_split(sampling.split_3way(views.scored(spark, sf))))


@query(
    "score_default",
    oracle(
        """SELECT msg_id, coalesce(p, 0.0)::double AS p, (coalesce(p, 0.0) >= 0.5)::int AS prediction,
          CASE WHEN coalesce(p, 0.0) >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS prediction_label
        FROM mail LEFT JOIN (SELECT msg_id AS i, p FROM scored) ON i = msg_id""",
        "mail",
        "scored",
    ),
)
def score_default(spark, sf):
    ids = views.documents(spark, sf).select(F.col("doc_id").alias("msg_id"))
    s = ids.join(views.scored(spark, sf).select("msg_id", "p"), "msg_id", "left")
    return report.safe_default(s).select("msg_id", "p", "prediction", "prediction_label")


@query(
    "json_results",
    oracle(
        """SELECT s.msg_id, to_json(struct_pack("from" := m."from", subject := m.source_file, prediction := CASE WHEN p >= 0.5 THEN 'phishing' ELSE 'legitimate' END,
          probability := p, confidence := CASE WHEN abs(p - 0.5::double) > 0.4::double THEN 'high' WHEN abs(p - 0.5::double) > 0.2::double THEN 'medium' ELSE 'low' END))::varchar AS json
        FROM scored s JOIN mail m ON s.msg_id = m.msg_id""",
        "scored",
        "mail",
    ),
)
def json_results(spark, sf):
    s = views.scored(spark, sf).withColumns(
        {
            "from": F.concat("lang", F.lit("@"), "source_file", F.lit(".example.org")),
            "subject": F.col("source_file"),
        }
    )
    return report.json_results(report.add_prediction(s))
