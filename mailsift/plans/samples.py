"""Sampling, splitting and class balancing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import balance, clean, sampling
from mailsift.plans import views
from mailsift.plans.book import Book, r6
from mailsift.plans.views import oracle

book = Book()
query = book.query

RANKED = (
    "ranked",
    """SELECT msg_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(msg_id || '-42')) AS rn, count(*) OVER (PARTITION BY label) AS n,
      row_number() OVER (ORDER BY md5(msg_id || '-42')) AS rn_all, count(*) OVER () AS n_all FROM mail WHERE label IS NOT NULL""",
)


def labelled(spark, sf):
    return clean.labelled_only(views.mail(spark, sf)).select("msg_id", "label")


def _sql(where):
    return oracle(f"SELECT msg_id, label FROM ranked WHERE {where}", "mail", extra=[RANKED])


@query("sample_balanced", _sql("rn <= least(30, n)"))
def sample_balanced(spark, sf):
    return sampling.sample_balanced(labelled(spark, sf), 60)


@query("sample_proportional", _sql("rn <= least(floor(100 * n / n_all::double), n)"))
def sample_proportional(spark, sf):
    return sampling.sample_proportional(labelled(spark, sf), 100)


@query(
    "sample_uniform",
    oracle("SELECT msg_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5(msg_id || '-42')) AS rn, count(*) OVER () AS n FROM mail) WHERE n <= 500 OR rn <= 200", "mail"),
)
def sample_uniform(spark, sf):
    return sampling.sample_uniform(views.mail(spark, sf), n=200, gate=500).select("msg_id", "label")


@query("sample_cap", _sql("rn <= least(120, n)"))
def sample_cap(spark, sf):
    return sampling.sample_cap(labelled(spark, sf), 120)


@query("undersample", _sql("rn <= (SELECT min(n) FROM ranked)"))
def undersample(spark, sf):
    return sampling.undersample(labelled(spark, sf))


THREE = "CASE WHEN {rn} <= {n} - ceil(0.3 * {n}) THEN 'train' WHEN {rn} <= {n} - ceil(0.5 * ceil(0.3 * {n})) THEN 'val' ELSE 'test' END"


@query("split_3way", oracle(f"SELECT msg_id, label, {THREE.format(rn='rn_all', n='n_all')} AS split FROM ranked", "mail", extra=[RANKED]))
def split_3way(spark, sf):
    return sampling.split_3way(labelled(spark, sf))


@query("split_stratified", oracle(f"SELECT msg_id, label, {THREE.format(rn='rn', n='n')} AS split FROM ranked", "mail", extra=[RANKED]))
def split_stratified(spark, sf):
    return sampling.split_3way(labelled(spark, sf), "label")


@query("split_train_test", oracle("SELECT msg_id, label, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS split FROM ranked", "mail", extra=[RANKED]))
def split_train_test(spark, sf):
    return sampling.split_train_test(labelled(spark, sf))


KNN = (
    "knn",
    """SELECT msg_id, neighbor, rank::int AS rank, dist FROM (SELECT a.msg_id, b.msg_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist,
        row_number() OVER (PARTITION BY a.msg_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9), b.msg_id) AS rank
      FROM vectors a JOIN vectors b ON a.y = 1 AND b.y = 1 AND a.msg_id <> b.msg_id) WHERE rank <= 5""",
)


@query("knn_minority", oracle("SELECT msg_id, neighbor, rank, round(dist, 6) AS dist FROM knn", "vectors", extra=[KNN]))
def knn_minority(spark, sf):
    v = views.vectors(spark, sf)
    n = balance.knn(v.where(F.col("y") == 1), k=5)
    return n.select("msg_id", "neighbor", "rank", r6("dist").alias("dist"))


def _smote_ctes(majority: str):
    return [
        KNN,
        ("sizes", f"SELECT sum(y)::bigint AS n_min, {majority} AS n_maj FROM vectors"),
        ("base", "SELECT msg_id, x, row_number() OVER (ORDER BY md5(msg_id || '-42')) AS rn FROM vectors WHERE y = 1"),
        ("plan", "SELECT msg_id, x, unnest(range(0, ((n_maj - n_min) // n_min + (rn <= (n_maj - n_min) % n_min)::int)::bigint)) AS replica FROM base, sizes"),
        ("draw", """SELECT *, ('0x' || substr(md5(msg_id || '-' || replica || '-42'), 1, 6))::bigint AS a, ('0x' || substr(md5(msg_id || '-' || replica || '-42'), 7, 6))::bigint / 16777215.0::double AS lam FROM plan"""),
        ("synth", """SELECT d.msg_id, d.replica, k.neighbor, lam, list_transform(list_zip(d.x, v.x), lambda z: z[1] + lam * (z[2] - z[1])) AS x
          FROM draw d JOIN knn k ON k.msg_id = d.msg_id AND k.rank = d.a % 5 + 1 JOIN vectors v ON v.msg_id = k.neighbor"""),
    ]


CELLS = 64
_CELLS_SQL = ", ".join(f"round(x[{i}], 6) AS x{i}" for i in range(1, CELLS + 1))
_MAJORITY = """CASE WHEN sum(1 - y) / sum(y)::double < 1.5 THEN sum(1 - y)
  ELSE floor(sum(1 - y) * greatest(0.6, sum(y) / sum(1 - y)::double)) END::bigint"""


@query(
    "smote",
    oracle(
        f"SELECT msg_id, replica::int AS replica, neighbor, round(lam, 6) AS lam, {_CELLS_SQL} FROM synth",
        "vectors",
        extra=_smote_ctes("sum(1 - y)::bigint"),
    ),
)
def smote(spark, sf):
    s = balance.smote(views.vectors(spark, sf), k=5)
    cells = [r6(F.get("x", F.lit(i))).alias(f"x{i + 1}") for i in range(CELLS)]
    return s.select("msg_id", "replica", "neighbor", r6("lam").alias("lam"), *cells)


@query(
    "balance_combined",
    oracle(
        """SELECT msg_id, y, false AS synthetic, round(list_sum(x), 6) AS total FROM (
             SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(msg_id || '-42')) AS place FROM vectors), sizes WHERE y = 1 OR place <= n_maj
           UNION ALL SELECT NULL, 1, true, round(list_sum(x), 6) FROM synth""",
        "vectors",
        extra=_smote_ctes(_MAJORITY),
    ),
)
def balance_combined(spark, sf):
    b = balance.balance(views.vectors(spark, sf), "combined")
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return b.select("msg_id", "y", "synthetic", r6(total).alias("total"))
