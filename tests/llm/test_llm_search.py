"""License scan, ranked search and hard negatives against plain re-statements."""

import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from mailsift.llm import licenses, negatives, ranking  # noqa: E402
from mailsift.llm.queries import book  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# ---- license scan

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]


def base_of(text):
    w = LICENSE_WORD.findall(brute.lower(text or ""))
    found = [(i, label) for label, p in BASE for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check_base(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_license_base_on_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = book.queries["op11_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    check_base(rows, texts)


def test_license_base_on_odd_texts(spark, tmp_path):
    parts = ["MIT", "mit", "License", "LICENSE", "Apache", "general", "Public", " ", ",", "\n", "é", "K", "x", "-", "İ", "0"]
    rng = random.Random(3)
    texts = [None, "", " ", "MIT License", "mit, licenſe", "MIT License", "mit license mit license", "general public license general public license", "words " * 50_000 + "MIT license"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = book.queries["op11_license_scan"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    check_base(rows, dict(enumerate(texts)))


def test_changed_copies_lie_on_neighbouring_diagonals(spark):
    body = dict(enumerate(t for _, t in licenses.TEMPLATES))
    words = body[0].split()
    texts = {
        "same": "before it " + body[0] + " after it",
        "inserted": " ".join(words[:20] + ["another", "word"] + words[20:]),
        "dropped": " ".join(words[:15] + words[17:]),
        "cased": body[0].upper(),
        "half": " ".join(words[: len(words) // 2]),
        "shuffled": " ".join(random.Random(1).sample(words, len(words))),
        "two": body[0] + " " + "x " * 40 + body[8],
        "scattered": " ".join(f"{' '.join(words[k : k + 4])} {'z ' * 30}" for k in range(0, 48, 4)),
    }
    docs = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r.row.k: r.spans for r in licenses.scan(docs).collect()}
    of = {k: [(s.label, s.start, s.end) for s in v] for k, v in got.items()}
    n = len(licenses_words(body[0]))
    assert of["same"] == [("mit", 2, 2 + n)] and got["same"][0].score == 1.0
    assert of["cased"] == [("mit", 0, n)] and [x[0] for x in of["two"]] == ["mit", "bsd"]
    for k in ("inserted", "dropped"):
        assert [x[0] for x in of[k]] == ["mit"] and 0.8 < got[k][0].score < 1
    assert of["half"] == of["shuffled"] == of["scattered"] == []


def licenses_words(text):
    return LICENSE_WORD.findall(brute.lower(text))


def test_license_scan_of_odd_tables(spark):
    rows = [(1, "MIT license", "a"), (1, "MIT license", "a"), (None, "apache license", "b"), (2, None, "c")]
    docs = spark.createDataFrame(rows, "id long, text string, pos string").withColumns({c: F.lit("clash") for c in ("spans", "k", "h", "template", "w0", "words")})
    got = licenses.scan(docs).collect()
    assert Counter((r.row.id, len(r.spans), r.row.pos) for r in got) == Counter([(1, 1, "a"), (1, 1, "a"), (None, 1, "b"), (2, 0, "c")])
    assert licenses.scan(docs.limit(0)).collect() == []
    assert all(r.spans == [] for r in licenses.scan(docs, [], []).collect())
    wide = licenses.scan(docs, [("own", "one two three four five")], [])
    assert wide.columns == ["row", "n_words", "spans"]


def test_large_template_sets_are_joined_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, licenses.TEMPLATES[3][1])], "id long, text string")
    want = licenses.scan(docs).collect()
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 0)
    assert licenses.scan(docs).collect() == want


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """Documents in order for each item, by the formula."""
    terms = lambda t: TERM.findall(brute.lower(t or ""))
    d = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, length, df = len(d), sum(n for _, _, n in d), Counter(t for _, tf, _ in d for t in tf)
    out = []
    for key, text in items:
        scored = []
        for i, tf, n in d:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(key, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_ranking_of_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows_of(book.queries["op12_ranked_search"](spark, SMALL)) == sorted(ranked(docs, items), key=str)


@pytest.mark.parametrize("block, pass_terms", [(32_768, 200_000), (3, 200_000), (7, 5)])
def test_ranking_of_odd_rows(spark, monkeypatch, block, pass_terms):
    monkeypatch.setattr(ranking, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = ["the", "The", "of", "é", "x1", "_", "a-b", *[f"w{k}" for k in range(90)]]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, " ,;"), (63, "the " * 50_000 + "w1"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[5][1]), (None, docs[9][1])]
    items = [(1, "the of W1 w1"), (2, None), (3, ""), (4, "absent"), (5, " ".join(vocabulary)), (5, " ".join(vocabulary)), (None, "é x1"), (6, "w2 " * 40)]
    d = spark.createDataFrame([(*r, "c", "c") for r in docs], "doc_id long, text string, doc string, score string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = ranking.search(d, q, pass_terms=pass_terms)
    assert rows_of(got) == sorted(ranked(docs, items), key=str)


def test_ranking_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.select("doc_id", F.lit(None).cast("string").alias("text")), q)):
        got = ranking.search(x, y)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_few_documents_are_scored():
    """Masks below the scores found are never looked into."""
    rng = np.random.default_rng(1)
    n, held = 5000, 8
    at = np.concatenate([rng.choice(40, held, replace=False) for _ in range(n)])
    tf = rng.integers(1, 3, n * held)
    b = ranking.Block(np.arange(n).astype(object), np.full(n, 50), at, tf, np.full(n, held), n, 50 * n)
    item = ranking.Item(0, list(range(12)), [1000 + 300 * k for k in range(12)])
    best, every = ranking.Best(20), ranking.Best(20)
    seen = b.search(item, best)
    every.add(b.scores(item, np.arange(n)), b.doc)
    assert best.score.tolist() == every.score.tolist() and best.doc.tolist() == every.doc.tolist() and seen < n / 4
    assert b.search(item, best) <= seen


# ---- hard negatives

def mined(rows, low=30, high=90):
    """rows: (id, label, vector) already relabelled; brute force over all pairs."""
    fine = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, y, v in {(i, y, tuple(v)) for i, y, v in fine if i is not None and i % 100 == 0}:
        score = [(i, sum(p * q for p, q in zip(v, w, strict=True)), z) for i, z, w in fine if len(w) == len(v)]
        best = sorted((r for r in score if r[2] == y and r[0] != a), key=order)[:5]
        for p, s, _ in best:
            worse = sorted((r for r in score if r[2] != y and low * s <= 100 * r[1] <= high * s), key=order)[:10]
            out += [(a, p, k, i, s, t) for k, (i, t, _) in enumerate(worse, 1)]
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def relabelled(i, y):
    return y if y is None or i is None or i % 7 else (y + 1) % 10


def test_negatives_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want = mined([(r.vec_id, relabelled(r.vec_id, r.label), r.embedding) for r in rows])
    assert want and as_rows(book.queries["op13_hard_negatives"](spark, SMALL)) == want


@pytest.mark.parametrize("rows, anchors, bucket", [(8192, 2048, 512), (40, 2, 16)])
def test_negatives_of_odd_rows(spark, monkeypatch, rows, anchors, bucket):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    table = [(k, int(rng.integers(0, 3)), (rng.standard_normal(8) * rng.choice([0.02, 1, 5])).astype(np.float32).tolist()) for k in range(0, 900, 5)]
    same = table[20][2]
    table += [(1000 + k, k % 3, same) for k in range(60)] + [(2000, 1, [0.0] * 8), (2100, 1, [1.0, 2.0]), (2101, 1, [2.0, 2.0]), (2102, 2, [1.0, 1.0]), (2200, None, same), (2300, 1, None)]
    table += [(2400, 1, [1.0, None] + [0.0] * 6), (2500, 1, [float("nan")] * 8), (2600, 1, [float("inf")] * 8), (None, 1, same), (None, 2, same), (2700, 1, []), (2701, 1, []), table[0], table[7]]
    d = spark.createDataFrame([(*r, "c", 1) for r in table], "vec_id long, label int, embedding array<float>, anchor string, v int")
    got = negatives.mine(d, F.col("vec_id") % 100 == 0, F.col("label"))
    assert as_rows(got) == mined(table)
    assert as_rows(negatives.mine(d.limit(0), F.col("vec_id") % 100 == 0, F.col("label"))) == []
    assert as_rows(negatives.mine(d.where("vec_id = 2100"), F.col("vec_id") % 100 == 0, F.col("label"))) == []


def test_ranges_of_focus_coordinates_shut_rows_out_but_none_that_reaches():
    rng = np.random.default_rng(2)
    v = (100 * rng.standard_normal((3000, 8))).astype(np.int64)
    rows = negatives.Rows(np.arange(3000), np.zeros(3000, bool), np.zeros(3000, int), v)
    chosen = 0
    for q in v[:50]:
        unit = q / np.linalg.norm(q)
        focus = np.argsort(-np.abs(unit))[: negatives.FOCUS]
        for b in rows.buckets:
            part = rows.v[b[0] : b[1]]
            near = set(b[0] + np.flatnonzero(part @ unit / np.linalg.norm(part, axis=1) >= 0.9))
            found = rows.candidates(b, unit, focus, 0.9)
            held = set(range(b[0], b[1])) if found is None else set(found.tolist())
            chosen += len(held)
            assert near <= held
    assert chosen < 0.2 * 50 * 3000
