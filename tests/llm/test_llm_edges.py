"""Nulls, empty and very long texts, repeated rows, empty tables and extra
columns whose names the operators use inside."""

import pytest

from mailsift.llm import dropout_bpe, itq, mixing, pii, quality, secrets, simhash, suffix_lm, toxicity, urls

LONG = "alpha beta gamma " * 30_000
TEXTS = [None, "", " \n\t ", "one", "a b c d", "a b c d", "A B C D", LONG, "token = abcdefghijkl9 x@y.zz 1.2.3.4 +1 202 555 0143 99", "é▁ü \x00 \U0001d11e"]
CLASHING = "row string, h string, size string, slice string, fp string, t string, k string, spans string, base string, word string, bucket string, v string, id string, score string, blob string, key string"


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "a null id", None, None), (None, None, None, None)] if texts else []
    extra = [f.split()[0] for f in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, {CLASHING}")


def labels(spark, rows=((1, 0, 1), (2, 1, 0), (3, 1, 1), (None, 1, 1), (4, 1, None), (99, 0, 0), (3, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, h string, id string")


OPERATORS = {
    "quality": lambda s, d: quality.judge(d),
    "secrets": lambda s, d: secrets.findings(d, secrets.empty_ledger(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.find(d),
    "masked": lambda s, d: pii.masked(d),
    "suffix_lm": lambda s, d: suffix_lm.score(d),
    "pieces": lambda s, d: dropout_bpe.encoded(d),
    "mixing": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    docs = table(spark)
    assert len(OPERATORS[name](spark, docs).collect()) == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_columns_survive(spark):
    docs = table(spark)
    for out in (pii.masked(docs), simhash.one_of_each(docs), toxicity.without_toxic(docs, toxicity.fit(docs, labels(spark))), mixing.mix(docs).select("row.*")):
        assert out.columns == docs.columns
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({r.doc_id for r in kept}) and {0, 3, 4, 7, 8, 9} <= {r.doc_id for r in kept} and not {1, 2, 5, 6} & {r.doc_id for r in kept}


def test_null_and_empty_texts_have_defined_results(spark):
    docs = table(spark)
    q = {r.row.doc_id: r for r in quality.judge(docs).collect()}
    assert q[0].n_words == 0 and q[0].base_failed and not q[0].kept
    lm = {r.doc_id: r for r in suffix_lm.score(docs).collect()}
    assert lm[0].n_tokens == lm[1].n_tokens == 1 and lm[0].score == lm[1].score < 0
    p = {r.row.doc_id: r for r in dropout_bpe.encoded(docs).collect()}
    assert p[0].ids is None and p[1].ids == [] and all(r.lossless for r in p.values())
    m = mixing.mix(docs).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in m) and {r.size for r in m if r.row.doc_id in (0, 1, 2)} == {0}
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert masked[0] is None and masked[7] == LONG and masked[8] == "token = abcdefghijkl9 <email> <ip> <phone>"


def test_ids_beside_a_null_one_keep_type_and_value(spark):
    import brute

    big = 2**53 + 1
    texts = {k: f"word{k} and some more text" for k in [*range(30), big, big + 2, -big]}
    rows = [*texts.items(), (None, "a null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute.unigram([("" if k is None else k, t) for k, t in rows])
    got = suffix_lm.score(docs).collect()
    assert {r.doc_id for r in got} == {*texts, None} and len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want["" if r.doc_id is None else r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base)
    named = simhash.near_duplicates(docs).collect()
    assert {r.doc_id for r in named} == {*texts, None} and {big, big + 2, -big} <= {r.component_id for r in named}


def test_no_labels_or_one_class(spark):
    docs = table(spark)
    for rows in ([], [(1, 0, 1), (3, 1, 1)]):
        got = toxicity.toxicity(docs, labels(spark, rows)).collect()
        assert len(got) == docs.count() and len({r.score for r in got}) == 1


def test_odd_vectors_link_with_nothing(spark):
    good, near = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(1, good), (2, near), (3, good), (3, good), (4, None), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [float("nan"), 2.0, 3.0, 4.0]), (8, [float("inf"), 2.0, 3.0, 4.0]), (9, [1.0, 2.0]), (10, []), (None, near), (11, [-1.0, -2.0, -3.0, -4.0])]
    got = itq.near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert (by[1].n_links, by[1].component_id, by[1].kept) == (4, 1, True) and (by[3].n_links, by[3].component_id, by[3].kept) == (4, 1, False)
    assert by[None].component_id == 1 and by[2].n_links == 4
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in range(4, 12))
    assert itq.near_duplicates(vectors(spark, [])).collect() == []


def test_rules_and_pages_may_be_missing(spark):
    pages = spark.createDataFrame([(1, "http://A.net/x?y", "k"), (1, "http://A.net/x?y", "k"), (None, None, None)], "page_id long, url string, key string")
    rules = spark.createDataFrame([("net", "/", "block"), (None, "/", "block"), ("net", None, "allow"), ("", "", "block")], "host string, path string, verdict string")
    got = urls.judge(pages, rules).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got) == [(0, "", "", None, "allow"), (1, "a.net", "/x", "net/", "block"), (1, "a.net", "/x", "net/", "block")]
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), rules).collect() == []
