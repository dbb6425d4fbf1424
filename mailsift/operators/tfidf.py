"""TF-IDF over word n-grams with a bounded vocabulary.

Fitting counts n-grams level by level. A longer n-gram cannot be more frequent
than the shorter ones inside it, and the vocabulary keeps only the ``max_terms``
most frequent terms, so after each level the count of the last kept term is a
lower bound. Only n-grams built from parts above that bound are generated at the
next level. The result equals counting everything, but the shuffle carries a
few thousand keys instead of every trigram of the corpus.

Transforming works inside the row (no join, no shuffle): Spark ML's
CountVectorizerModel looks terms up, the weights are array expressions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import analyzed, constant_strings, sql_list, terms, without
from mailsift.session import cut_lineage

# --- fixed values: default English stop words, a parameter everywhere ---------------
STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "almost", "alone",
    "along", "already", "also", "although", "always", "am", "among", "an",
    "and", "another", "any", "anyone", "anything", "are", "around", "as", "at",
    "be", "became", "because", "become", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "cannot", "could", "de", "do",
    "done", "down", "due", "during", "each", "eg", "either", "else",
    "elsewhere", "enough", "etc", "even", "ever", "every", "everyone",
    "everything", "except", "few", "for", "former", "from", "further", "get",
    "give", "go", "had", "has", "have", "he", "hence", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "however", "ie", "if", "in",
    "indeed", "into", "is", "it", "its", "itself", "last", "least", "less",
    "made", "many", "may", "me", "might", "mine", "more", "most", "much",
    "must", "my", "myself", "neither", "never", "no", "nobody", "none", "nor",
    "not", "nothing", "now", "of", "off", "often", "on", "once", "one", "only",
    "onto", "or", "other", "others", "our", "ours", "ourselves", "out", "over",
    "own", "per", "perhaps", "please", "rather", "re", "same", "see", "she",
    "should", "since", "so", "some", "something", "still", "such", "than",
    "that", "the", "their", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "upon", "us", "very", "was", "we", "well", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "within",
    "without", "would", "yet", "you", "your", "yours", "yourself",
]
# -------------------------------------------------------------------------------------
#: Words whose n-grams a task counts at a time, a text at least.
SLICE_WORDS = 1 << 20
#: Parts that all n-grams are dealt to by hash; a part is added up at a time.
SHARES = 1024


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary: at most ``max_terms`` terms, sorted, with their idf."""

    terms: list[str]
    document_counts: list[int]
    corpus_counts: list[int]
    documents: int
    orders: tuple[int, ...] = (1, 2, 3)
    stop_words: list[str] = field(default_factory=lambda: STOP_WORDS)

    @property
    def idf(self) -> list[float]:
        n = self.documents
        return [math.log((1 + n) / (1 + d)) + 1 for d in self.document_counts]


def literal_doubles(values: list[float]) -> Column:
    return constant_strings([repr(float(v)) for v in values]).cast("array<double>")


def with_words(df: DataFrame, text: str, stop_words: list[str]) -> DataFrame:
    return df.withColumn("_words", without(terms(analyzed(F.col(text))), stop_words))


def gram_counts(df: DataFrame, grams: Column) -> DataFrame:
    """Corpus and document frequency of every element of an array column.

    Sorting the array marks the first occurrence per document, so one map-side
    combined aggregate yields both counts.
    """
    ordered = df.select(F.sort_array(grams).alias("_g"))
    marked = F.transform(
        "_g",
        lambda t, i: F.struct(
            t.alias("term"), F.when((i > 0) & (t == F.get("_g", i - 1)), 0).otherwise(1).alias("first")
        ),
    )
    return (
        ordered.select(F.explode(marked).alias("x"))
        .groupBy(F.col("x.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("cf"), F.sum("x.first").alias("df"))
    )


def ngram_counts(df: DataFrame, orders: tuple[int, ...], parts: dict[int, list[str]] | None = None) -> DataFrame:
    """Corpus and document frequency of every n-gram of ``_words``.

    With ``parts`` (n-grams by n) only n-grams whose shorter ones are all in
    there are counted. Tasks count slices of documents by number, so that a gram
    is spelled once a slice; those of like hash travel in one row, their words
    without line breaks, and are added up together.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: pa.array(p, pa.string()) for n, p in (parts or {}).items()}
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b["_words"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):
                n = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, "right")) - at, 1)
                for share, term, *counts in _slice_counts(b["_words"].slice(at, n), orders, known):
                    order = np.argsort(share, kind="stable")
                    share = share[order]
                    cuts = np.flatnonzero(np.diff(share, prepend=-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(share)), pa.int32()), term.take(pa.array(order)))
                    sums = [pa.array([x.tobytes() for x in np.split(c[order], cuts[1:])], pa.binary()) for c in counts]
                    yield pa.RecordBatch.from_arrays([pa.array(share[cuts]), pc.binary_join(lists, "\n"), *sums], names=["share", "terms", "cf", "df"])
                at += n

    def added(rows: pa.Table) -> pa.Table:
        sums = {c: np.frombuffer(b"".join(rows[c].to_pylist()), np.int64) for c in ("cf", "df")}
        one = pa.table({"term": pc.list_flatten(pc.split_pattern(rows["terms"], "\n")), **sums})
        total = one.group_by("term", use_threads=False).aggregate([("cf", "sum"), ("df", "sum")])
        return total.select(["term", "cf_sum", "df_sum"]).rename_columns(["term", "cf", "df"])

    slices = df.select("_words").mapInArrow(counted, "share bigint, terms string, cf binary, df binary")
    return slices.groupBy("share").applyInArrow(added, "term string, cf bigint, df bigint")


def _slice_counts(texts: pa.ListArray, orders: tuple[int, ...], known: dict[int, pa.Array]) -> Iterator[tuple]:
    """(shares, n-grams, corpus and document frequencies) of some texts, by n.

    An n-gram's number is that of its first n - 1 words with that of its last."""
    lens = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.dictionary_encode(texts.flatten())
    word, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    crc = np.fromiter((zlib.crc32(w) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    text = np.repeat(np.arange(len(lens)), lens)
    end = np.repeat(np.cumsum(lens), lens)
    start, number = np.arange(len(word)), word
    for n in range(1, max(orders) + 1):
        if n > 1:  # where an (n-1)-gram begins and one begins at the next word
            follows = np.zeros(len(word) + 1, bool)
            follows[start] = True
            use = follows[start + 1] & (start + n <= end[start])
            start, number = start[use], number[use] * len(names) + word[start[use] + n - 1]
        order = np.argsort(number, kind="stable")  # texts stay in order
        ranked, text_of = number[order], text[start[order]]
        new = np.diff(ranked, prepend=-1) != 0
        first = np.flatnonzero(new)
        if not len(first):
            return
        once = new | (np.diff(text_of, prepend=-1) != 0)
        at = start[order[first]]
        spelled = [names.take(pa.array(word[at + k])) for k in range(n)]
        grams = spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, " ")
        if n in orders:
            mixed = np.zeros(len(at), np.uint64)
            for k in range(n):
                mixed = (mixed + crc[word[at + k]] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            share = ((mixed >> np.uint64(32)) % np.uint64(SHARES)).astype(np.int64)
            yield share, grams, np.diff(first, append=len(ranked)), np.add.reduceat(once.astype(np.int64), first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        number = rank
        if n in known:
            kept = pc.is_in(grams, value_set=known[n]).to_numpy(zero_copy_only=False)[rank]
            start, number = start[kept], number[kept]


def _gram_sql(n: int) -> str:
    """SQL for the n-gram that starts at word ``w`` with index ``i``; null at the end."""
    return "concat(w" + "".join(f", ' ', get(_words, i + {k})" for k in range(1, n)) + ")"


def fit(
    df: DataFrame,
    text: str = "text",
    max_terms: int = 5000,
    min_df: int = 5,
    max_df: float = 0.8,
    orders: tuple[int, ...] = (1, 2, 3),
    stop_words: list[str] = STOP_WORDS,
) -> TfidfModel:
    """Vocabulary of the most frequent n-grams (ties by term) with its counts.

    The words are made once and kept on shared storage for all levels; a column
    ``_words`` made earlier is used as it is.
    """
    words = df.select("_words") if "_words" in df.columns else cut_lineage(with_words(df.select(text), text, stop_words).select("_words"))
    total = words.count()
    ceiling = max_df * total
    room = 2 * max_terms + 2_000
    best: list[tuple[int, str, int]] = []
    parts: dict[int, list[str]] = {}
    for n in range(1, max(orders) + 1):
        counted = ngram_counts(words, (n,), parts).where(F.col("df") >= min_df)
        ranked = counted.orderBy(F.desc("cf"), F.asc("term"))
        rows = ranked.limit(room).collect()
        fits = [r for r in rows if r["df"] <= ceiling]
        overflow = len(rows) == room
        if overflow and len(fits) < max_terms:
            fits = counted.where(F.col("df") <= ceiling).orderBy(F.desc("cf"), F.asc("term")).limit(max_terms).collect()
        if n in orders:
            best = sorted(best + [(-r["cf"], r["term"], r["df"]) for r in fits])[:max_terms]
        bound = -best[-1][0] if len(best) == max_terms else min_df
        above = [r["term"] for r in rows if r["cf"] >= bound]
        # When the list was cut before the bound was reached, prune nothing.
        if not (overflow and len(above) == len(rows)):
            parts[n] = above
    ordered = sorted(best, key=lambda t: t[1])
    return TfidfModel(
        terms=[t for _, t, _ in ordered],
        document_counts=[d for _, _, d in ordered],
        corpus_counts=[-c for c, _, _ in ordered],
        documents=total,
        orders=tuple(orders),
        stop_words=stop_words,
    )


def transform(df: DataFrame, model: TfidfModel, text: str = "text") -> DataFrame:
    """Append ``tfidf_index`` and ``tfidf_weight`` arrays (L2-normalised).

    Terms outside the vocabulary are ignored; a text without known terms gets
    empty arrays.
    """
    keep = [c for c in df.columns if c != "_words"]
    words = df if "_words" in df.columns else with_words(df, text, model.stop_words)
    counted = _count_vector(words.withColumn("_grams", _known_grams(model)), model.terms, keep)
    idf = literal_doubles(model.idf)
    weighted = counted.select(
        *keep,
        F.col("_index"),
        F.zip_with("_index", "_tf", lambda i, tf: (1 + F.ln(tf)) * F.get(idf, i)).alias("_w"),
    )
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x * x))
    # bound to a lambda variable, the norm is computed once for all weights
    normed = F.transform(F.array(norm), lambda n: F.transform("_w", lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return weighted.select(*keep, F.col("_index").alias("tfidf_index"), F.get(normed, F.lit(0)).alias("tfidf_weight"))


def _known_grams(model: TfidfModel) -> Column:
    """All n-grams of ``_words`` that are in the vocabulary, by a hash set test."""
    parts = []
    for n in model.orders:
        known = [t for t in model.terms if t.count(" ") == n - 1]
        if known:
            parts.append(
                F.expr(f"filter(transform(_words, (w, i) -> {_gram_sql(n)}), g -> g IN {sql_list(known)})")
            )
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _count_vector(df: DataFrame, vocabulary: list[str], keep: list[str]) -> DataFrame:
    if not vocabulary:
        return df.select(
            *keep,
            F.array().cast("array<int>").alias("_index"),
            F.array().cast("array<double>").alias("_tf"),
        )
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_cv")
    sparse = vectorizer.transform(df).select(*keep, F.unwrap_udt("_cv").alias("_v"))
    return sparse.select(*keep, F.col("_v.indices").alias("_index"), F.col("_v.values").alias("_tf"))


def long_form(df: DataFrame, model: TfidfModel, keep: list[str] | None = None) -> DataFrame:
    """One (id, term, weight) row per document and known term."""
    names = constant_strings(model.terms)
    pair = F.arrays_zip(F.col("tfidf_index").alias("i"), F.col("tfidf_weight").alias("w"))
    rows = df.select(*(keep or ["msg_id"]), F.explode(pair).alias("x"))
    return rows.select(
        *(keep or ["msg_id"]), F.get(names, F.col("x.i")).alias("term"), F.col("x.w").alias("weight")
    )


def vocabulary_table(spark, model: TfidfModel) -> DataFrame:
    """The vocabulary as rows: at most ``max_terms``."""
    cols = [
        constant_strings(model.terms).alias("term"),
        constant_strings([str(d) for d in model.document_counts]).cast("array<bigint>").alias("df"),
        constant_strings([str(c) for c in model.corpus_counts]).cast("array<bigint>").alias("cf"),
        literal_doubles(model.idf).alias("idf"),
    ]
    zipped = spark.range(1).select(F.posexplode(F.arrays_zip(*cols)).alias("idx", "x"))
    return zipped.select(F.col("idx").alias("term_index"), "x.term", "x.df", "x.cf", "x.idf")


def feature_names(spark, model: TfidfModel, numeric: list[str]) -> DataFrame:
    names = constant_strings([*model.terms, *numeric])
    return spark.range(1).select(F.posexplode(names).alias("feature_index", "name"))


def top_terms(df: DataFrame, model: TfidfModel, label: str, wanted: str, k: int = 20) -> DataFrame:
    """Terms with the largest mean weight in one class, absent terms count 0."""
    own = df.where(F.col(label) == wanted)
    n = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = long_form(own, model).groupBy("term").agg(F.sum("weight").alias("s"))
    mean = sums.select("term", F.round(F.col("s") / n, 6).alias("mean_weight"))
    return mean.orderBy(F.desc("mean_weight"), F.asc("term")).limit(k)
