"""Scoring text with a probabilistic suffix tree over words.

A text is the sequence of its lower-cased words and an end. A context is a run of
up to ``depth`` symbols before a token, the beginning of a text being one; it is
looked at if training texts hold it LEAST times or more, whatever their size. It
is kept if its next-symbol distribution diverges from that of the next shorter
context: if, counting each training token out of its own context, the context
predicts the tokens after it better by DIVERGENCE nats in all. A token is predicted
by its longest kept context, smoothed along the shorter ones down to the unigram
base, which adds one to the count of every word.

The tree is never built in one place. Texts lie in blocks, and a block asks for the
totals of its own distinct words, grams and contexts: questions are sorted hashes,
cut into slices by hash; a slice's totals are one group of bounded size, and the
answers come back in the order of the questions. Both blocks and answers are tables
bucketed by block, so blocks never move again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import frames, id_remainder, in_array, lower_words_of, stored
from mailsift.session import shared_folder

#: Tokens of a block: a task keeps one block's words in memory.
BLOCK_TOKENS = 1 << 19
#: Questions of a slice, about.
SLICE = 1 << 20
#: Longest context in symbols, occurrences of a context, and nats it must save.
DEPTH, LEAST, DIVERGENCE = 3, 2, 3.0
_WORD, _GRAM, _CONTEXT = 0, 1, 2
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Hashes of the end and the beginning of a text; no word holds white space.
_END, _BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\r")


# ---------------------------------------------------------------- blocks


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block of documents of one task: ids and training marks of the
    documents, their lengths, each token's number and each number's word as a
    64-bit hash. Numbers follow the hashes' order; the end and the beginning of a
    text have theirs. ``train`` is a condition on the columns of ``docs``."""
    from pyspark import TaskContext

    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        number, made = TaskContext.get().partitionId() << 32, 0
        keys, marks, lens, ids, vocabulary, size = [], [], [], [], {}, 0

        def row():
            tokens = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
            hashes = np.append(hashes, np.array([_END, _BEGIN], np.uint64))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            tokens, hashes = rank[tokens], hashes[order]
            packed = zlib.compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
            return pd.DataFrame({"block": [number + made], "keys": [keys], "train": [marks], "lens": [lens], "ids": [packed], "words": [hashes.tobytes()]})

        for b in frames(batches):
            for own, t, mark in zip(b["k"], b["t"], b["m"], strict=True):
                words = lower_words_of(t)
                for at in range(0, len(words), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in part), np.int32, len(part)))
                keys.append(own[0] if len(own) else None)
                marks.append(bool(mark))
                lens.append(len(words))
                size += len(words) + 1
                if size >= block_tokens:
                    yield row()
                    made += 1
                    keys, marks, lens, ids, vocabulary, size = [], [], [], [], {}, 0
        if keys:
            yield row()

    rows = docs.select(in_array(id_col).alias("k"), F.col(text_col).alias("t"), train.alias("m"))
    return rows.mapInPandas(work, f"block bigint, keys array<{kind}>, train array<boolean>, lens array<int>, ids binary, words binary")


# ---------------------------------------------------------------- questions and answers


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte: all first bytes, all second bytes, and so on, as far
    as any is not zero. Spark compresses what little the high ones hold."""
    v = np.ascontiguousarray(values, np.uint64)
    n = 0 if not len(v) else (int(v.max()).bit_length() + 7) // 8
    return bytes([n]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _values(data: bytes, count: int) -> np.ndarray:
    n = data[0]
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, offset=1).reshape(n, count).T
    return out.view(np.uint64).ravel()


def _questions(kind: int, block: int, hashes: np.ndarray, body: np.ndarray, slices: int) -> Iterator[dict]:
    """A row for each slice: the block's hashes there, which are sorted, as
    differences, and what it adds to each: a count, or for contexts a sum."""
    # words are told apart by 64 bits, grams and contexts by 56
    key = hashes if kind == _WORD else hashes >> np.uint64(8)
    if not len(key):
        return  # a block without words has no grams to ask for
    top = np.uint64(0 if kind == _WORD else 8)
    of = ((key >> (np.uint64(48) - top)) * np.uint64(slices)) >> np.uint64(16)
    cuts = np.flatnonzero(np.diff(of, prepend=np.uint64(slices)))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
        own = body[a:b].astype(np.float32).tobytes() if kind == _CONTEXT else _planes(body[a:b])
        yield {"kind": kind, "slice": int(of[a]), "block": block, "n": b - a, "keys": _planes(np.diff(key[a:b], prepend=np.uint64(0))), "body": own}


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a slice, for each block in the order of its questions: counts, or
    for contexts whether they are kept. The slice's sum and number of counts come
    in a row of block -1."""
    kind, part = int(rows["kind"].iloc[0]), int(rows["slice"].iloc[0])
    sizes = rows["n"].tolist()
    keys = np.concatenate([np.cumsum(_values(k, n)) for k, n in zip(rows["keys"], sizes, strict=True)])
    if kind == _CONTEXT:
        body = np.concatenate([np.frombuffer(b, np.float32) for b in rows["body"]]).astype(float)
    else:
        body = np.concatenate([_values(b, n) for b, n in zip(rows["body"], sizes, strict=True)]).astype(float)
    _, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, body)
    found = (total >= DIVERGENCE)[place] if kind == _CONTEXT else np.rint(total).astype(np.uint64)[place]
    parts = np.split(found, np.cumsum(sizes)[:-1])
    packed = [np.packbits(p).tobytes() if kind == _CONTEXT else _planes(p) for p in parts]
    out = pd.DataFrame({"kind": kind, "slice": part, "block": rows["block"].to_numpy(), "n": sizes, "answer": packed, "total": 0, "kinds": 0})
    if kind == _WORD:
        out.loc[len(out)] = [kind, part, -1, 0, b"", int(total.sum()), int((total > 0).sum())]
    return out


def _in_order(kind: int, answers: list) -> np.ndarray:
    """Answers of a block in the order of its hashes."""
    mine = sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["slice"])
    if kind == _CONTEXT:
        parts = [np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=a["n"]).astype(bool) for a in mine]
    else:
        parts = [_values(a["answer"], a["n"]).astype(np.int64) for a in mine]
    return np.concatenate([np.zeros(0, bool if kind == _CONTEXT else np.int64), *parts])


# ---------------------------------------------------------------- a block's tokens


class Tokens:
    """A block as one stream: each text is a beginning, its words and an end.

    A level k holds, for the tokens whose context of k symbols is frequent: their
    places, each one's context and gram as numbers, and of these the hashes. Numbers
    follow the hashes' order at every level, so questions need no further sorting."""

    def __init__(self, row, least: int = LEAST):
        lens, self.train = np.asarray(row.lens, np.int64), np.asarray(row.train, bool)
        raw = np.frombuffer(zlib.decompress(row.ids), np.uint8)
        tokens = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()
        self.hashes, self.least, self.lens = np.frombuffer(row.words, np.uint64), least, lens
        end, self.begin = (int(np.searchsorted(self.hashes, np.uint64(h))) for h in (_END, _BEGIN))
        ends = np.cumsum(lens + 2)
        self.first = ends - lens - 2
        self.symbol = np.full(int(ends[-1]), end, np.int64)
        self.symbol[self.first] = self.begin
        inside = np.ones(len(self.symbol), bool)
        inside[self.first] = inside[ends - 1] = False
        self.symbol[inside] = tokens
        inside[ends - 1] = True
        self.place = np.flatnonzero(inside)  # every predicted token
        self.mark = np.repeat(self.train, lens + 2)
        self.levels: list[dict] = []

    def asked(self, kind: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and training counts of the words, or of a level's grams."""
        if kind == _WORD:
            use = self.place[self.mark[self.place]]
            return self.hashes, np.bincount(self.symbol[use], minlength=len(self.hashes))
        v = self.levels[level - 1]
        return v["hashes"], np.bincount(v["gram"][self.mark[v["at"]]], minlength=len(v["hashes"]))

    def words(self, totals: np.ndarray, texts: int) -> None:
        """Counts of all symbols; as a context the beginning is as frequent as texts."""
        self.count, self.before = totals, totals.copy()
        self.before[self.begin] = texts

    def deepen(self, totals: np.ndarray | None) -> None:
        """Add a level; ``totals`` are the counts of the last level's grams."""
        if totals is None:
            at, context, n, hashes = self.place, self.symbol[self.place - 1], self.before, self.hashes
        else:
            last = self.levels[-1]
            of = np.full(len(self.symbol), -1, np.int64)
            of[last["at"]] = last["gram"]
            before = of[self.place - 1]
            at, context, n, hashes = self.place[before >= 0], before[before >= 0], totals, last["hashes"]
        often = n[context] >= self.least
        at, context = at[often], context[often]
        z = (hashes[context] ^ (self.hashes[self.symbol[at]] * _MIX)) * _MORE
        z = (z ^ (z >> np.uint64(29))) * _MIX
        order = np.argsort(z)
        z = z[order]
        begins = np.ones(len(z), bool)
        begins[1:] = z[1:] != z[:-1]
        number = np.empty(len(z), np.int64)
        number[order] = np.cumsum(begins) - 1
        self.levels.append({"at": at, "context": context, "n": n, "of": hashes, "gram": number, "hashes": z[begins]})

    def contexts(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of a level, and which of them each of its tokens has."""
        v = self.levels[level - 1]
        held = np.zeros(len(v["of"]), bool)
        held[v["context"]] = True
        return np.flatnonzero(held), (np.cumsum(held) - 1)[v["context"]]

    def base(self, tokens: int, distinct: int) -> np.ndarray:
        """Log probability of every stream place by the unigram counts."""
        p = np.zeros(len(self.symbol))
        p[self.place] = np.log((self.count[self.symbol[self.place]] + 1.0) / (tokens + distinct + 1.0))
        return p

    def sums(self, level: int, p: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a level's contexts and what each saves on the block's training
        tokens, counting each token out. ``sure`` marks tokens of a shorter context
        with a single follower, from which no longer one diverges."""
        v = self.levels[level - 1]
        contexts, number = self.contexts(level)
        use = self.mark[v["at"]] & ~sure[v["at"]]
        n, c = v["n"][v["context"][use]].astype(float), v["n_gram"][v["gram"][use]]
        q, spare = p[v["at"][use]], np.sqrt(n)
        saved = np.log((c - 1 + spare * np.exp(q)) / (n - 1 + spare)) - q
        return v["of"][contexts], np.bincount(number[use], saved, len(contexts))

    def predict(self, level: int, kept: np.ndarray, p: np.ndarray, sure: np.ndarray) -> None:
        """Move ``p`` to the level's kept contexts, and mark what is sure."""
        v = self.levels[level - 1]
        _, number = self.contexts(level)
        n, c = v["n"][v["context"]].astype(float), v["n_gram"][v["gram"]]
        use = kept[number] & ~sure[v["at"]]
        at, spare = v["at"][use], np.sqrt(n[use])
        p[at] = np.log((c[use] + spare * np.exp(p[at])) / (n[use] + spare))
        sure[v["at"]] |= c == n


def _replayed(row, rounds: int, depth: int, least: int, known: dict) -> tuple[Tokens, np.ndarray | None, np.ndarray | None]:
    """A block's tokens after so many rounds of answers, log probabilities as far as
    they are known, and tokens already sure."""
    t = Tokens(row, least)
    p = sure = None
    if rounds:
        t.words(_in_order(_WORD, row.r0), known["texts"])
        p, sure = t.base(known["tokens"], known["distinct"]), np.zeros(len(t.symbol), bool)
    for r in range(1, rounds):
        answers = getattr(row, f"r{r}")
        if r > 1:
            t.predict(r - 1, _in_order(_CONTEXT, answers), p, sure)
        if r <= depth:
            t.deepen(None if r == 1 else t.levels[-1]["n_gram"])
            t.levels[-1]["n_gram"] = _in_order(_GRAM, answers)
    return t, p, sure


def _round(rounds: int, depth: int, least: int, slices: int, known: dict):
    """Questions of round r: words, then the grams of level r with the contexts of
    level r - 1."""

    def work(batches):
        for b in frames(batches):
            for row in b.itertuples(index=False):
                out = []
                t, p, sure = _replayed(row, rounds, depth, least, known)
                if rounds == 0:
                    out += _questions(_WORD, row.block, *t.asked(_WORD), slices)
                else:
                    if rounds > 1:
                        out += _questions(_CONTEXT, row.block, *t.sums(rounds - 1, p, sure), slices)
                    if rounds <= depth:
                        t.deepen(None if rounds == 1 else t.levels[-1]["n_gram"])
                        out += _questions(_GRAM, row.block, *t.asked(_GRAM, rounds), slices)
                if out:
                    yield pd.DataFrame(out)

    return work


# ---------------------------------------------------------------- scoring


def train_rows(id_col: str, modulus: int = 7, held_out: int = 2) -> Column:
    """Training documents: crc32 of the id as text leaves another remainder."""
    return id_remainder(F.col(id_col), modulus) != held_out


class _Tables:
    """Tables bucketed by block in the shared folder, dropped at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"suffix_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_folder(spark)}/{self.name}'")

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, "block").format("parquet").saveAsTable(f"{self.name}.{what}")
        return self.spark.table(f"{self.name}.{what}")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


#: Blocks are large rows: few are handed to Python at once.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, depth: int = DEPTH, least: int = LEAST, block_tokens: int = BLOCK_TOKENS, slice_size: int = SLICE,
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one
    row per row of ``docs``.

    ``train``, a condition on the columns, marks training documents. base_score
    sums log10((c + 1) / (N + V + 1)) over the words and the end; score is the
    tree's log10 probability of the same sequence. A null or empty text is its end
    alone; texts of any length are scored whole; a null id counts as the empty text
    for ``train``. Repeated rows are scored, and counted, each. Without training
    texts nothing is known and every score is 0. An empty table gives no rows.
    Extra columns are not read. What is gathered, words, grams and contexts, grows
    with the training texts; a sum that equals DIVERGENCE keeps its context.
    """
    spark = docs.sparkSession
    train = train_rows(id_col) if train is None else train
    tables, before = _Tables(spark), {k: spark.conf.get(k, None) for k in _BATCH}
    question = "kind int, slice int, block bigint, n int, keys binary, body binary"
    answer = "kind int, slice int, block bigint, n int, answer binary, total bigint, kinds bigint"
    try:
        held = tables.keep(blocks(docs, id_col, text_col, train, block_tokens), "blocks")
        for k, v in _BATCH.items():
            spark.conf.set(k, v)
        state = held.select("block", "train", "lens", "ids", "words")
        sizes = held.agg(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x + 1)), F.sum(F.size(F.filter("train", lambda t: t)))).first()
        slices = min(1 << 16, max(1, -(-(sizes[0] or 0) // slice_size)))
        known = {"texts": sizes[1] or 0}
        for r in range(depth + 2):
            asked = state.mapInPandas(_round(r, depth, least, slices, known), question)
            found = asked.groupBy("kind", "slice").applyInPandas(_answers, answer)
            listed = F.collect_list(F.struct("kind", "slice", "n", "answer")).alias(f"r{r}")
            got = tables.keep(found.groupBy("block").agg(listed, F.sum("total").alias("total"), F.sum("kinds").alias("kinds")), f"r{r}")
            if r == 0:
                whole = got.where("block = -1").select("total", "kinds").first()
                known |= {"tokens": whole[0] if whole else 0, "distinct": whole[1] if whole else 0}
            state = state.join(got.where("block >= 0").select("block", f"r{r}").hint("merge"), "block", "left")
            state = state.withColumn(f"r{r}", F.coalesce(f"r{r}", F.array().cast(state.schema[f"r{r}"].dataType)))

        def finish(batches):
            for b in frames(batches):
                for row in b.itertuples(index=False):
                    t, p, _ = _replayed(row, depth + 2, depth, least, known)
                    base = t.base(known["tokens"], known["distinct"])
                    seen = np.zeros(len(t.symbol), np.int64)
                    seen[t.place] = t.count[t.symbol[t.place]] > 0
                    add = lambda x, t=t: np.add.reduceat(x, t.first)
                    ten = np.log(10)
                    yield pd.DataFrame(
                        {
                            "block": row.block, "at": np.arange(len(t.lens)), "held_out": ~t.train, "n_tokens": t.lens + 1, "n_known": add(seen),
                            "train_tokens": known["tokens"], "base_score": add(base) / ten, "score": add(p) / ten,
                        }
                    )

        schema = "block bigint, at int, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        out = state.mapInPandas(finish, schema)
        # ids do not pass pandas, which rounds large ones beside a null
        ids = held.select("block", F.posexplode("keys").alias("at", "k"))
        named = ids.join(out, ["block", "at"])
        return stored(named.select(F.col("k").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        tables.drop()
