"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda by score, leftmost first. Each candidate popped
is skipped if a hash of seed, document, word place and candidate place says so;
it comes back only as part of a new candidate. Without dropout the result is the
model's own segmentation.

Many texts are encoded at once. Words of one length are the columns of an array
whose rows are their letters. One step takes every word's best candidate, draws
for it and merges it or strikes it from the agenda; a word of n letters is done
after fewer than 2 n steps, and a step costs a few passes over the array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import to_tasks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_ONES = (1 << 64) - 1
_MIX, _MORE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Longest word that is encoded in an array; longer ones take a heap.
_SHORT = 48
#: Lengths up to which words of different length share an array.
_WIDTHS = [*range(2, 13), 16, 24, 32, _SHORT]
#: Words of an array, letters encoded at once, and bits of the pair table.
_SLAB, _LETTERS, _BITS = 1 << 14, 1 << 20, 20
#: An agenda's entry is rank and place; no rank is this.
_PLACES, _NEVER = 6, 1 << 30
#: A letter's number takes so many bits; the last number is no letter.
_LETTER, _PAD = 21, (1 << 21) - 1


def load(path: str = MODEL) -> dict:
    """Tables of a BPE model with byte fallback for the tasks, about 20 MB.

    The model must keep text as it is: identity normalisation, a blank put in
    front, blanks kept. No piece may hold a blank after anything else.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(names))]
    if any(p and re.search(f"[^{_MARK}]{_MARK}", n) for n, p in zip(names, plain, strict=True)):
        raise ValueError("words cannot be encoded one by one with this model")
    names = [n.replace(_MARK, " ") if p else n for n, p in zip(names, plain, strict=True)]
    order = sorted((i for i, p in enumerate(plain) if p), key=lambda i: (-sp.get_score(i), i))
    raw = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.encode() if p else b"" for i, (n, p) in enumerate(zip(names, plain, strict=True))]
    rank = {names[i]: r for r, i in enumerate(order)}
    number = rank | {c: len(rank) + k for k, c in enumerate(sorted({c for n in rank for c in n} - rank.keys()))}
    letter = len(number) + np.arange(0x110000, dtype=np.int32)
    for s, k in number.items():
        if len(s) == 1:
            letter[ord(s)] = k
    pair, merged = _pair_table(number, rank)
    byte = np.zeros(256, np.int32)
    byte[[raw[i][0] for i in range(len(names)) if sp.is_byte(i)]] = [i for i in range(len(names)) if sp.is_byte(i)]
    return {"rank": rank, "letter": letter, "known": len(number), "pair": pair, "merged": merged, "id": np.array(order, np.int32), "byte": byte, "raw": raw}


def _pair_table(number: dict[str, int], rank: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by pair of piece numbers, in a table with open addressing."""
    keys = np.full(1 << _BITS, -1, np.int64)
    ranks = np.full(1 << _BITS, _NEVER, np.int32)
    for s, r in rank.items():
        for k in range(1, len(s)):
            if (a := number.get(s[:k])) is not None and (b := number.get(s[k:])) is not None:
                key = a << _LETTER | b
                at = (key * _MIX & _ONES) >> (64 - _BITS)
                while keys[at] >= 0:
                    at = at + 1 & (1 << _BITS) - 1
                keys[at], ranks[at] = key, r
    return keys, ranks


def word_keys(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of words from their texts' keys and their places in them."""
    z = (place.astype(np.uint64) + base) * np.uint64(_MIX)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(_MORE)
    return z ^ (z >> np.uint64(29))


class Encoder:
    """Encodes texts for one seed and dropout."""

    def __init__(self, model: dict, dropout: float = 0.1, seed: int = 5):
        self.rank, self.letter, self.known, self.ids, self.byte, self.raw = (model[k] for k in ("rank", "letter", "known", "id", "byte", "raw"))
        self.pair, self.merged = model["pair"], model["merged"]
        self.limit, self.seed = int(dropout * 2**64), seed
        #: letters that occur in pieces only, not as a piece
        self.partial = {int(self.letter[c]): chr(c) for c in np.flatnonzero((self.letter >= len(self.ids)) & (self.letter < self.known)).tolist()}
        self.size = np.array([len(b) for b in self.raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _skips(self, key: int, start: int, stop: int) -> bool:
        z = (key ^ (start << 32) ^ stop) * _MIX & _ONES
        return ((z ^ (z >> 32)) * _MORE & _ONES) < self.limit

    def pieces(self, word: str, key: int = 0) -> list[str]:
        """One word, candidate by candidate; the agenda is a heap, and what a merge
        has made stale is passed over."""
        n, rank = len(word), self.rank
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\x01") * n
        agenda = [(rank[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in rank]
        heapify(agenda)
        while agenda:
            _, i, end = heappop(agenda)
            j = stop[i]
            if not live[i] or j >= n or stop[j] != end:
                continue
            if self.limit and self._skips(key, i, end):
                continue
            live[j], stop[i] = 0, end
            if end < n:
                before[end] = i
            for a in (before[i], i):
                b = stop[a] if a >= 0 else n
                if b < n and (piece := word[a : stop[b]]) in rank:
                    heappush(agenda, (rank[piece], a, stop[b]))
        return [word[i : stop[i]] for i in range(n) if live[i]]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << _LETTER | b
        at = ((key.view(np.uint64) * np.uint64(_MIX)) >> np.uint64(64 - _BITS)).view(np.int64)
        held = self.pair[at]
        out = self.merged[at]
        off = np.flatnonzero(held != key)
        out[off] = _NEVER
        off = off[held[off] >= 0]
        while len(off):
            at[off] = at[off] + 1 & (1 << _BITS) - 1
            held = self.pair[at[off]]
            hit = held == key[off]
            out[off[hit]] = self.merged[at[off[hit]]]
            off = off[~hit & (held >= 0)]
        return out

    def _entry(self, a: np.ndarray, b: np.ndarray, place) -> np.ndarray:
        r = self._ranks(a, b)
        return np.where(r < _NEVER, r << _PLACES | place, _NEVER).astype(np.int32)

    def _merge(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Merge the words in the columns of ``part``, in place: numbers of pieces
        at the letter they begin with, -1 at their other letters."""
        height, n = part.shape
        place = np.arange(height, dtype=np.int32)[:, None]
        agenda = np.full((height, n), _NEVER, np.int32)
        for k in range(height - 1):
            agenda[k] = self._entry(part[k], part[k + 1], k)
        after, before = np.repeat(place + 1, n, axis=1), np.repeat(place - 1, n, axis=1)
        flat, todo, nxt, prv = part.ravel(), agenda.ravel(), after.ravel(), before.ravel()
        limit = np.uint64(min(self.limit, _ONES))
        while True:
            best = agenda.min(axis=0)
            word = np.flatnonzero(best < _NEVER)
            if not len(word):
                break
            i = (best[word] & (1 << _PLACES) - 1).astype(np.int64)
            at = i * n + word
            j = nxt[at].astype(np.int64) * n + word
            end = nxt[j].astype(np.int64)
            if self.limit:
                z = (keys[word] ^ ((i << 32) ^ end).view(np.uint64)) * np.uint64(_MIX)
                drop = (z ^ (z >> np.uint64(32))) * np.uint64(_MORE) < limit
                todo[at[drop]] = _NEVER
                go = np.flatnonzero(~drop)
                word, i, at, j, end = word[go], i[go], at[go], j[go], end[go]
            now = best[word] >> _PLACES
            flat[at], nxt[at] = now, end
            flat[j], todo[j] = -1, _NEVER
            inside = np.flatnonzero(end < height)
            right = np.full(len(word), _PAD, np.int32)
            beyond = end[inside] * n + word[inside]
            right[inside], prv[beyond] = flat[beyond], i[inside]
            front = prv[at].astype(np.int64)
            has = np.flatnonzero(front >= 0)
            front = front[has]
            left = front * n + word[has]
            both = self._entry(np.concatenate([now, flat[left]]), np.concatenate([right, now[has]]), np.concatenate([i, front]))
            todo[at], todo[left] = both[: len(word)], both[len(word) :]
        return part

    def _words(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start: at a text, at a blank after another letter, at and
        after a literal U+2581, which is spelled in bytes and so not taken for a
        blank."""
        blank, mark = codes == 32, codes == ord(_MARK)
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= mark
        start[1:] |= mark[:-1]
        start[first] = True
        return np.flatnonzero(start)

    def _numbers(self, text: str, first: np.ndarray, base: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers by letter, -1 inside pieces, of texts joined in ``text``
        that begin at ``first``; and how many words each has. ``base`` are the
        texts' keys, ``done`` the words that came before."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        part = self.letter[codes]
        start = self._words(codes, first)
        size = np.diff(start, append=len(codes))
        mine = np.searchsorted(first, start, "right") - 1
        lead = np.searchsorted(start, first)
        keys = word_keys(base[mine], np.arange(len(start)) - lead[mine] + done[mine])
        by_size = np.argsort(size, kind="stable")
        size_of = size[by_size]
        low = int(np.searchsorted(size_of, 2))
        for width in _WIDTHS:
            high = int(np.searchsorted(size_of, width, "right"))
            for a in range(low, high, _SLAB):
                words = by_size[a : min(a + _SLAB, high)]
                place = start[words] + np.arange(width)[:, None]
                inside = np.arange(width)[:, None] < size[words]
                slab = np.where(inside, part[np.minimum(place, len(part) - 1)], _PAD)
                part[place[inside]] = self._merge(slab, keys[words])[inside]
            low = high
        for w in by_size[low:].tolist():
            s, at = int(start[w]), int(start[w])
            part[s : s + int(size[w])] = -1
            for p in self.pieces(text[s : s + int(size[w])], int(keys[w])):
                part[at] = self.rank[p] if p in self.rank else self.letter[ord(p)]
                at += len(p)
        return part, np.bincount(mine, minlength=len(first))

    def _ids(self, part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each text has. Letters without a piece are spelled in bytes."""
        kept = np.flatnonzero(part >= 0)
        number = part[kept]
        spelled = np.flatnonzero(number >= len(self.ids))
        ends = np.searchsorted(kept, np.append(first[1:], len(part)))
        if not len(spelled):
            return self.ids[number], np.diff(ends, prepend=0)
        ids = self.ids[np.minimum(number, len(self.ids) - 1)]
        numbers, of = np.unique(number[spelled], return_inverse=True)
        spell = [self.byte[np.frombuffer((self.partial.get(x) or chr(x - self.known)).encode(), np.uint8)] for x in numbers.tolist()]
        many = np.ones(len(ids), np.int64)
        many[spelled] = np.array([len(s) for s in spell])[of]
        total = np.concatenate([[0], np.cumsum(many)])
        out = np.repeat(ids, many)
        for k, s in enumerate(spell):
            at = total[spelled[of == k]]
            for n, b in enumerate(s):
                out[at + n] = b
        return out, np.diff(total[ends], prepend=0)

    def encode_all(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Ids of each text; ``keys`` name the documents. An empty text has none."""
        base = np.array([xxhash.xxh64_intdigest(k.encode(), self.seed) for k in keys], np.uint64)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        done = np.zeros(len(texts), np.int64)
        for some, parts in _runs(texts):
            sizes = np.array([len(p) for p in parts])
            first = np.cumsum(sizes) - sizes
            some = np.array(some)
            part, words = self._numbers("".join(parts), first, base[some], done[some])
            ids, n = self._ids(part, first)
            done[some] += words
            for k, x in zip(some.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[k].append(x)
        none = np.zeros(0, np.int32)
        return [none if not x else x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode(self, text: str, key: str) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids, with the blank in front."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(np.asarray(ids))[1:].tobytes().decode("utf-8", "replace")

    def lossless(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether decoding gives each text back, told by its bytes."""
        want = [(" " + t).encode() if t else b"" for t in texts]
        if self.spelled(np.concatenate([np.zeros(0, np.int32), *ids])).tobytes() == b"".join(want) and all(len(w) == self.size[x].sum() for w, x in zip(want, ids, strict=True)):
            return [True] * len(texts)
        return [self.spelled(x).tobytes() == w for w, x in zip(want, ids, strict=True)]


def _runs(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with the blank in front, as many as hold _LETTERS letters; longer ones
    come in several parts, cut where a word starts."""
    some, parts, letters = [], [], 0
    for k, t in enumerate(texts):
        t = " " + t if t else ""
        at = 0
        while at < len(t):
            cut = _cut(t, at + _LETTERS)
            some.append(k)
            parts.append(t[at:cut])
            letters += cut - at
            at = cut
            if letters >= _LETTERS:
                yield some, parts
                some, parts, letters = [], [], 0
    if some:
        yield some, parts


def _cut(text: str, at: int) -> int:
    while 0 < at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if text[at - 1] != " ":
            return at
        at += 1
    return len(text)


def decode(raw: list[bytes], ids) -> str:
    """The text of a sequence of ids: their bytes without the blank in front."""
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def encoded(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", keep: list[str] | None = None, dropout: float = 0.1, seed: int = 5, model_path: str = MODEL) -> DataFrame:
    """``row`` (the kept columns, all by default), ids, n_ids and lossless.

    The same id, text and seed give the same ids; other seeds give other
    segmentations. ``id_col`` may be an expression, such as id and copy number,
    so that copies vary. lossless: decoding gives the text back. A null text has
    null ids, no count and is lossless; an empty one has no ids; a null id is a
    key of its own. Texts of any length are encoded whole, long ones part by
    part. Candidates of equal score are taken leftmost first. Repeated rows are
    encoded alike. An empty table gives no rows. Other columns pass through
    ``row``, whatever their names.
    """
    shared = to_tasks(docs.sparkSession, load(model_path))

    def work(parts):
        enc = Encoder(shared.value, dropout, seed)
        for all_keys, all_texts in parts:
            for keys, texts in _batches(all_keys, all_texts):
                given = [k for k, t in enumerate(texts) if t is not None]
                plain = [texts[k] for k in given]
                ids = enc.encode_all(plain, [str(keys[k]) for k in given])
                out, same = [None] * len(texts), [True] * len(texts)
                for k, x, ok in zip(given, ids, enc.lossless(plain, ids), strict=True):
                    out[k], same[k] = x, ok
                yield pd.DataFrame({"ids": out, "n_ids": [0 if x is None else len(x) for x in out], "lossless": same})

    udf = F.pandas_udf(_iterated(work), "ids array<int>, n_ids bigint, lossless boolean")
    key = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    kept = ["*"] if keep is None else [F.col(f"`{c}`") for c in keep]
    rows = docs.select(F.struct(*kept).alias("row"), udf(key, F.col(text_col)).alias("e"))
    return rows.select("row", "e.ids", "e.n_ids", "e.lossless")


def _batches(keys: pd.Series, texts: pd.Series) -> Iterator[tuple[list, list]]:
    """Rows whose texts are worth one array; results are handed over as soon."""
    keys, texts = keys.tolist(), texts.tolist()
    at = letters = 0
    for k, t in enumerate(texts, 1):
        letters += len(t) if t is not None else 0
        if letters >= _LETTERS:
            yield keys[at:k], texts[at:k]
            at, letters = k, 0
    if at < len(texts):
        yield keys[at:], texts[at:]


def _iterated(work):
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return work(parts)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return run


def decoded(spark: SparkSession, ids: Column, model_path: str = MODEL) -> Column:
    """Text of an array of ids; null for null."""
    shared = to_tasks(spark, load(model_path)["raw"])

    def work(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else decode(shared.value, v) for v in x], dtype=object)

    return F.pandas_udf(work, "string")(ids)
