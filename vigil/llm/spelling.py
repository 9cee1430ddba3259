"""Operator 12: spelling variants by bidirectional FM-index search schemes.

Two words are near if one inserted, deleted or replaced code point makes them
equal.  Cut a word in two halves: whatever the error, one half of it stands
unchanged at its end of the near word.  So a shard of the vocabulary is all
words that have one of the shard's halves at their left (or right) end, and a
word is looked up in the shard of its left half and in that of its right half.

In a shard the words, each between delimiters, are indexed by two FM-indexes,
of the text and of the reversed text, with synchronised intervals of suffix
ranks (:class:`BiIndex`), so that a pattern grows at either end.  Two search
schemes run for all words of the shard at once, as arrays of intervals: the left
half is matched exactly from its last code point to its first and on to the
delimiter, then extended to the right allowing one error; the right half is
matched forwards to the delimiter, then extended to the left allowing one error.
A match between delimiters is one suffix rank, which is the word's number.

Nothing grows without bound: a shard holds about ``SHARD_ROWS`` words, a half that
more words share is split into slices (its words are looked up in each slice),
and each shard sends on one row per word and side: how many words are near and
the best of them.  Pairs are never written.

Edge cases: a null or empty text has no words; a null ``doc_id`` damages no word
(see :func:`word_counts`); repeated rows count again; ties of ``n`` go to the
word that is smaller in code-point order; very long texts are read in parts that
end between words, very long words are words; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import maybe_broadcast, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: A run whose checksum this divides loses a code point.
DAMAGED = 199
#: Words of a shard, about; words of one half beyond which it is split.
SHARD_ROWS = 40_000
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 400_000
#: Words searched at once.
QUERIES = 4096


def _runs(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    a = 0
    while a < len(text):
        b = a + size
        if b < len(text):
            end = GAP.search(text, b)
            b = end.start() if end else len(text)
        yield RUN.findall(text, a, b)
        a = b


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n): occurrences of each word of ``least_length`` code points or more.

    Words are runs of Latin letters with A-Z in lower case.  With ``damaged``, a run
    loses the code point h % length where that number divides h, the checksum of
    ``<doc_id>:<run>``; rows without id are left as they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        def add(found: Counter, crc: int | None) -> None:
            lowered: dict[str, int] = {}
            for w, n in found.items():
                w = w.lower() if w.isascii() else w.translate(LOWER)
                lowered[w] = lowered.get(w, 0) + n
            for w, n in lowered.items():
                if len(w) < least_length:
                    continue
                if crc is not None:
                    h = zlib.crc32(w.encode(), crc)
                    if h % damaged == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < least_length:
                            continue
                total[w] += n

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text, key = text.as_py(), key.as_py()
                if not text:
                    continue
                crc = None if key is None or damaged is None else zlib.crc32(f"{key}:".encode())
                for some in _runs(text):
                    add(Counter(some), crc)
                    if len(total) > HELD_WORDS:
                        yield flush()
        yield flush()

    return (docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Ranks:
    """Wavelet matrix of a Burrows-Wheeler transform: how often each symbol, and
    how many smaller ones, stand before a rank; both in one pass over the bits."""

    def __init__(self, bwt: np.ndarray, bits: int, first: np.ndarray):
        self.bits, self.first, self.ones, self.zeros = bits, first, [], []
        seq = bwt
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        symbols = np.arange(len(first))
        self.begin = np.zeros(len(first), np.int64)
        nil = np.zeros(len(first), np.int64)
        self.begin = self._down(symbols, nil, nil)[0]

    def _down(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(lo), np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = ((c >> level) & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            less += np.where(bit, (hi - lo) - (b - a), 0)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi, less

    def step(self, c: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put symbol ``c`` before the pattern: (new start, new size, smaller symbols)."""
        a, b, less = self._down(c, lo, lo + size)
        return self.first[c] + a - self.begin[c], b - a, less

    def all_steps(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """As :meth:`step` for every symbol that occurs: (row, symbol, start, size, smaller symbols)."""
        row, a, b = np.arange(len(lo)), lo, lo + size
        symbol, less = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            oa, ob = ones[a].astype(np.int64), ones[b].astype(np.int64)
            za, zb = a - oa, b - ob
            left, right = zb > za, ob > oa
            less_right = less + (zb - za)
            row = np.concatenate((row[left], row[right]))
            symbol = np.concatenate((symbol[left] << 1, (symbol[right] << 1) | 1))
            less = np.concatenate((less[left], less_right[right]))
            a, b = np.concatenate((za[left], zeros + oa[right])), np.concatenate((zb[left], zeros + ob[right]))
        return row, symbol, self.first[symbol] + a - self.begin[symbol], b - a, less


def _transform(words: list[np.ndarray]) -> np.ndarray:
    """Burrows-Wheeler transform of sorted words between delimiters (symbol 0);
    a delimiter ranks by the word after it, the last one first."""
    k, none = len(words), np.zeros(1, np.int64)
    text = np.concatenate([none, *(x for w in words for x in (w, none))])
    n = len(text)
    rank = text + k + 1
    rank[np.flatnonzero(text == 0)] = np.concatenate((np.arange(1, k + 1), [0]))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-width or None] = rank[width:] if width < n else 0
        key = rank * (n + k + 1 + int(text.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        dense = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if dense[-1] == n - 1:
            return text[order - 1]
        width *= 2


class BiIndex:
    """Bidirectional FM-index of words between delimiters.  A pattern's state is
    its interval's start among the suffixes of the text, its start among those of
    the reversed text, and the size that both have."""

    def __init__(self, words: list[str], alphabet: str):
        """``words``: distinct, in code-point order; ``alphabet``: their code points
        and those of the words to look up, in order."""
        self.symbol = {c: i + 1 for i, c in enumerate(alphabet)}
        coded = [self.code(w) for w in words]
        back = [self.code(w[::-1]) for w in sorted(words, key=lambda w: w[::-1])]
        bits = max(1, len(alphabet).bit_length())
        ahead, behind = _transform(coded), _transform(back)
        self.n = len(ahead)
        first = np.concatenate(([0], np.cumsum(np.bincount(ahead, minlength=1 << bits))))[:-1]
        self.left, self.right = Ranks(ahead, bits, first), Ranks(behind, bits, first)

    def code(self, word: str) -> np.ndarray:
        return np.array([self.symbol[c] for c in word], np.int64)

    def _exact(self, symbols: np.ndarray, lengths: np.ndarray, left: bool) -> np.ndarray:
        """States of the patterns whose symbols are put on one by one, to the left or right."""
        q = len(lengths)
        state = np.stack((np.zeros(q, np.int64), np.zeros(q, np.int64), np.full(q, self.n, np.int64)))
        for i in range(symbols.shape[1]):
            on = np.flatnonzero((i < lengths) & (state[2] > 0))
            state[:, on] = self._grow(symbols[on, i], state[:, on], left)
        return state

    def _grow(self, c: np.ndarray, state: np.ndarray, left: bool) -> np.ndarray:
        a, b, size = state
        if left:
            start, size, less = self.left.step(c, a, size)
            return np.stack((start, b + less, size))
        start, size, less = self.right.step(c, b, size)
        return np.stack((a + less, start, size))

    def _grow_all(self, state: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, size = state
        if left:
            row, c, start, size, less = self.left.all_steps(a, size)
            return row, c, np.stack((start, b[row] + less, size))
        row, c, start, size, less = self.right.all_steps(b, size)
        return row, c, np.stack((a[row] + less, start, size))

    def one_error(self, words: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, number of an indexed word): all indexed words that
        differ by one error in the right half (``left=False``: the left half is
        exact) or in the left half (``left=True``: the right half is exact)."""
        q, n = len(words), np.array([len(w) for w in words], np.int64)
        half = n - n // 2 if left else n // 2
        width = int(n.max())
        exact = np.zeros((q, width + 1), np.int64)  # the half, from the middle outwards, then the delimiter
        rest = np.zeros((q, width + 3), np.int64)  # the other half, from the middle outwards, then the delimiter
        for i, w in enumerate(words):
            s = self.code(w)
            h = int(half[i])
            near, far = (s[len(s) - h:], s[: len(s) - h][::-1]) if left else (s[:h][::-1], s[h:])
            exact[i, :len(near)], rest[i, :len(far)] = near, far
        length = n - half
        state = self._exact(exact, half + 1, not left)
        live = np.flatnonzero(state[2] > 0)
        # states without an error, and with one: row, place in ``rest``, interval
        row0, at0, state0 = live, np.zeros(len(live), np.int64), state[:, live]
        row1, at1, state1 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
        rows, places = [], []
        while len(row0) or len(row1):
            # one error made: go on exactly
            want = rest[row1, at1]
            state1 = self._grow(want, state1, left)
            live = state1[2] > 0
            done = live & (at1 == length[row1])
            rows.append(row1[done])
            places.append(state1[0, done])
            live &= ~done
            row1, at1, state1 = row1[live], at1[live] + 1, state1[:, live]
            # no error yet: leave out a symbol (the last of equal ones) ...
            inside = at0 < length[row0]
            gone = inside & (rest[row0, at0] != rest[row0, at0 + 1])
            new_row, new_at, new_state = [row1, row0[gone]], [at1, at0[gone] + 1], [state1, state0[:, gone]]
            # ... or go on with every symbol there is: the right one, another one, one too many
            src, c, grown = self._grow_all(state0, left)
            row, at = row0[src], at0[src]
            right = c == rest[row, at]
            other, within = ~right & (c != 0), at < length[row]
            for change, to in ((other & within, 1), (other, 0)):
                new_row.append(row[change])
                new_at.append(at[change] + to)
                new_state.append(grown[:, change])
            on = right & within
            row0, at0, state0 = row[on], at[on] + 1, grown[:, on]
            row1, at1, state1 = np.concatenate(new_row), np.concatenate(new_at), np.concatenate(new_state, axis=1)
        return np.concatenate(rows), np.concatenate(places) - 1


def _look_up(side: str, index: dict[str, int], asked: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, list[str]]]:
    """For slices of ``asked``: the words, their near words' count, the best's n (0: none) and the best."""
    words = sorted(index)
    count = np.array([index[w] for w in words], np.int64)
    bi = BiIndex(words, "".join(sorted(set("".join(words)) | set("".join(asked)))))
    for lo in range(0, len(asked), QUERIES):
        some = asked[lo: lo + QUERIES]
        row, found = bi.one_error(some, side == "R")
        if side == "R":  # those that share the left half too were found by it
            keep = np.array([not words[j].startswith(some[i][: len(some[i]) // 2]) for i, j in zip(row.tolist(), found.tolist())], bool)
            row, found = row[keep], found[keep]
        order = np.lexsort((found, -count[found], row))
        row, found = row[order], found[order]
        near = np.bincount(row, minlength=len(some))
        top, at = np.zeros(len(some), np.int64), np.unique(row, return_index=True)
        best: list[str | None] = [None] * len(some)
        for i, j in zip(at[0].tolist(), found[at[1]].tolist()):
            best[i], top[i] = words[j], count[j]
        yield some, near, top, best


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each word of ``words`` (word, n; distinct, at least ``least_length`` code
    points): word, n, n_near, near (the near word of largest n) and near_n."""
    w, m = F.col("word"), F.char_length("word")
    least = least_length // 2
    left = F.array(*[F.struct(F.lit("L").alias("side"), F.left(w, h).alias("half"), (h == F.floor(m / 2)).alias("asks"))
                     for h in (F.floor((m - 1) / 2).cast("int"), F.floor((m + 1) / 2).cast("int"))])
    right = F.array(*[F.struct(F.lit("R").alias("side"), F.right(w, h).alias("half"), (h == F.floor((m + 1) / 2)).alias("asks"))
                      for h in (F.floor(m / 2).cast("int"), F.floor((m + 2) / 2).cast("int"))])
    rows = (words.select("word", "n", F.explode(F.concat(left, right)).alias("k")).select("word", "n", "k.*")
            .where((F.char_length("half") >= least) & (F.char_length("half") <= m)))
    rows = stored(rows, "spelling-halves")
    hot = stored(rows.groupBy("side", "half").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > shard_rows), "spelling-hot")
    shards = max(1, -(-rows.count() // shard_rows))
    plain = rows.join(maybe_broadcast(hot), ["side", "half"], "left_anti").select(
        F.concat("side", F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("string")).alias("shard"), "word", "n", F.lit(True).alias("indexed"), "asks")
    split = rows.join(maybe_broadcast(hot), ["side", "half"]).withColumn("_k", F.ceil(F.col("_rows") / shard_rows).cast("int"))
    name = F.concat_ws("#", "side", "half", F.col("_slice").cast("string"))
    held = split.withColumn("_slice", F.pmod(F.xxhash64("word"), F.col("_k")).cast("int")).select(
        name.alias("shard"), "word", "n", F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    asking = split.where("asks").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        name.alias("shard"), "word", "n", F.lit(False).alias("indexed"), "asks")
    schema = "word string, n long, n_near long, near_n long, near string"

    def search(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        index, asked = {}, {}
        for word, n, indexed, asks in zip(*(group.column(c).to_pylist() for c in ("word", "n", "indexed", "asks"))):
            if indexed:
                index[word] = n
            if asks:
                asked[word] = n
        parts = []
        names = ["word", "n", "n_near", "near_n", "near"]
        if index and asked:
            for some, near, top, best in _look_up(key[0].as_py()[0], index, sorted(asked)):
                parts.append(pa.table([pa.array(some), pa.array([asked[x] for x in some], pa.int64()), pa.array(near.astype(np.int64)),
                                       pa.array(top), pa.array(best, pa.string())], names=names))
        elif asked:
            some = sorted(asked)
            nil = pa.array([0] * len(some), pa.int64())
            parts.append(pa.table([pa.array(some), pa.array([asked[x] for x in some], pa.int64()), nil, nil, pa.nulls(len(some), pa.string())], names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], pa.string()), *[pa.array([], pa.int64())] * 3, pa.array([], pa.string())], names=names)

    found = plain.unionByName(held).unionByName(asking).groupBy("shard").applyInArrow(search, schema)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    return (found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of (word, form): the last of a chain of at most ``steps`` forms, by
    doubling the step; joins are many to one."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return at


def spelling_forms(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO,
                   damaged: int | None = DAMAGED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs``."""
    words = stored(word_counts(docs, least_length, damaged).where(F.col("n") >= least_count), "spelling-words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = stored(near_words(words, least_length, shard_rows).select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    # each form is at least ``ratio`` times as frequent as the word before it
    steps = int(math.log(max(most / least_count, 1), ratio)) + 1
    last = roots(found.where(F.col("form").isNotNull()).select("word", "form"), steps)
    return (found.join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
