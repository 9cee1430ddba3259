"""Operator 10: language identification by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (one to
three letters, with word edges), counted over labelled texts.  A text's own
``GRAMS`` most frequent n-grams are compared with each profile: the sum over
them of the distance between the two ranks, or the whole profile length for an
n-gram that the profile lacks.  The least sum wins.

Profiles are fitted on at most ``PER_LANGUAGE`` labelled texts of each
language (a documented bound, chosen by hash of the id); every text is judged
whole.  Profiles are bounded by languages x ``PROFILE``.

Edge cases: a null text or one without a letter is ``und`` with score 0;
without any labelled text all are ``und``; of equally near languages the first
by name is taken; ties of n-gram counts are broken by the n-gram; null or
repeated ids and repeated rows are judged row by row; a very long text is counted
whole, in memory in proportion to it; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import small_batches

PER_LANGUAGE = 600
PROFILE = 400
GRAMS = 300
SALTS = 256

_BITS = 18  # all letters lie below 2**18
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else."""
    global _LETTER
    if _LETTER is None:
        table = np.zeros(0x110000, np.int64)
        for c in range(1 << _BITS):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers: two bits of length, then letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = np.zeros(len(points) + 2, np.int64)
    chars[1:-1] = letters()[points]
    used = chars != 0
    used[1:] |= chars[:-1] != 0  # one break after each word
    used[0] = True
    chars = chars[used]
    single = chars[chars != 0]
    if len(single) == 0:
        return single
    pair = (chars[:-1] << _BITS) | chars[1:]
    pair = pair[pair != 0]
    triple = ((chars[:-2] << (2 * _BITS)) | (chars[1:-1] << _BITS) | chars[2:])[chars[1:-1] != 0]
    return np.concatenate((single | (1 << 60), pair | (2 << 60), triple | (3 << 60)))


def most_frequent(keys: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent values, most frequent first, ties by value."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    value, count = keys[edge], np.diff(np.append(edge, len(keys)))
    if len(count) > n:
        least = np.partition(count, len(count) - n)[len(count) - n]
        keep = count >= least
        value, count = value[keep], count[keep]
    return value[np.argsort(-count, kind="stable")][:n]


def _texts(column) -> Iterator[str]:
    for t in column:
        yield t.as_py() or ""


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, gram, n = [], [], []
        by: dict[str, list[np.ndarray]] = {}
        for name, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            by.setdefault(name, []).append(grams(text))
        for name, parts in by.items():
            value, count = np.unique(np.concatenate(parts), return_counts=True)
            lang += [name] * len(value)
            gram.append(value)
            n.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(gram) if gram else [], pa.int64()),
                                          pa.array(np.concatenate(n) if n else [], pa.int64())], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """language -> n-grams by rank, from columns doc_id, text, lang."""
    small_batches(labelled.sparkSession)
    order = [F.col("h"), F.col("doc_id")]
    chosen = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    for salts in (SALTS, 1):  # the first of each salt, then of these: no task gets a language's rows
        first = Window.partitionBy("lang", F.pmod(F.shiftright("h", 20), F.lit(salts))).orderBy(*order)
        chosen = chosen.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("doc_id", "lang", "h")
    chosen = chosen.select("doc_id", "lang").distinct()
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= size).collect()
    out: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Judge:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]], n: int = GRAMS):
        self.names, self.n = sorted(profiles), n
        self.penalty = max([len(p) for p in profiles.values()], default=1)
        self.known = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.known, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def __call__(self, text: str) -> tuple[str, float]:
        keys = grams(text)
        if len(keys) == 0 or not self.names:
            return "und", 0.0
        top = most_frequent(keys, self.n)
        at = np.searchsorted(self.known, top)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != top)] = len(self.known)
        place = self.rank[:, at]
        distance = np.where(place < 0, self.penalty, np.minimum(np.abs(place - np.arange(len(top))), self.penalty)).sum(axis=1)
        best = int(np.argmin(distance))
        if len(distance) == 1:
            return self.names[0], float(1 - distance[0] / (self.penalty * len(top)))
        second = np.partition(distance, 1)[1]
        return self.names[best], float((second - distance[best]) / second) if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    small_batches(docs.sparkSession)
    judge = Judge(profiles)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t) for t in _texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text").mapInArrow(
        judged, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", "lang")
    return identify(own, learn_profiles(own.where(~held_out(F.col("doc_id"), 3, 1))))
