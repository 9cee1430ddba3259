"""Operator 7: removal of repeated passages by sharded phrase automata.

A window is ``width`` consecutive words of one text; a word goes if a window
over it stands, with the same words, anywhere else too.

1. Anchors.  Each window is represented by its anchor, the run of ``ANCHOR``
   words with the least hash inside it, so equal windows have equal anchors and
   about one word in fourteen starts one.  Each part keeps at most two of an
   anchor before they are counted.  Anchors that occur once are done.
2. Confirmation.  The words of recurring anchors are counted over the whole
   corpus, not their hashes; phrases found at two places or more are stored with
   the parts that hold them.  So are the windows around them seen once.
3. Location.  Each part of the documents (some MB of text) has its shard of the
   stored phrases, compiled into Aho-Corasick automata of at most
   ``SHARD_PHRASES`` phrases.  All its documents stream through them, which alone
   finds the places; the windows around each go, but for those seen once.

Hashes and phrases travel packed, few rows for many of them.  Whole windows are
told apart by 64 bits inside a bucket; a bucket is chosen by a second, independent
hash and has a fixed expected size, so that the chance of two different windows
being taken for equal stays negligible at any corpus size.  An anchor, phrase or
window in a third of all documents is at most two entries per part.

Edge cases: a null or empty text has no words; a text shorter than a window
keeps all words; null or repeated ids and repeated rows are separate documents
(a repeated row has all its windows elsewhere); a very long text is read whole
in one task; an empty table gives no rows;
other columns of the input are ignored or, for :func:`without_repeats`, carried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import textops as X
from vigil.llm.common import part_count, small_batches, stored

WIDTH = 35
ANCHOR = 8
#: Text of a part, and the fewest parts of a table.
PART_BYTES, LEAST_PARTS = 8 << 20, 24
#: Phrases of one automaton; each costs about 2 KB.
SHARD_PHRASES = 40_000

_ANCHORS = "part int, hashes binary"
_PACKED = "bucket int, part int, hashes binary"
_FOUND = "bucket int, part int, hashes binary, phrases binary"
_CONFIRMED = "part int, hashes binary, phrases binary"
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
_POS = np.uint64((1 << 26) - 1)


def _window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word numbers at which a window of one text starts."""
    if len(first) < 2 or first[-1] < width:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(first[-1])
    return at[at + width <= end]


def anchor_positions(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Distinct word numbers of the anchors of the windows at ``starts``."""
    if len(starts) == 0:
        return starts
    span = width - ANCHOR + 1
    key = (grams & ~_POS) | (np.arange(len(grams), dtype=np.uint64) & _POS)
    least, size = key, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    low = np.minimum(least[starts], least[starts + span - size])
    step = ((low & _POS).astype(np.int64) - starts) & int(_POS)
    return np.unique(starts + step)


def _packed(part: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, part, hashes) of values given with their part and bucket."""
    order = np.lexsort((part, bucket))
    part, bucket, value = part[order], bucket[order], value[order]
    edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])))) if len(part) else np.zeros(0, np.int64)
    offs = np.append(edge, len(value)).astype(np.int32) * 8
    blobs = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(value))])
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array(part[edge], pa.int32()), blobs], names=["bucket", "part", "hashes"])


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of packed rows, and the row of each."""
    rows = [np.frombuffer(b, np.uint64) for b in column.to_pylist()]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _twice(part: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts and values, a value at most twice for a part."""
    order = np.lexsort((value, part))
    part, value = part[order], value[order]
    third = np.zeros(len(value), bool)
    third[2:] = (value[2:] == value[:-2]) & (part[2:] == part[:-2])
    return part[~third], value[~third]


def _emit_anchors(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = X.text_buffer(batch.column(1))
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            got_part, got = [], []
            for lo, hi, piece, at in X.chunks(data, offs):
                s, e, first = X.word_spans(piece, at)
                grams = X.run_hashes(X.word_hashes(piece, s, e), ANCHOR)
                pos = anchor_positions(grams, _window_starts(first, width), width)
                doc = np.searchsorted(first, pos, "right") - 1
                got.append(grams[pos])
                got_part.append(parts[lo:hi][doc])
            if got and sum(map(len, got)):
                part, value = _twice(np.concatenate(got_part).astype(np.int64), np.concatenate(got))
                yield _packed(part, np.zeros(len(part), np.int64), value).select(["part", "hashes"])
    return emit


def _part_anchors(buckets: int):
    def reduce(group: pa.Table) -> pa.Table:
        value, row = _unpacked(group["hashes"])
        part, value = _twice(group["part"].to_numpy()[row].astype(np.int64), value)
        return pa.Table.from_batches([_packed(part, ((value >> X.U64(32)) % X.U64(buckets)).astype(np.int64), value)])
    return reduce


def anchors_by_bucket(split: DataFrame, width: int, buckets: int) -> DataFrame:
    """The anchors of the texts of ``split`` (part, text), packed by bucket and
    part; each part gives at most two of an anchor, however often it has it."""
    found = split.select("part", "text").mapInArrow(_emit_anchors(width), _ANCHORS)
    return found.groupBy("part").applyInArrow(_part_anchors(buckets), _PACKED)


def _recurring(group: pa.Table) -> pa.Table:
    value, row = _unpacked(group["hashes"])
    part = group["part"].to_numpy()[row]
    _, back, n = np.unique(value, return_inverse=True, return_counts=True)
    keep = n[back] > 1
    part, value = part[keep].astype(np.int64), value[keep]
    return pa.Table.from_batches([_packed(part, np.zeros(len(part), np.int64), value)]).select(["part", "hashes"])


def _pieces(texts):
    """Chunks of texts: first and end text, bytes, offsets, words' spans, first
    word of each text, word hashes."""
    for lo, hi, piece, at in X.chunks(*X.text_buffer(texts)):
        s, e, first = X.word_spans(piece, at)
        yield lo, hi, piece, at, s, e, first, X.word_hashes(piece, s, e)


def _holding(located: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The windows that hold a located anchor."""
    seen = np.concatenate(([0], np.cumsum(located)))
    return starts[seen[starts + width - ANCHOR + 1] > seen[starts]]


def _phrase_rows(part: int, phrases: dict[int, dict[bytes, int]], buckets: int) -> pa.RecordBatch:
    """Rows of phrases by the bucket of their hash, one a line; a phrase that
    the part holds more than once stands there twice."""
    lines: dict[int, list[bytes]] = {}
    for h, held in phrases.items():
        line = lines.setdefault((h >> 32) % buckets, [])
        for phrase, n in held.items():
            line.extend([phrase] * min(n, 2))
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([b""] * n, pa.binary()),
                                       pa.array([b"\n".join(v) for v in lines.values()], pa.binary())], names=["bucket", "part", "hashes", "phrases"])


def _emit_found(width: int, buckets: int):
    """The windows of a part that hold a recurring anchor, and the anchors' words."""
    def emit(key, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        part = key[0].as_py()
        recurring = np.unique(_unpacked(anchors["hashes"])[0])
        value, bucket, phrases = [], [], {}
        for _, _, piece, _, s, e, first, words in _pieces(docs["text"]):
            starts, grams = _window_starts(first, width), X.run_hashes(words, ANCHOR)
            hit = np.isin(grams, recurring)
            at = _holding(hit, starts, width)
            value.append(X.run_hashes(words, width)[at])
            bucket.append((X.run_hashes(words, width, second=True)[at] % X.U64(buckets)).astype(np.int64))
            place = np.flatnonzero(hit)
            place = place[place + ANCHOR <= first[np.searchsorted(first, place, "right")]]
            raw = piece.tobytes()
            for h, a, b in zip(grams[place].tolist(), s[place].tolist(), e[place + ANCHOR - 1].tolist()):
                held = phrases.setdefault(h, {})
                phrase = b" ".join(raw[a:b].split())
                held[phrase] = held.get(phrase, 0) + 1
        value = np.concatenate(value) if value else np.zeros(0, np.uint64)
        bucket = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        bucket, value = _twice(bucket, value)
        windows = _packed(np.full(len(value), part, np.int64), bucket, value)
        windows = windows.append_column("phrases", pa.array([b""] * len(windows), pa.binary()))
        return pa.Table.from_batches([windows, _phrase_rows(part, phrases, buckets)])
    return emit


def _confirmed(group: pa.Table) -> pa.Table:
    """For each part its windows seen once in all and its phrases that stand, by
    their words, at two places or more."""
    value, row = _unpacked(group["hashes"])
    _, back, n = np.unique(value, return_inverse=True, return_counts=True)
    once = n[back] == 1
    part = group["part"].to_numpy()
    single = _packed(part[row[once]].astype(np.int64), np.zeros(int(once.sum()), np.int64), value[once]).select(["part", "hashes"])
    single = single.append_column("phrases", pa.array([b""] * len(single), pa.binary()))
    lines = [(p, line.split(b"\n")) for p, line in zip(part.tolist(), group["phrases"].to_pylist()) if line]
    places = Counter(chain.from_iterable(line for _, line in lines))
    kept = [(p, b"\n".join({x for x in line if places[x] > 1})) for p, line in lines]
    kept = [(p, line) for p, line in kept if line]
    held = pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.int32()), pa.array([b""] * len(kept), pa.binary()),
                                       pa.array([line for _, line in kept], pa.binary())], names=["part", "hashes", "phrases"])
    return pa.Table.from_batches([single, held])


def _automata(phrases: list[bytes]) -> list:
    import ahocorasick
    out = []
    for k in range(0, len(phrases), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in phrases[k: k + SHARD_PHRASES]:
            automaton.add_word(f" {p.decode('latin-1')} ", len(p) + 2)
        automaton.make_automaton()
        out.append(automaton)
    return out


def _framed(raw: bytes, at: np.ndarray) -> bytes:
    """The texts with one blank between words, each framed by blanks and with a
    zero byte between texts, so that no phrase spans two."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        text = raw[a:b].translate(_BLANKS).strip(b" ")
        while b"  " in text:
            text = text.replace(b"  ", b" ")
        out.append(b" " + text + b" ")
    return b"\0".join(out)


def _remove(width: int, carried: list[str], with_text: bool, names: list[str]):
    def remove(key, docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        single = np.unique(_unpacked(confirmed["hashes"])[0])
        automata = _automata(sorted({p for line in confirmed["phrases"].to_pylist() if line for p in line.split(b"\n")}))
        n_words, n_removed, digest, kept_text = [], [], [], []
        for lo, hi, piece, at, s, e, first, words in _pieces(docs["text"]):
            framed = _framed(piece.tobytes(), at)
            lens = e - s
            texts = np.repeat(np.arange(hi - lo), np.diff(first))
            begin = np.cumsum(lens + 1) - (lens + 1) + 2 * texts + 1 + _empty_before(first, texts)
            located = np.zeros(len(words), bool)
            if automata and len(words):
                text = framed.decode("latin-1")
                ends = [end + 1 - size for a in automata for end, size in a.iter(text)]
                located[np.searchsorted(begin, np.array(ends, np.int64) + 1)] = True
            windows = _holding(located, _window_starts(first, width), width)
            if len(windows):
                windows = windows[~np.isin(X.run_hashes(words, width)[windows], single)]
            cover = np.zeros(len(words) + 1, np.int64)
            cover[windows] += 1
            cover[windows + width] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            stop = begin + lens
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                gone = b - a - int(np.count_nonzero(keep[a:b]))
                edge = np.flatnonzero(np.diff(keep[a:b].astype(np.int8), prepend=0, append=0)) + a
                text = b" ".join([framed[x:y] for x, y in zip(begin[edge[::2]].tolist(), stop[edge[1::2] - 1].tolist())])
                n_words.append(b - a)
                n_removed.append(gone)
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept_text.append(text.decode("utf-8", "replace") if gone else None)
        cols = [docs[c] for c in carried] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        if with_text:
            # a text that loses nothing stays as it was
            own = docs["text"].to_pylist()
            cols.append(pa.array([t if k is None else k for t, k in zip(own, kept_text)], pa.string()))
        return pa.table(cols, names=names)
    return remove


def _empty_before(first: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Texts without words before each word's text: such a text is framed as
    two blanks, where others have one blank more than words."""
    return np.concatenate(([0], np.cumsum(np.diff(first) == 0)))[texts]


def without_repeats(docs: DataFrame, width: int = WIDTH, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Per document the carried columns (doc_id), n_words, n_removed,
    kept_sha256 and, if asked for, ``kept_text``: the kept words joined by one
    blank, or the text as it was if it loses none."""
    spark = docs.sparkSession
    small_batches(spark)
    carried = carry or ["doc_id"]
    parts = max(LEAST_PARTS, part_count(docs, "text", PART_BYTES))
    held = [f"c{i}" for i in range(len(carried))]  # own names, whatever the input calls its columns
    split = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(parts)).cast("int").alias("part"), "text",
                        *[F.col(c).alias(h) for c, h in zip(carried, held)])
    anchors = anchors_by_bucket(split, width, parts)
    recurring = stored(anchors.groupBy("bucket").applyInArrow(_recurring, "part int, hashes binary"), "recurring-anchors")
    found = (split.select("part", "text").groupBy("part").cogroup(recurring.groupBy("part"))
             .applyInArrow(_emit_found(width, parts), _FOUND))
    confirmed = stored(found.groupBy("bucket").applyInArrow(_confirmed, _CONFIRMED), "confirmed-passages")
    schema = T.StructType([docs.schema[c] for c in carried] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        + ([T.StructField("kept_text", T.StringType())] if with_text else []))
    return split.groupBy("part").cogroup(confirmed.groupBy("part")).applyInArrow(
        _remove(width, held, with_text, [f.name for f in schema.fields]), schema)
