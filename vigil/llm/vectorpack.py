"""Operator 11: vector bin packing of training examples.

Every example asks for three things at once: tokens, segments (turns of a
conversation, or the one segment a document is) and loss-bearing tokens.  A
sequence has a limit on each (:class:`Limits`).  Sequences are filled one after
the other by the dot-product heuristic: of the examples that still fit, the one
goes in whose demand vector has the largest product with the room that is left,
each dimension weighted by how much of it the waiting examples ask for.

Where no whole example fits any more, the head of one is cut off to close the
gap exactly; a sequence that a limit other than tokens stops is cut back to a
power of two tokens, which needs no padding, and what is cut off waits again.
With ``cut=False`` only an example beyond a whole sequence is cut.

Packing happens inside the tasks that read the rows: a task keeps at most
``POOL`` waiting examples, so there is no shuffle, nothing passes through the
driver, no key can be hot, and a task that is lost is simply run again.  What is
left at a task's end (less than a sequence) fills sequences of powers of two.

Edge cases: a null text is an empty one, which is its end mark alone; a null
id stays null; repeated rows and equal texts are packed one by one; ties of the
product go to the example that waits longest; very long texts are encoded in
parts of ``PART`` bytes and leave the pool a sequence at a time; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import textops as X
from vigil.llm.common import id_type

END_ID = 1
#: Examples that wait in a task at most.
POOL = 512
#: Bytes of text encoded at once.
PART = 2 << 20
#: Words whose ids a task remembers.
REMEMBERED = 1 << 20


class Limits(NamedTuple):
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


#: Words of one pre-token that no normalization changes.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Letters of Latin-1 by the byte that ends them; marks that end a word after one.
_LETTER_END = np.zeros(256, bool)
_LETTER_END[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True


class WordEncoder:
    """Ids of texts by the ``tokenizers`` file at ``path``, for vocabularies that
    lower the case and drop white space: the ids of a text are those of its words
    one after the other, so each distinct word is encoded once and remembered.
    Words of plain letters are one pre-token and go to the model alone; all
    others take the whole way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        simple = [LETTERS.fullmatch(w) is not None for w in words]
        others = iter(self.full.encode_batch([w for w, one in zip(words, simple) if not one], add_special_tokens=False))
        made = [self._letters(w) if one else next(others).ids for w, one in zip(words, simple)]
        n = np.array([len(x) for x in made], np.int64)
        flat = np.array([i for x in made for i in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used: self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, n)

    def _letters(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(word)]

    @staticmethod
    def _units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts, as :func:`textops.word_spans`, and the bytes to take
        them from.  A mark after a word's last letter is a pre-token, so a word of its own.
        A-Z are lowered, but not beside a special token's string or a combining mark."""
        start, end, first = X.word_spans(data, offs)
        if not (data >= 0xCC).any() or not np.isin(data, [0xCC, 0xCD]).any():
            if not (data == ord("|")).any():
                data = X.LOWER[data]
        last = np.maximum(end - 2, 0)
        letter = _LETTER_END[data[last]]
        wide = (data[last] >= 0x80) & (data[np.maximum(end - 3, 0)] == 0xC3) & (data[last] != 0x97) & (data[last] != 0xB7) & (end - start > 2)
        cut = np.flatnonzero(_MARK[data[end - 1]] & (end - start > 1) & (letter | wide))
        if len(cut) == 0:
            return data, start, end, first
        mark = end[cut] - 1
        first = first + np.searchsorted(cut, first)
        end = end.copy()
        end[cut] = mark
        return data, np.insert(start, cut + 1, mark), np.insert(end, cut + 1, mark + 1), first

    def _part(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        data, start, end, first = self._units(data, offs)
        if len(start) == 0:
            return [np.zeros(0, np.uint32)] * (len(offs) - 1)
        distinct, where, back = np.unique(X.word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            s, e = start[where[new]].tolist(), end[where[new]].tolist()
            self._learn(distinct[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(s, e)])
            at = np.searchsorted(self.known, distinct)
        n = self.n[at][back]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[at][back] - stop + n, n) + np.arange(stop[-1])]
        edge = np.concatenate(([0], stop))[first]
        return [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def encode(self, column) -> Iterator[np.ndarray]:
        """Ids of each text of a string column; null counts as the empty text."""
        data, offs = X.text_buffer(column)
        for _, _, part, at in X.chunks(data, offs, PART):
            if len(at) > 2 or len(part) <= 2 * PART:
                yield from self._part(part, at)
            else:
                yield np.concatenate([self._part(p, np.array([0, len(p)]))[0] for p in _at_spaces(part)])


def _at_spaces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about ``PART`` bytes of one long text that end at white space."""
    a = 0
    while a < len(data):
        b = a + PART
        while b < len(data):
            gaps = np.flatnonzero(X.SPACE[data[b: b + PART]])
            if len(gaps):
                b += int(gaps[0])
                break
            b += PART
        yield data[a: min(b, len(data))]
        a = b


class Example:
    """Ids of an example from ``start`` on, with its segments: ``ends`` are their
    ends in ids of the whole example, ``lossy`` says which of them bear loss."""

    __slots__ = ("key", "ids", "start", "total", "ends", "lossy")

    def __init__(self, key, ids: np.ndarray, ends: list[int] | None = None, lossy: list[bool] | None = None, start: int = 0,
                 total: int | None = None):
        self.key, self.ids, self.start = key, ids, start
        self.total = len(ids) if total is None else total
        self.ends, self.lossy = ends or [self.total], lossy or [True]

    def demand(self, tokens: int | None = None) -> tuple[int, int, int]:
        """(tokens, segments, loss-bearing tokens) of the first ``tokens`` ids."""
        n = len(self.ids) if tokens is None else tokens
        if len(self.ends) == 1:
            return n, 1, n if self.lossy[0] else 0
        a, b, segments, loss, begin = self.start, self.start + n, 0, 0, 0
        for end, bears in zip(self.ends, self.lossy):
            inside = min(end, b) - max(begin, a)
            if inside > 0:
                segments += 1
                loss += inside if bears else 0
            begin = end
            if end >= b:
                break
        return n, segments, loss

    def most(self, room: np.ndarray) -> int:
        """The longest head that fits the room in every dimension."""
        want = min(len(self.ids), int(room[0]))
        if room[1] < 1:
            return 0
        if len(self.ends) == 1:
            return min(want, int(room[2])) if self.lossy[0] else want
        segments, loss, begin, got = int(room[1]), int(room[2]), 0, 0
        for end, bears in zip(self.ends, self.lossy):
            inside = min(min(end, self.start + want) - max(begin, self.start), want - got)
            begin = end
            if inside <= 0:
                continue
            take = min(inside, loss) if bears else inside
            if segments < 1 or take < 1:
                break
            got, segments, loss = got + take, segments - 1, loss - (take if bears else 0)
            if take < inside:
                break
        return got

    def split(self, n: int) -> tuple[Example, Example]:
        return (Example(self.key, self.ids[:n], self.ends, self.lossy, self.start, self.total),
                Example(self.key, self.ids[n:], self.ends, self.lossy, self.start + n, self.total))


class Packer:
    """Fills sequences from a pool of waiting examples; ``closed`` is called with
    the pieces of each sequence."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL, cut: bool = True):
        self.limits, self.pool, self.cut = np.array(limits, np.int64), pool, cut
        self.waiting: list[Example] = []
        self.asks = np.zeros((0, 3), np.int64)

    def add(self, e: Example) -> Iterator[list[Example]]:
        while len(e.ids) > self.limits[0]:
            n = e.most(self.limits)
            head, e = e.split(self._even(n) if n < self.limits[0] else n)
            yield [head]
        if not self.cut:
            while e.most(self.limits) < len(e.ids):  # no sequence takes it whole
                head, e = e.split(e.most(self.limits))
                yield [head]
        self._wait([e])
        while len(self.waiting) > self.pool:
            yield self._fill()

    def finish(self) -> Iterator[list[Example]]:
        while self.waiting:
            yield self._fill()

    @staticmethod
    def _even(n: int) -> int:
        """The largest power of two up to n."""
        return 1 << (n.bit_length() - 1)

    def _wait(self, examples: list[Example]) -> None:
        self.waiting += examples
        self.asks = np.concatenate((self.asks, np.array([e.demand() for e in examples], np.int64)))

    def _take(self, i: int) -> Example:
        self.asks = np.delete(self.asks, i, axis=0)
        return self.waiting.pop(i)

    def _fill(self) -> list[Example]:
        weight = self.asks.mean(axis=0) / (self.limits.astype(float) ** 2)
        room, placed = self.limits.copy(), []
        while room[0] > 0 and len(self.asks):
            fits = (self.asks <= room).all(axis=1)
            if self.cut and room[1] == 1:
                fits &= self.asks[:, 0] == room[0]  # the last segment has to close the gap
            if fits.any():
                score = np.where(fits, self.asks @ (weight * room), -1.0)
                one = self._take(int(np.argmax(score)))
            else:
                one = self._head(room) if self.cut else None
                if one is None:
                    break
            placed.append(one)
            room = room - np.array(one.demand())
        return self._cut_back(placed, int(self.limits[0] - room[0])) if self.cut and room[0] > 0 else placed

    def _head(self, room: np.ndarray) -> Example | None:
        """The head of a waiting example that closes the gap, or comes nearest."""
        best, at = 0, -1
        for i in np.argsort(-self.asks[:, 0], kind="stable").tolist():
            n = self.waiting[i].most(room)
            if n > best:
                best, at = n, i
            if best == room[0] or self.asks[i, 0] <= best:
                break
        if at < 0:
            return None
        one = self._take(at)
        if best == len(one.ids):
            return one
        head, rest = one.split(best)
        self._wait([rest])
        return head

    def _cut_back(self, placed: list[Example], n: int) -> list[Example]:
        surplus = n - self._even(n)
        while surplus:
            last = placed.pop()
            if len(last.ids) > surplus:
                head, rest = last.split(len(last.ids) - surplus)
                placed.append(head)
                last, surplus = rest, 0
            else:
                surplus -= len(last.ids)
            self._wait([last])
        return placed


def packed_schema(key: str, kind: T.DataType) -> T.StructType:
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segments", "loss_tokens")
    return T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.LongType()) for c in longs])


def _packed(examples: Iterable[Example], limits: Limits, cut: bool, kind: pa.DataType, names: list[str],
            rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of the pieces of all examples of a task."""
    packer, keys, out = Packer(limits, cut=cut), [], []
    sequence = TaskContext.get().partitionId() << 40

    def put(pieces: list[Example]) -> None:
        nonlocal sequence
        offset = 0
        for p in pieces:
            n, segments, loss = p.demand()
            keys.append(p.key)
            out.append((p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, sequence, offset, segments, loss))
            offset += n
        sequence += 1

    def batch() -> pa.RecordBatch:
        table = np.array(out, np.int64).reshape(-1, len(names) - 1)
        made = pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c) for c in table.T.copy())], names=names)
        keys.clear()
        out.clear()
        return made

    for e in examples:
        for pieces in packer.add(e):
            put(pieces)
        if len(out) >= rows:
            yield batch()
    for pieces in packer.finish():
        put(pieces)
    yield batch()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack_documents(docs: DataFrame, vocab_path: str, limits: Limits = Limits(), end_id: int = END_ID, cut: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, segments, loss_tokens.  Every id of a document bears loss."""
    kind = id_type(docs)
    schema = packed_schema("doc_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)

        def examples() -> Iterator[Example]:
            for b in batches:
                for a in range(0, b.num_rows, 256):
                    some = b.slice(a, 256)
                    for key, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1))):
                        yield Example(key, np.append(ids, np.uint32(end_id)))

        yield from _packed(examples(), limits, cut, _arrow_type(kind), schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_conversations(turns: DataFrame, vocab_path: str, limits: Limits = Limits(), end_id: int = END_ID, learn: str = "assistant",
                       cut: bool = False) -> DataFrame:
    """Pieces of all conversations: conv_id and the columns of
    :func:`pack_documents`.  A turn (its ids, then the end mark) is a segment;
    those of role ``learn`` bear loss.  Turns go by (turn, role, text), null first."""
    kind = id_type(turns, "conv_id")
    schema = packed_schema("conv_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)

        def examples() -> Iterator[Example]:
            key, ids, ends, lossy, seen = None, [], [], [], False
            for b in batches:
                for k, role, one in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.encode(b.column(2))):
                    if seen and k != key:
                        yield Example(key, np.concatenate(ids), ends, lossy)
                        ids, ends, lossy = [], [], []
                    key, seen = k, True
                    ids.append(np.append(one, np.uint32(end_id)))
                    ends.append((ends[-1] if ends else 0) + len(ids[-1]))
                    lossy.append(role == learn)
            if seen:
                yield Example(key, np.concatenate(ids), ends, lossy)

        yield from _packed(examples(), limits, cut, _arrow_type(kind), schema.names)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return (turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "role", "text").mapInArrow(run, schema))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
