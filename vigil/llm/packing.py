"""Operator 6: best-fit packing after Martello-Toth dominance reduction.

Documents become token ids; longer ones than a sequence are cut; the pieces
are packed into sequences of ``capacity`` tokens.

The instance of the packing problem is the histogram of piece lengths: at most
``capacity`` counts whatever the corpus holds.  That histogram (and nothing
else) goes to the driver, where :func:`reduce_dominated` fixes small sets that
dominate every alternative and :func:`best_fit` packs the rest, both by whole
counts.  The result is a list of patterns with multiplicities, bounded by the
square of the capacity.  Each piece then finds its place on its own from its
rank among the pieces of its length; ranks come from per-part counts, so no
length class is ever in one task.

Edge cases: a null text is an empty one, which packs as the end mark alone; a
null ``doc_id`` stays null; repeated rows are packed one by one; a very long text is
encoded whole and cut; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import textops as X
from vigil.llm.common import id_type, running_offsets, small_batches, stored

CAPACITY = 1024
END_ID = 2

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")


class Encoder:
    """Token ids of many texts at once, equal to those of the ``tokenizers``
    file at ``path``.

    Pre-tokens never cross a word boundary, so a batch is encoded by its
    distinct words (each with the blank or line break before it) and the ids
    are gathered per text.  Texts with runs of white space, other white space
    or a special token's string take the plain way."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        byte_of = self._byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self.bpe = tiktoken.Encoding("by_words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for tok, i in ranks.items():
            self.width[i] = len(tok)

    @staticmethod
    def _byte_alphabet() -> dict[str, int]:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def plain(self, text: bytes) -> np.ndarray:
        s = text.decode("utf-8", "replace")
        if any(x in text for x in self.special):
            return np.array(self.full.encode(s, add_special_tokens=False).ids, np.uint32)
        return np.array(self.bpe.encode_ordinary(s), np.uint32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of the buffer."""
        n = len(offs) - 1
        start, end, first = X.word_spans(data, offs)
        raw = data.tobytes()
        words = np.diff(first)
        length = np.diff(offs)
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(X.SPACE[data], out=solid[1:])
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data == 9) | ((data >= 11) & (data <= 13)), out=odd[1:])
        spaces = solid[offs[1:]] - solid[offs[:-1]]
        regular = (words > 0) & (spaces == words - 1) & (odd[offs[1:]] == odd[offs[:-1]])
        if _OTHER_SPACE.search(raw) or any(x in raw for x in self.special):
            for i in np.flatnonzero(regular):
                t = raw[offs[i]: offs[i + 1]]
                if _OTHER_SPACE.search(t) or any(x in t for x in self.special):
                    regular[i] = False
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        for i in np.flatnonzero(~regular & (length > 0)):
            out[i] = self.plain(raw[offs[i]: offs[i + 1]])
        if not regular.any():
            return out
        text_of = np.repeat(np.arange(n), words)
        use = regular[text_of]
        s, e, doc = start[use], end[use], text_of[use]
        lead = np.zeros(len(s), bool)
        opens = np.concatenate(([True], doc[1:] != doc[:-1]))
        lead[~opens] = data[s[~opens] - 1] == 32
        key = X.word_hashes(data, s, e) ^ np.where(lead, X.U64(0), X.U64(0x5851F42D4C957F2D))
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        us, ue, ul = s[at], e[at], lead[at]
        joined = b"".join([(b" " if b else b"\n") + raw[i:j] for i, j, b in zip(us.tolist(), ue.tolist(), ul.tolist())])
        ids = np.array(self.bpe.encode_ordinary(joined.decode("utf-8")), np.uint32)
        edge = np.concatenate(([0], np.cumsum(self.width[ids])))
        unit_from = np.concatenate(([0], np.cumsum(ue - us + 1)))
        token_from = np.searchsorted(edge, unit_from)
        ts, tn = token_from[:-1][back], np.diff(token_from)[back]
        ts = ts + opens  # a text's first word has no line break before it
        tn = tn - opens
        stop = np.cumsum(tn)
        gathered = ids[np.repeat(ts - stop + tn, tn) + np.arange(stop[-1])]
        last = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True])))
        a = 0
        for i, b in zip(doc[last].tolist(), stop[last].tolist()):
            out[i] = gathered[a:b]
            a = b
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = id_type(docs)
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            data, offs = X.text_buffer(batch.column(1))
            row, piece, start, length, crc, blob = [], [], [], [], [], []
            for lo, _, part, at in X.chunks(data, offs, 4 << 20):
                for i, ids in enumerate(enc.encode(part, at)):
                    full = np.append(ids, np.uint32(end_id)).astype("<u4")
                    head = len(full) % capacity or capacity
                    cuts = [0, *range(head, len(full) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        body = full[a:b].tobytes()
                        row.append(lo + i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(body))
                        if with_ids:
                            blob.append(body)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(blob, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[dict[tuple[int, ...], int], dict[int, int]]:
    """Fix sets that dominate: (patterns with multiplicities, what is left).

    For the largest remaining length ``s`` with ``free`` tokens beside it, a set
    that holds ``s`` and dominates all others that do belongs to some optimal
    packing and is taken out.  Checked, by whole counts: nothing fits beside it
    (``{s}``); one length fills the rest exactly (``{s, free}``); or, when no
    two (or no three) others fit together and no pair is longer than the
    longest single length ``k`` that fits, ``{s, k}``.  A length without such a
    set stays for the best-fit step."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: dict[tuple[int, ...], int] = defaultdict(int)
    for s in sorted(left, reverse=True):
        while left.get(s, 0) > 0:
            free = capacity - s
            rest = dict(left)
            rest[s] -= 1
            others = sorted(k for k, n in rest.items() if n > 0 and k <= free)
            if not others:
                take, pattern = left[s] if 2 * s > capacity else 1, (s,)
            else:
                k = others[-1]
                low: list[int] = []
                for o in others:
                    low += [o] * min(3 - len(low), rest[o])
                    if len(low) == 3:
                        break
                pair_free = len(low) < 2 or low[0] + low[1] > free
                if k != free and not pair_free:
                    three = len(low) == 3 and sum(low) <= free
                    if three or _best_pair(rest, others, free) > k:
                        break
                take, pattern = (left[s] // 2 if k == s else min(left[s], left[k])), (s, k)
            fixed[pattern] += take
            for x in pattern:
                left[x] -= take
    return dict(fixed), {s: n for s, n in left.items() if n > 0}


def _best_pair(rest: dict[int, int], others: list[int], free: int) -> int:
    """The largest sum within ``free`` of two of the others."""
    best, i, j = 0, 0, len(others) - 1
    while i <= j:
        total = others[i] + others[j]
        if total > free or (i == j and rest[others[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Best fit by decreasing length, by whole counts: each piece goes to the
    open sequence with the least room that still takes it."""
    open_at: list[list[list]] = [[] for _ in range(capacity + 1)]
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            room = next((r for r in range(s, capacity + 1) if open_at[r]), None)
            if room is None:
                per = capacity // s
                for copies, bins in ((per, n // per), (n % per, 1)):
                    if copies and bins:
                        open_at[capacity - copies * s].append([(s,) * copies, bins])
                n = 0
                continue
            pattern, bins = open_at[room].pop()
            per = room // s
            full = min(bins, n // per)
            if full:
                open_at[room - per * s].append([pattern + (s,) * per, full])
                n -= full * per
                bins -= full
            if bins and n and n < per:
                open_at[room - n * s].append([pattern + (s,) * n, 1])
                n, bins = 0, bins - 1
            if bins:
                open_at[room].append([pattern, bins])
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_at:
        for pattern, bins in groups:
            out[pattern] += bins
    return dict(out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    fixed, rest = reduce_dominated(counts, capacity)
    for pattern, n in best_fit(rest, capacity).items():
        fixed[pattern] = fixed.get(pattern, 0) + n
    return fixed


def placement(patterns: dict[tuple[int, ...], int]) -> dict[int, np.ndarray]:
    """For each length the rank intervals of the patterns that hold it: columns
    first rank, first sequence, copies per sequence, offset of the first copy."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern in sorted(patterns):
        bins, offset = patterns[pattern], 0
        for s in dict.fromkeys(pattern):
            copies = pattern.count(s)
            rows[s].append((used[s], sequence, copies, offset))
            used[s] += copies * bins
            offset += copies * s
        sequence += bins
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length``."""
    table = stored(cut.withColumn("_part", F.spark_partition_id()), "packing-pieces")
    counts = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = placement(plan(histogram, capacity))
    before = running_offsets(counts, ["length"], "_part", "_n")
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece"))
    ranked = (table.withColumn("_row", inside).join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_before", "_row", "_part"))
    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = T.StructType(fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                m = length == s
                p = places[int(s)]
                q = p[np.searchsorted(p[:, 0], rank[m], "right") - 1]
                k = rank[m] - q[:, 0]
                seq[m] = q[:, 1] + k // q[:, 2]
                off[m] = q[:, 3] + (k % q[:, 2]) * s
            cols = [batch.column(f.name) for f in fields] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(pieces(docs, vocab_path, capacity, end_id), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))
