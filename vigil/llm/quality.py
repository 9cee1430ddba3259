"""Operator 5: quality classifier, a byte-level convolutional network in numpy.

Bytes get a learned embedding; filters of ``WIDTH`` bytes slide by ``STEP``
over the text; their outputs are max-pooled over chunks of ``CHUNK`` bytes that
overlap by half and cover the whole text.  The mean and the maximum of the
pooled chunks go through a logistic layer into one probability of label 1.

The network is fitted on at most ``PER_CLASS`` labelled texts of each label
(a documented bound, chosen by hash of the id).  The filters see ``TRAIN_CHUNKS``
chunks of a text that has more, one drawn by hash from each of as many equal
stretches of it, so that any chunk of any text can be drawn; the last layer sees
whole texts.  Scoring reads every text to its end.  Only the text is an input of
a score.

Edge cases: a null text is an empty one, and an empty text is one chunk of
padding, scored as any other; without labelled texts of both labels every score
is the share of label 1 (or 1.0 without any label); labels of repeated ids are
taken once (the lowest), and so are their texts (the least), so that the bound
holds however many rows have a labelled id; null or repeated ids and repeated rows are scored row
by row; a very long text is scored to its end, in memory in proportion to it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import textops as X
from vigil.llm.common import small_batches, stored
from vigil.llm.langid import held_out

PER_CLASS = 2500
TRAIN_CHUNKS = 6
CHUNK, WIDTH, STEP = 256, 8, 4
EMBED, FILTERS = 4, 24
THRESHOLD = 0.3

_HALF = CHUNK // 2
_POSITIONS = _HALF // STEP  # filter positions of half a chunk
_BLOCK = STEP * EMBED


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED); byte 0 is padding
    head: np.ndarray  # (_BLOCK, FILTERS): the first STEP bytes of a filter
    tail: np.ndarray  # (_BLOCK, FILTERS): the rest
    bias: np.ndarray
    last: np.ndarray  # (2 * FILTERS,)
    offset: float

    def outputs(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Filter outputs of a buffer, one row for each STEP bytes; ``last`` has
        the rows at which a text ends, padding that the next text must not meet."""
        blocks = self.embed[data].reshape(-1, _BLOCK)
        z = blocks @ self.head
        z[:-1] += blocks[1:] @ self.tail
        z[last] = 0
        return np.maximum(z + self.bias, 0, dtype=np.float32)

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text: (texts, 2 * FILTERS)."""
        lens = np.diff(offs)
        halves = np.maximum(1, -(-(lens + STEP) // _HALF))
        at = np.concatenate(([0], np.cumsum(halves)))
        buffer = np.zeros(int(at[-1]) * _HALF, np.uint8)
        shift = np.repeat(at[:-1] * _HALF - offs[:-1], lens)
        buffer[np.arange(len(data)) + shift] = data
        pooled = self.outputs(buffer, at[1:] * _POSITIONS - 1).reshape(-1, _POSITIONS, FILTERS).max(axis=1)
        chunk = pooled.copy()
        chunk[:-1] = np.maximum(pooled[:-1], pooled[1:])
        end = at[1:] - 1
        chunk[end] = pooled[end]  # a text's last half belongs to the chunk before it
        alone = halves == 1
        low = np.maximum.reduceat(chunk, at[:-1], axis=0)
        total = np.add.reduceat(chunk, at[:-1], axis=0)
        total[~alone] -= chunk[end[~alone]]
        mean = total / np.maximum(halves - 1, 1)[:, None]
        return np.concatenate((mean, low), axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features.astype(np.float64) @ self.last + self.offset)))


def drawn_chunks(n: int, seed: int, most: int = TRAIN_CHUNKS) -> list[int]:
    """Numbers of the chunks to train on, of ``n``: all, or one drawn from each
    of ``most`` equal stretches."""
    if n <= most:
        return list(range(n))
    edge = [k * n // most for k in range(most + 1)]
    return np.random.default_rng(seed).integers(edge[:-1], edge[1:]).tolist()


def _train_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = CHUNK + WIDTH - STEP
    for batch in batches:
        data, offs = X.text_buffer(batch.column(2))
        row, blob = [], []
        for i, (a, b, h) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column(0).to_pylist())):
            starts = range(a, max(a + 1, b - _HALF), _HALF)
            for k in drawn_chunks(len(starts), h % (1 << 64)):
                row.append(i)
                blob.append(data[starts[k]: min(b, starts[k] + size)].tobytes().ljust(size, b"\0"))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(blob, pa.binary())], names=["h", "quality", "chunk"])


def fit_filters(chunks: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 12, seed: int = 7) -> Network:
    """Embedding and filters, by gradient descent (Adam) on chunk labels."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (2 * _BLOCK, FILTERS)), "bias": np.zeros(FILTERS),
         "out": rng.normal(0, 0.3, FILTERS), "offset": np.zeros(1)}
    p["embed"][0] = 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t, n = 0, 2 * _POSITIONS
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(chunks))
        for k in range(0, len(order), 128):
            idx = order[k: k + 128]
            x, y, w = chunks[idx], label[idx], weight[idx]
            e = p["embed"][x].reshape(len(idx), -1, _BLOCK)
            win = np.concatenate((e[:, :-1], e[:, 1:]), axis=2)[:, :n]
            z = win @ p["filters"] + p["bias"]
            top = z.argmax(axis=1)
            best = np.take_along_axis(z, top[:, None, :], 1)[:, 0]
            act = np.maximum(best, 0)
            prob = 1 / (1 + np.exp(-(act @ p["out"] + p["offset"][0])))
            d = (prob - y) * w / len(idx)
            g = {"out": act.T @ d + 1e-4 * p["out"], "offset": np.array([d.sum()])}
            da = d[:, None] * p["out"] * (best > 0)
            g["bias"] = da.sum(axis=0)
            at = np.arange(len(idx))[:, None]
            hit = win[at, top]  # (batch, FILTERS, window)
            g["filters"] = np.einsum("bf,bfw->wf", da, hit)
            back = da[:, :, None] * p["filters"].T[None]  # (batch, FILTERS, window)
            g["embed"] = np.zeros_like(p["embed"])
            where = (top[:, :, None] * STEP + np.arange(WIDTH)).reshape(len(idx), -1)
            np.add.at(g["embed"], np.take_along_axis(x, where, 1).reshape(-1), back.reshape(-1, EMBED))
            g["embed"][0] = 0
            t += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    f = p["filters"].astype(np.float32)
    return Network(p["embed"].astype(np.float32), f[:_BLOCK], f[_BLOCK:], p["bias"].astype(np.float32), np.zeros(2 * FILTERS), 0.0)


def fit_last(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The logistic layer over whole texts, by Newton steps on scaled features."""
    scale = features.std(axis=0) + 1e-6
    mean = features.mean(axis=0)
    x = np.concatenate(((features - mean) / scale, np.ones((len(features), 1))), axis=1)
    ridge = np.full(x.shape[1], 1e-3 * len(x) / 100)
    ridge[-1] = 1e-9
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        prob = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (prob - label)) + ridge * beta
        hess = (x * (weight * prob * (1 - prob))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    coef = beta[:-1] / scale
    return coef, float(beta[-1] - coef @ mean)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """A network fitted on the rows outside the held-out fold; or the share of
    label 1 if only one label is there."""
    fold = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
            .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    counts = {r["quality"]: r["n"] for r in fold.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 1.0
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for q in (0, 1):
        one = fold.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                    .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min("text").alias("text"))
                    .select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "quality", "text"), "labelled-texts")
    rows = sorted(tuple(r) for r in sample.mapInArrow(_train_chunks, "h bigint, quality int, chunk binary").collect())
    if not rows:
        return counts[1] / total
    chunks = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1).astype(np.int64)
    label = np.array([r[1] for r in rows], np.float64)
    share = {q: (counts[q] / total) / min(1.0, max(1, (label == q).sum()) / len(label)) for q in (0, 1)}
    net = fit_filters(chunks, label, np.where(label == 1, share[1], share[0]))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = X.text_buffer(batch.column(2))
            parts = [net.features(piece, at) for _, _, piece, at in X.chunks(data, offs)]
            blobs = [f.astype(np.float32).tobytes() for part in parts for f in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["h", "quality", "f"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(featured, "h bigint, quality int, f binary").collect())
    feats = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    label = np.array([r[1] for r in rows], np.float64)
    share = {q: (counts[q] / total) / (max(1, (label == q).sum()) / len(label)) for q in (0, 1)}
    net.last, net.offset = fit_last(feats, label, np.where(label == 1, share[1], share[0]))
    return net


def score(docs: DataFrame, model: Network | float, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, held_out, score, predicted for every document."""
    small_batches(docs.sparkSession)
    n = len(carry)
    schema = T.StructType([docs.schema[c] for c in carry] + [
        T.StructField("_held_out", T.BooleanType()), T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                s = np.full(batch.num_rows, model)
            else:
                data, offs = X.text_buffer(batch.column(n + 1))
                parts = [model.score(model.features(piece, at)) for _, _, piece, at in X.chunks(data, offs)]
                s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select(*carry, held_out(F.col("doc_id"), 5, 0).alias("_held_out"), F.col("text").alias("_text")).mapInArrow(scored, schema)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    small_batches(docs.sparkSession)
    scored = score(docs, train(docs, labels.select("doc_id", "quality")))
    return scored.withColumnsRenamed({"_held_out": "held_out", "_score": "score", "_predicted": "predicted"})


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to have label 1, as they are."""
    small_batches(docs.sparkSession)
    scored = score(docs, train(docs, labels.select("doc_id", "quality")), docs.columns)
    return scored.where("_predicted = 1").select(*docs.columns)
