"""Embeddings and vector search.

Exact top-k search (``exact_topk``) goes by the measured size of the query
batch.  A batch that fits in memory is broadcast and every scan task keeps its
own k best per query (``scan_topk``): no vector leaves the task that read it,
only k rows per query and task are merged.  A larger batch is a *blocked* job
(``blocked_topk``): vectors of each search group (tenant, scope) are split into
blocks of at most ``block_rows`` rows, queries are replicated once per block of
their group, and ``cogroup(...).applyInPandas`` scores one (query block ×
vector block) pair with a numpy matrix product.  No query×vector pair is ever
materialised as a row, and a hot group (one tenant holding a third of all
vectors) becomes many small tasks.

Approximate search (IVF, D12) uses MLlib KMeans for the lists.  A vector near
the border of two lists stands in both, and each group's share of a list is a
cell with its own centroid and radius: cells are probed by their centroids, and
one that by its radius can't hold a nearer vector than those found isn't read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import measured_bytes
from ..functions.vectors import cosine_distance, cosine_matrix, l2_norm, l2_normalize, to_matrix


# ---------------------------------------------------------------- D1-D4
def content_hash(df: DataFrame, text_col: str = "content") -> DataFrame:
    """sha256 hex of the UTF-8 text."""
    return df.withColumn("content_hash", F.sha2(F.col(text_col), 256))


KEY = ("tenant_id", "scope", "content_hash")


def cache_lookup(requests: DataFrame, stored: DataFrame, key=KEY) -> DataFrame:
    """A request is a cache hit when a stored row has the same
    (tenant, scope, content hash); it gets that row's id (the least) as
    ``cached_id`` and its embedding, if the table has one, as
    ``cached_embedding``.  The stored side is reduced to one row per key
    first, so the join is many-to-one and never multiplies requests; a hot
    key is split by AQE's skew-join handling."""
    extra = [F.min_by("embedding", "id").alias("cached_embedding")] if "embedding" in stored.columns else []
    keys = stored.groupBy(*key).agg(F.min("id").alias("cached_id"), *extra)
    return requests.join(keys, list(key), "left").withColumn("cached", F.col("cached_id").isNotNull())


def first_seen_cache(requests: DataFrame, key=KEY, order_col: str = "id") -> DataFrame:
    """D2 over one table of arrivals: a row is cached when an earlier row
    (smaller ``order_col``) has the same key.  One partial aggregate per key
    (map-side combined) and a many-to-one join back; no pairs are formed."""
    first = requests.groupBy(*key).agg(F.min(order_col).alias("_first"))
    return (requests.join(first, list(key), "left")
            .withColumn("cached", F.col(order_col) > F.col("_first")).drop("_first"))


def idempotent_insert(batch: DataFrame, table: DataFrame, key=KEY, order_col: str = "id") -> DataFrame:
    """D3: rows to append so that (tenant, scope, hash) stays unique: one row
    per key inside the batch (the first by ``order_col``, via ``min_by``,
    which aggregates map-side) and none whose key is already stored."""
    cols = [c for c in batch.columns if c not in key]
    firsts = (batch.groupBy(*key)
              .agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
              .select(*key, "_r.*"))
    return firsts.join(table.select(*key).distinct(), list(key), "left_anti")


def truncate(df: DataFrame, d: int, col: str = "embedding") -> DataFrame:
    """Keep the first ``d`` dimensions."""
    return df.withColumn(col, F.slice(F.col(col), 1, d))


# ---------------------------------------------------------------- D9, D14-D16
def normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """L2-normalise every vector."""
    return df.withColumn(col, l2_normalize(col))


def dimension_check(df: DataFrame, expected: int, col: str = "embedding") -> DataFrame:
    """Vectors per actual width, OK / MISMATCH against ``expected``."""
    return (df.groupBy(F.coalesce(F.when(F.col(col).isNotNull(), F.size(col)), F.lit(0)).alias("actual_dims")).agg(F.count(F.lit(1)).alias("vectors"))
            .withColumn("expected_dims", F.lit(expected))
            .withColumn("status", F.when(F.col("actual_dims") == expected, "OK").otherwise("MISMATCH")))


def vector_text(df: DataFrame, col: str = "embedding") -> DataFrame:
    """The ``[a,b,...]`` text form."""
    return df.withColumn(f"{col}_text", F.to_json(F.col(col)))


def parse_vector_text(c) -> "F.Column":
    """A3: ``[a,b,...]`` text -> array<double>."""
    return F.from_json(c if not isinstance(c, str) else F.col(c), "array<double>")


def split_by_dimension(df: DataFrame, expected: int, col: str = "embedding"):
    """(accepted, rejected) by vector width; rejected rows keep a reason."""
    width = F.coalesce(F.when(F.col(col).isNotNull(), F.size(col)), F.lit(0))  # no vector: width 0
    ok = width == expected
    rejected = df.where(~ok).withColumn(
        "reject_reason", F.concat(F.lit(f"Expected {expected} dimensions, got "), width.cast("string")))
    return df.where(ok), rejected


# ---------------------------------------------------------------- blocked exact top-k
def _bucket(id_col: str, n_blocks) -> "F.Column":
    return F.pmod(F.xxhash64(F.col(id_col)), n_blocks.cast("long")).cast("int")


def blocked_topk(queries: DataFrame, vectors: DataFrame, k: int | str, group_cols=("tenant_id", "scope"),
                 query_id: str = "query_id", query_vec: str = "query_vec",
                 vec_id: str = "id", vec_col: str = "embedding", block_rows: int = 20000,
                 query_block_rows: int = 2000, block_budget_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """Exact k nearest vectors (cosine distance) per query within its group.

    ``queries``: query_id, group columns, query_vec (array<double>); a query
    may appear in several groups (IVF probes), the result merges them.  ``k``
    is a number, or the name of a column of ``queries`` that holds each
    query's own.  ``vectors``: id, group columns, embedding; rows without a
    vector are no candidates.  Returns query_id, id, cosine_distance, rank
    (1..k; ties by id; zero vectors have a null distance and rank last).

    Block sizes follow from the width of the vectors, so that the vectors,
    queries and distances of one block pair stay within
    ``block_budget_bytes``.  A block pair gives exactly its k best by
    (distance, id), however many are tied.  Queries are meant to be a batch
    of requests: the vectors are sent once per query block of their group.
    """
    g = list(group_cols)
    if not g:  # one search group: a constant key keeps every join keyed
        queries, vectors, g = queries.withColumn("_g0", F.lit(0)), vectors.withColumn("_g0", F.lit(0)), ["_g0"]
    qid_t = queries.schema[query_id].dataType
    vid_t = vectors.schema[vec_id].dataType
    # fresh aliases: the two sides may come from the same table
    want = F.col(k) if isinstance(k, str) else F.lit(k)
    q = queries.where(F.col(query_vec).isNotNull()).select(
        *[F.col(c).alias(c) for c in g], F.col(query_id).alias("qid"), F.col(query_vec).alias("qv"), want.cast("int").alias("qk"))
    v = vectors.where(F.col(vec_col).isNotNull()).select(
        *[F.col(c).alias(c) for c in g], F.col(vec_id).alias("vid"), F.col(vec_col).alias("vv"))
    # per-group sizes: one small aggregate row per group, joined back many-to-one
    per_vector = F.lit(16.0) * F.greatest(F.lit(1), F.max(F.size("vv")))  # vectors and half the budget, in bytes
    rows_fit = F.greatest(F.lit(1.0), F.least(F.lit(float(block_rows)), F.floor(F.lit(float(block_budget_bytes)) / per_vector)))
    vs = v.groupBy(*g).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_fit)).cast("int").alias("nvb"))
    per_query = F.lit(16.0) * (F.greatest(F.lit(1), F.max(F.size("qv"))) + block_rows)
    queries_fit = F.greatest(F.lit(1.0), F.least(F.lit(float(query_block_rows)), F.floor(F.lit(float(block_budget_bytes)) / per_query)))
    qs = q.groupBy(*g).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / queries_fit)).cast("int").alias("nqb"))
    sizes = vs.join(qs, g, "inner")
    vb = (v.join(sizes, g, "inner")
          .withColumn("vb", _bucket("vid", F.col("nvb")))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
          .drop("nvb", "nqb"))
    qb = (q.join(sizes, g, "inner")
          .withColumn("qb", _bucket("qid", F.col("nqb")))
          .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nvb") - 1)))
          .drop("nvb", "nqb"))
    keys = g + ["qb", "vb"]
    out_schema = T.StructType([T.StructField("qid", qid_t), T.StructField("vid", vid_t),
                               T.StructField("dist", T.DoubleType()), T.StructField("qk", T.IntegerType())])

    def score(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(vpdf) == 0:
            return pd.DataFrame({"qid": [], "vid": [], "dist": [], "qk": []})
        vpdf = vpdf.sort_values("vid", kind="stable")
        rows, cols, d = best_in_block(cosine_matrix(to_matrix(qpdf["qv"]), to_matrix(vpdf["vv"])), qpdf["qk"].to_numpy())
        return pd.DataFrame({"qid": qpdf["qid"].to_numpy()[rows], "vid": vpdf["vid"].to_numpy()[cols], "dist": d,
                             "qk": qpdf["qk"].to_numpy()[rows]})

    cand = (qb.groupBy(*keys).cogroup(vb.groupBy(*keys))
            .applyInPandas(score, schema=out_schema))
    # every vector belongs to one group and every (query, group) pair is
    # scored once, so the candidates hold no duplicate (query, vector)
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), F.col("vid").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("qk"))
            .select(F.col("qid").alias(query_id), F.col("vid").alias(vec_id),
                    F.col("dist").alias("cosine_distance"), "rank"))


def best_in_block(dist: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of each row's ``k`` least distances; columns are
    in id order, which decides among equal ones; NaN counts as the greatest."""
    key = np.where(np.isnan(dist), np.inf, dist)
    m = key.shape[1]
    kk = np.clip(k, 0, m)
    mask = np.zeros(key.shape, bool)
    for n in np.unique(kk[kk > 0]):  # one selection per distinct k
        at = np.flatnonzero(kk == n)
        sub = key[at]
        kth = np.partition(sub, n - 1, axis=1)[:, n - 1: n]
        less = sub < kth
        tied = sub == kth
        mask[at] = less | (tied & (np.cumsum(tied, axis=1) <= n - less.sum(axis=1, keepdims=True)))
    rows, cols = np.nonzero(mask)
    return rows, cols, dist[rows, cols]


# ---------------------------------------------------------------- exact top-k without moving the vectors
#: Queries (vectors and keys, as measured) that are broadcast at most.
SCAN_QUERY_BYTES = 32 << 20
#: Distances computed at once in a scan task.
SCAN_CELLS = 4 << 20
#: Parts in which the tasks' candidates of one query are merged first.
MERGE_PARTS = 64


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int | str, group_cols=("tenant_id", "scope"),
               query_id: str = "query_id", query_vec: str = "query_vec", vec_id: str = "id", vec_col: str = "embedding",
               copies: int = 1, limit: int = SCAN_QUERY_BYTES) -> DataFrame:
    """The k nearest vectors per query, as :func:`blocked_topk`, by the
    plan that the size of the query batch allows: up to ``limit`` bytes the batch
    is broadcast and the vectors stay where they are read, else both sides are
    dealt out in blocks.  ``copies``: how often a vector may stand in ``vectors``
    for one query; it counts once in the result."""
    q = queries.where(F.col(query_vec).isNotNull())
    if measured_bytes(q.select(*group_cols, query_id, query_vec)) <= limit:
        return scan_topk(queries, vectors, k, group_cols, query_id, query_vec, vec_id, vec_col, copies)
    want = F.col(k) if isinstance(k, str) else F.lit(k)
    more = blocked_topk(queries.withColumn("_k", (want * copies).cast("int")), vectors, "_k", group_cols, query_id, query_vec, vec_id, vec_col)
    if copies == 1:
        return more
    asked = queries.select(query_id, want.cast("int").alias("_k")).dropDuplicates([query_id])
    once = more.groupBy(query_id, vec_id).agg(F.min("cosine_distance").alias("cosine_distance")).join(asked, query_id)
    w = Window.partitionBy(query_id).orderBy(F.col("cosine_distance").asc_nulls_last(), F.col(vec_id).asc())
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_k")).select(query_id, vec_id, "cosine_distance", "rank")


def scan_topk(queries: DataFrame, vectors: DataFrame, k: int | str, group_cols=("tenant_id", "scope"),
              query_id: str = "query_id", query_vec: str = "query_vec", vec_id: str = "id", vec_col: str = "embedding",
              copies: int = 1) -> DataFrame:
    """Exact k nearest vectors per query by one pass over ``vectors``, for a batch
    of queries that fits in memory (see :func:`exact_topk`, which measures it).

    The batch is broadcast; each task keeps the k best per query of the rows it
    reads, and k rows per query and task are merged, first within
    ``MERGE_PARTS`` parts of the tasks.  Results as :func:`blocked_topk`."""
    from pyspark.sql.pandas.types import to_arrow_type

    g = list(group_cols)
    want = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = queries.where(F.col(query_vec).isNotNull()).select(
        *g, F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"), want.cast("int").alias("_qk")).collect()
    number: dict = {}
    ids, vecs, ks, members = [], [], [], defaultdict(list)
    for r in asked:
        i = number.setdefault(r["_qid"], len(ids))
        if i == len(ids):
            ids.append(r["_qid"])
            vecs.append(r["_qv"])
            ks.append(r["_qk"] or 0)
        members[tuple(r[c] for c in g)].append(i)
    held = queries.sparkSession.sparkContext.broadcast(
        (np.array(vecs, np.float64), np.array(ks, np.int64), {key: np.array(sorted(set(m))) for key, m in members.items() if None not in key}))
    qid_t, vid_t = queries.schema[query_id].dataType, vectors.schema[vec_id].dataType
    vid_arrow = to_arrow_type(vid_t)
    schema = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("vid", vid_t), T.StructField("dist", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, want_k, groups = held.value
        keep = want_k * copies
        found: list[tuple[np.ndarray, list, np.ndarray]] = []
        rows = 0

        def settle() -> tuple[np.ndarray, list, np.ndarray]:
            """The best of all candidates so far, per query."""
            c = pd.DataFrame({"q": np.concatenate([f[0] for f in found]), "v": pd.Series([v for f in found for v in f[1]], dtype=object),
                              "d": np.concatenate([f[2] for f in found])}).sort_values(["q", "d", "v"], na_position="last", kind="stable")
            c = c[c.groupby("q").cumcount().to_numpy() < keep[c["q"].to_numpy()]]
            return c["q"].to_numpy(), c["v"].tolist(), c["d"].to_numpy()

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in g))) if g else [()] * b.num_rows
            where: dict = defaultdict(list)
            for i, key in enumerate(keys):
                if key in groups:
                    where[key].append(i)
            if not where:
                continue
            vid, vec = b.column("vid").to_pylist(), b.column("vv")
            for key, at in where.items():
                at.sort(key=lambda i: vid[i])
                some = vec.take(pa.array(at))
                width = some.value_lengths().to_numpy(zero_copy_only=False)
                if (width != q.shape[1]).any():
                    raise ValueError(f"Expected {q.shape[1]} dimensions, got {int(width[width != q.shape[1]][0])}")
                m = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), -1)
                mine = groups[key]
                step = max(1, SCAN_CELLS // len(at))
                for lo in range(0, len(mine), step):
                    part = mine[lo: lo + step]
                    r, c, d = best_in_block(cosine_matrix(q[part], m), keep[part])
                    found.append((part[r], [vid[at[j]] for j in c.tolist()], d))
                    rows += len(r)
            if rows > 4 * int(keep.sum()) + 100_000:
                found = [settle()]
                rows = len(found[0][0])
        if found:
            i, v, d = settle()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(v, vid_arrow), pa.array(d, pa.float64(), from_pandas=True)],
                                             names=["_q", "vid", "dist"])

    v = vectors.where(F.col(vec_col).isNotNull()).select(*g, F.col(vec_id).alias("vid"), F.col(vec_col).alias("vv"))
    most = max(ks, default=0)
    order = (F.col("dist").asc_nulls_last(), F.col("vid").asc())
    cand = v.mapInArrow(best, schema).withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    some = (cand.withColumn("_r", F.row_number().over(Window.partitionBy("_q", "_p").orderBy(*order))).where(F.col("_r") <= most * copies))
    if copies > 1:
        some = some.groupBy("_q", "vid").agg(F.min("dist").alias("dist"))
    asked_for = queries.sparkSession.createDataFrame(
        [(i, x, n) for i, (x, n) in enumerate(zip(ids, ks))],
        T.StructType([T.StructField("_q", T.IntegerType()), T.StructField(query_id, qid_t), T.StructField("_qk", T.IntegerType())]))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(*order))).where(F.col("rank") <= most)
    return (ranked.join(F.broadcast(asked_for), "_q").where(F.col("rank") <= F.col("_qk"))
            .select(query_id, F.col("vid").alias(vec_id), F.col("dist").alias("cosine_distance"), "rank"))


def matched_rows(matches: DataFrame, vectors: DataFrame, *columns, on: str = "id") -> DataFrame:
    """``matches`` with ``columns`` of the stored rows they name.  Matches are k
    rows a request: written once, measured, and broadcast to the scan of the
    stored rows if small, so that those are not shuffled; else a keyed join."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(matches.sparkSession)
    few = matches.checkpoint(eager=True)
    small = measured_bytes(few) <= SCAN_QUERY_BYTES
    return vectors.select(on, *columns).join(F.broadcast(few) if small else few, on)


def keyword_search(vectors: DataFrame, tenant_id: str | None, scope: str, term: str, k: int = 5) -> DataFrame:
    """Case-insensitive substring match of the literal ``term`` in the
    content of one scope (``%``, ``_`` and ``\\`` in the term are escaped),
    newest first, top k."""
    esc = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    cond = (F.col("scope") == scope) & F.col("content").ilike(f"%{esc}%")
    if tenant_id is not None:
        cond = cond & (F.col("tenant_id") == tenant_id)
    return (vectors.where(cond).orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(k))


#: Files over which the rows of one trigram are spread at most.
TRIGRAM_PARTS = 16
#: Postings that a task holds at most (beside those of one text), and rows of a batch that it makes Python values of at once.
HELD_POSTINGS = 1 << 19
HELD_ROWS = 64


class TrigramIndex(NamedTuple):
    """``postings``: tri, group columns and ids of rows that hold it (each row's id
    once per trigram, in lists as a task gathered them), every file sorted by
    trigram; ``counts``: rows per trigram and group."""

    postings: DataFrame
    counts: DataFrame
    group_cols: tuple[str, ...]


def cut_trigrams(batches: Iterator[pa.RecordBatch], schema: pa.Schema, held: int = HELD_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Posting lists (``schema``: trigram, group columns, ids) of rows of text, group
    columns and id.  Lists are given out once they hold ``held`` postings together,
    so that a task's memory depends neither on the rows of a batch nor on the task."""
    lists: dict = defaultdict(list)
    n = 0

    def gathered() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(k, f.type) for k, f in zip(zip(*lists), schema)), pa.array(list(lists.values()), schema.field("ids").type)],
                                          names=schema.names)

    for b in batches:
        for lo in range(0, b.num_rows, HELD_ROWS):
            for text, *key, i in zip(*(c.to_pylist() for c in b.slice(lo, HELD_ROWS).columns)):
                tris = {text[j: j + 3] for j in range(len(text) - 2)}
                for tri in tris:
                    lists[(tri, *key)].append(i)
                n += len(tris)
                if n >= held:
                    yield gathered()
                    lists.clear()
                    n = 0
    if lists:
        yield gathered()


def trigram_index(vectors: DataFrame, index_path: str, group_cols=("scope", "tenant_id"), id_col: str = "id",
                  text_col: str = "content") -> TrigramIndex:
    """D13 index: for every row the distinct runs of three code points of its
    lower-cased text.  Every file is sorted by trigram and group, so that a
    look-up reads the row groups of its trigrams only.  Rows without text have no
    postings."""
    spark, g = vectors.sparkSession, list(group_cols)
    from pyspark.sql.pandas.types import to_arrow_schema

    ids = T.StructField("ids", T.ArrayType(vectors.schema[id_col].dataType))
    schema = T.StructType([T.StructField("tri", T.StringType()), *[vectors.schema[c] for c in g], ids])
    arrow = to_arrow_schema(schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_trigrams(batches, arrow)

    # each text is cut once, in a task of its own part; a trigram's rows go to some
    # files by hash of row, so that a frequent one is no single task
    texts = vectors.where(F.col(text_col).isNotNull()).select(F.lower(text_col).alias("_text"), *g, id_col).repartition(id_col)
    found = texts.mapInArrow(runs, schema)
    (found.repartition("tri", F.pmod(F.xxhash64("ids"), F.lit(TRIGRAM_PARTS))).sortWithinPartitions("tri", *g)
     .write.mode("overwrite").parquet(f"{index_path}/postings"))
    postings = spark.read.parquet(f"{index_path}/postings")
    postings.groupBy("tri", *g).agg(F.sum(F.size("ids").cast("long")).alias("n")).write.mode("overwrite").parquet(f"{index_path}/counts")
    return TrigramIndex(postings, spark.read.parquet(f"{index_path}/counts"), tuple(g))


#: Candidates that are named to the scan of the stored rows, for it to skip by.
NAMED_ROWS = 1000


def keyword_candidates(index: TrigramIndex, where: dict, term: str, most: int = 4) -> DataFrame | None:
    """Ids of the rows of a group that hold the ``most`` rarest trigrams of
    ``term``: the shortest posting list first, each next one keeps what both have.
    None if the term is too short to have one (every row is a candidate)."""
    spark = index.postings.sparkSession
    low = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    tris = sorted({low[i: i + 3] for i in range(len(low) - 2)})
    if not tris:
        return None
    mine = F.lit(True)
    for c, v in where.items():
        mine = mine & (F.col(c) == v)
    counted = {r["tri"]: r["n"] for r in index.counts.where(F.col("tri").isin(tris) & mine).groupBy("tri").agg(F.sum("n").alias("n")).collect()}
    found = None
    for tri in sorted(tris, key=lambda x: (counted.get(x, 0), x))[:most]:
        ids = index.postings.where((F.col("tri") == tri) & mine).select(F.explode("ids").alias("id"))
        found = ids if found is None else found.join(ids, "id", "left_semi")
    return found


def keyword_search_indexed(index: TrigramIndex, vectors: DataFrame, tenant_id: str | None, scope: str, term: str, k: int = 5) -> DataFrame:
    """D13 by the index: :func:`keyword_search` over the candidates only, whose
    text confirms or refuses them.  Few candidates are named in the filter of the
    scan (row groups are skipped by it), more are joined by id."""
    where = {"scope": scope} | ({} if tenant_id is None else {"tenant_id": tenant_id})
    found = keyword_candidates(index, where, term)
    if found is None:
        return keyword_search(vectors, tenant_id, scope, term, k)
    few = [r[0] for r in found.limit(NAMED_ROWS + 1).collect()]
    rows = vectors.where(F.col("id").isin(few)) if len(few) <= NAMED_ROWS else vectors.join(found, "id", "left_semi")
    return keyword_search(rows, tenant_id, scope, term, k)


def keyword_report(index: TrigramIndex, vectors: DataFrame, tenant_id: str, scope: str, terms: list[str]) -> DataFrame:
    """What a search by index reads: per term the rows of the group, the candidates
    (read and confirmed) and the matches."""
    where = {"scope": scope, "tenant_id": tenant_id}
    mine = vectors.where((F.col("scope") == scope) & (F.col("tenant_id") == tenant_id))
    out = None
    for term in terms:
        found = keyword_candidates(index, where, term)
        read = mine if found is None else mine.join(found, "id", "left_semi")
        one = read.agg(F.count(F.lit(1)).alias("rows_read"),
                       F.count_if(F.lower("content").contains(F.lower(F.lit(term)))).alias("matches")).select(F.lit(term).alias("term"), "*")
        out = one if out is None else out.unionByName(one)
    size = mine.agg(F.count(F.lit(1)).alias("group_rows")).first()[0]
    return out.withColumn("group_rows", F.lit(size).cast("long"))


# ---------------------------------------------------------------- D17 / B28
def assemble_context(matches: DataFrame, query_col: str = "query_id", rank_col: str = "rank",
                     text_col: str = "content", max_items: int = 8, max_chars: int = 8000) -> DataFrame:
    """First ``max_items`` matches per query as ``[#i] content`` joined
    by a blank line, cut at ``max_chars`` with a truncation marker.  The
    group per query holds at most ``max_items`` rows (filtered before the
    collect)."""
    top = matches.where(F.col(rank_col) <= max_items)
    agg = top.groupBy(query_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t")))).alias("m"))
    ctx = F.array_join(F.transform("m", lambda e, i: F.concat(F.lit("[#"), (i + 1).cast("string"), F.lit("] "),
                                                              F.coalesce(e["t"], F.lit("")))), "\n\n")
    ctx = F.when(F.length(ctx) > max_chars, F.concat(F.substring(ctx, 1, max_chars),
                                                     F.lit("\n...[CONTEXT TRUNCATED]"))).otherwise(ctx)
    return agg.select(query_col, F.size("m").alias("context_count"), ctx.alias("context_text"))


def search_response(requests: DataFrame, matches: DataFrame, vectors: DataFrame, query_col: str = "query_id") -> DataFrame:
    """One response per request: status, mode, query, tenant, scope, k,
    count and the ordered results with their stored fields.  Matches are k per
    request, so the collected list is bounded by the request."""
    stored = vectors.select("id", F.col("scope").alias("_scope"), "content", "tags", "source", "created_at")
    item = F.struct("rank", "id", F.col("_scope").alias("scope"), "content", "tags", "source", "created_at", "cosine_distance")
    found = (matched_rows(matches, stored, "_scope", "content", "tags", "source", "created_at").groupBy(query_col)
             .agg(F.count(F.lit(1)).alias("results_count"), F.sort_array(F.collect_list(item)).alias("results")))
    none = F.array().cast(found.schema["results"].dataType)
    return requests.join(found, query_col, "left").select(
        F.lit("success").alias("status"), F.lit("vector_cosine").alias("mode"), query_col, "query", "tenant_id", "scope",
        F.col("k_norm").alias("k"), F.coalesce("results_count", F.lit(0)).alias("results_count"), F.coalesce("results", none).alias("results"))


# ---------------------------------------------------------------- D12 IVF
def ivf_lists(n_rows: int) -> int:
    """Lists by the reference guidance: √n, at least 50."""
    return max(50, int(math.sqrt(max(n_rows, 1))))


def ivf_probes(lists: int, n_rows: int) -> int:
    """Probes by the guidance formula √n / 3, at least 10, at most lists."""
    return int(min(lists, max(10, round(math.sqrt(max(n_rows, 1)) / 3))))


class IvfIndex(NamedTuple):
    """``vectors``: the rows with their ``list_id`` (a border row twice), clustered by
    group and list; ``cells``: one row per group and list with ``centroid``,
    ``radius`` (the largest angle to it) and ``n``."""

    vectors: DataFrame
    cells: DataFrame
    group_cols: tuple[str, ...]


#: List of the vectors without a direction.
ZERO_LIST = -1


def ivf_build(vectors: DataFrame, lists: int, index_path: str, group_cols=("tenant_id", "scope"), seed: int = 42, max_iter: int = 10,
              col: str = "embedding", border: float = 0.35, train_rows: int | None = None) -> IvfIndex:
    """D12 build.  KMeans (cosine) lists; every vector goes to the list of its
    nearest centroid and, if the second centroid is at most ``border`` radians
    further away, to that one too.  The index is written clustered by group and
    list, so that a probe reads few row groups, with one cell per group and list.

    ``lists`` is the caller's choice (``ivf_lists`` has the guidance); lists × width
    numbers must fit on the driver, where MLlib keeps the model.  ``train_rows``
    bounds the rows that the lists are fitted on (None: all); all rows are indexed.
    Zero vectors, for which cosine is undefined, make a list of their own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark, g = vectors.sparkSession, list(group_cols)
    has_direction = F.coalesce(l2_norm(col) > 0, F.lit(False))
    usable = vectors.where(has_direction)
    fit_on = usable.select(array_to_vector(F.col(col)).alias("_f"))
    if train_rows is not None:
        fit_on = fit_on.sample(min(1.0, train_rows / max(1, usable.count())), seed)
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="list_id", distanceMeasure="cosine").fit(fit_on)
    cents = np.stack([np.asarray(c) / max(np.linalg.norm(c), 1e-300) for c in model.clusterCenters()])

    @F.pandas_udf("array<int>")
    def lists_of(x: pd.Series) -> pd.Series:
        m = to_matrix(x)
        angle = np.arccos(np.clip((m / np.linalg.norm(m, axis=1, keepdims=True)) @ cents.T, -1, 1))
        near = np.argsort(angle, axis=1, kind="stable")[:, :2]
        far = np.take_along_axis(angle, near, axis=1)
        both = far[:, -1] - far[:, 0] <= border
        return pd.Series([p[: 2 if two else 1].tolist() if len(p) > 1 else p.tolist() for p, two in zip(near, both)])

    assigned = usable.withColumn("list_id", F.explode(lists_of(F.col(col)))).unionByName(
        vectors.where(~has_direction).withColumn("list_id", F.lit(ZERO_LIST)))
    # range partitioning: files stay clustered, and an oversized cell is split
    # across tasks instead of landing in one
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*g, "list_id", vectors.columns[0]]
    (assigned.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{index_path}/vectors"))
    index = spark.read.parquet(f"{index_path}/vectors")
    unit = array_to_vector(l2_normalize(F.col(col)))
    cells = (index.groupBy(*g, "list_id").agg(Summarizer.mean(unit).alias("_m"), F.count(F.lit(1)).alias("n"))
             .select(*g, "list_id", vector_to_array("_m").alias("centroid"), "n"))
    cells.write.mode("overwrite").parquet(f"{index_path}/means")
    cells = spark.read.parquet(f"{index_path}/means")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - cosine_distance(col, "centroid"))))
    radius = (index.select(*g, "list_id", col).join(cells.select(*g, "list_id", "centroid"), [*g, "list_id"])
              .groupBy(*g, "list_id").agg(F.max(angle).alias("radius")))
    cells.join(radius, [*g, "list_id"]).write.mode("overwrite").parquet(f"{index_path}/cells")
    return IvfIndex(index, spark.read.parquet(f"{index_path}/cells"), tuple(g))


#: Rounding of angles that must not hide a nearer vector.
SLACK = 1e-7


def ivf_search(queries: DataFrame, index: IvfIndex, k: int, probes: int, certain: bool = False) -> tuple[DataFrame, DataFrame]:
    """D12 query: (matches, probed).  Cells of a query's own group go by the
    distance of their centroids.  The first third of the ``probes`` nearest cells
    is read; of the others only those whose lower bound (centroid's angle less
    radius) is below the k-th distance found so far.  Candidates are ranked
    exactly.  With ``certain`` every cell whose bound is low enough is read,
    whatever their number, and the result is the exact one.

    ``probed``: query_id, list_id, n of the cells read."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(queries.sparkSession)
    g = list(index.group_cols)
    cells, q = index.cells, queries.select(*g, "query_id", "query_vec")
    lists = (cells.agg(F.max("list_id")).first()[0] or 0) + 2
    width = lists if certain else min(probes, lists)
    # a cell without a direction has no distance and ranks last
    near = (exact_topk(q, cells, width, g, vec_id="list_id", vec_col="centroid").join(q.drop("query_vec"), "query_id")
            .join(cells.drop("centroid"), [*g, "list_id"])
            .withColumn("_angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("cosine_distance")))))
            .withColumn("_bound", F.lit(1.0) - F.cos(F.greatest(F.lit(0.0), F.col("_angle") - F.coalesce("radius", F.lit(math.pi)))))
            .select("query_id", "list_id", "n", "rank", "_bound").checkpoint(eager=True))

    def read(cells_read: DataFrame) -> DataFrame:
        named = [r[0] for r in cells_read.select("list_id").distinct().collect()]  # at most the number of lists
        rows = index.vectors.where(F.col("list_id").isin(named))
        return exact_topk(q.join(cells_read.select("query_id", "list_id"), "query_id"), rows, k, [*g, "list_id"], copies=2).checkpoint(eager=True)

    ahead = max(1, min(width, probes) // 3)
    first = near.where(F.col("rank") <= ahead)
    found = read(first)
    kth = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("cosine_distance"))).alias("_kth"))
    others = near.where(F.col("rank") > ahead).join(kth, "query_id", "left").where(
        F.col("_kth").isNull() | F.col("_bound").isNull() | (F.col("_bound") <= F.col("_kth") + SLACK)).select(*near.columns)
    both = found.unionByName(read(others)).groupBy("query_id", "id").agg(F.min("cosine_distance").alias("cosine_distance"))
    w = Window.partitionBy("query_id").orderBy(F.col("cosine_distance").asc_nulls_last(), F.col("id").asc())
    best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "cosine_distance", "rank")
    return best, first.unionByName(others).select("query_id", "list_id", "n")


def share_read(queries: DataFrame, vectors: DataFrame, probed: DataFrame, group_cols=("tenant_id", "scope")) -> DataFrame:
    """One row: index rows read for all queries as a share of the vectors of their
    groups (a border row counts each time)."""
    g = list(group_cols)
    sizes = vectors.where(F.col("embedding").isNotNull()).groupBy(*g).agg(F.count(F.lit(1)).alias("_size"))
    pool = queries.join(sizes, g).agg(F.sum("_size").alias("_pool"))
    return probed.agg(F.sum("n").alias("_read")).select((F.col("_read") / F.lit(pool.first()[0])).alias("share_read"))


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top-k found by the approximate search."""
    hit = exact.join(approx.select("query_id", "id").withColumn("_h", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg((F.count("_h") / F.count(F.lit(1))).alias(f"recall_at_{k}"),
                   F.countDistinct("query_id").alias("queries"))


# ---------------------------------------------------------------- D5-D8 PCA
def pca_fit(vectors: DataFrame, k: int, col: str = "embedding", expected_dims: int | None = None):
    """Fit mean + principal components (MLlib PCA: distributed
    covariance; the d×d eigen-problem runs on the driver, so d must fit
    there).  Returns (mean vector as list, PCAModel)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    if expected_dims is not None:
        bad = vectors.where(F.size(col) != expected_dims).limit(1).count()
        if bad:
            raise ValueError(f"Expected {expected_dims} dimensions")
    feats = vectors.select(array_to_vector(F.col(col)).alias("_f"))
    mean_row = feats.select(Summarizer.mean(F.col("_f")).alias("m")).first()
    mean = [float(x) for x in mean_row["m"]]
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(feats)
    return mean, model


def pca_transform(df: DataFrame, mean: list[float], model, col: str = "embedding",
                  out: str = "reduced") -> DataFrame:
    """Project, then subtract the projected mean (MLlib's PCA transform
    does not centre; k numbers are subtracted, not one per input dimension)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    centre = model.pc.toArray().T @ np.asarray(mean)
    shift = F.array(*[F.lit(float(x)) for x in centre])
    m = model.copy()
    m.setInputCol("_c").setOutputCol("_p")
    projected = m.transform(df.withColumn("_c", array_to_vector(F.col(col))))
    return projected.withColumn(out, F.zip_with(vector_to_array("_p"), shift, lambda a, b: a - b)).drop("_c", "_p")


def explained_variance_total(model) -> float:
    """Sum of explained-variance ratios."""
    return float(sum(model.explainedVariance.toArray()))


def compare_methods(df: DataFrame, mean: list[float], model, d: int, col: str = "embedding") -> DataFrame:
    """Mean L2 norm of the truncated and of the reduced vectors, and
    the PCA reconstruction MSE (inverse = scores·Cᵀ + mean, in a pandas UDF
    per Arrow batch)."""
    comps = model.pc.toArray()  # d_in × k
    mu = np.asarray(mean)
    red = pca_transform(df, mean, model, col, "reduced")

    @F.pandas_udf(T.DoubleType())
    def recon_mse(x: pd.Series, s: pd.Series) -> pd.Series:
        X, S = to_matrix(x), to_matrix(s)
        R = S @ comps.T + mu
        return pd.Series(((X - R) ** 2).mean(axis=1))

    return red.select(l2_norm(F.slice(F.col(col), 1, d)).alias("n_trunc"), l2_norm("reduced").alias("n_red"),
                      recon_mse(F.col(col), F.col("reduced")).alias("mse")) \
              .agg(F.avg("n_trunc").alias("mean_norm_truncated"), F.avg("n_red").alias("mean_norm_reduced"),
                   F.avg("mse").alias("reconstruction_mse"))
