"""Operator 1: benchmark decontamination by a positional inverted index.

The index holds one posting (term, document, position) for each occurrence in
the training texts of a term that the benchmark uses, stored in the shared
folder.  Phrases are searched from their rarest terms: the posting lists of
each phrase's rarest terms are shifted by the term's offset and intersected,
which leaves candidate starts; these are confirmed word by word in the text.
Proximity matches come from the same lists (:func:`near_matches`): places of a
phrase's rarest term that have its next rarest terms within ``NEAR`` words, in any
order, confirmed for all its terms in the text.  Only DataFrame functions are used.

Documents are addressed by a hash of id and text, so repeated rows and repeated
or null ids don't mix.  Candidates are small next to the texts; they
are broadcast if they measure so, else the texts are shuffled once.

Edge cases: a null or empty text has no words, no hit and the digest of the
empty string; an item without words has no window; a null item id covers words
but is no item; repeated items count once; empty tables give no rows or no
hits; a very long text is one array of words in the task that reads it; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import maybe_broadcast, stored

#: Words of a window.
WINDOW = 10
#: Terms of a phrase whose posting lists are intersected, the rarest first.
RAREST = 3
#: Words on either side of a phrase's rarest term within which its others count as near.
NEAR = 20

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK), "")


def lowered(word: Column) -> Column:
    """A-Z lowered and nothing else; most words are lower case as they are."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, _UPPER, _LOWER))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's address in the index.  Two documents with one address would only
    share candidates, each of which is confirmed in its own text."""
    return F.xxhash64(F.col(doc_id).cast("string"), text)


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(phrase, item_id): the distinct windows of each item, as words joined by blanks."""
    words = items.select("item_id", F.transform(split_words(F.col("text")), lowered).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    return (words.select("item_id", "w", starts.alias("i"))
            .select(F.array_join(F.slice("w", F.col("i") + 1, width), " ").alias("phrase"), "item_id").distinct())


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """(window, offset, term) of distinct phrases."""
    return (phrases.select("window", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
            .withColumn("term_id", F.xxhash64("term")))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term_id, key, pos) of the given terms (term, term_id)."""
    split = docs.select(document_key().alias("key"), split_words(F.col("text")).alias("words"))  # once per text, below the generator
    tokens = split.select("key", F.posexplode("words").alias("pos", "word"))
    hits = tokens.withColumn("term", lowered(F.col("word"))).join(maybe_broadcast(terms), "term")
    return stored(hits.select("term_id", "key", "pos"), "postings")


def rarest_terms(index: DataFrame, terms: DataFrame, n: int = RAREST) -> DataFrame:
    """(window, term_id, offset, rank, size): the ``n`` rarest occurring terms of
    each phrase all of whose terms occur; rank 1 is the rarest."""
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("window")
    return (terms.join(counts, "term_id", "left")
            .withColumn("rank", F.row_number().over(whole.orderBy(F.col("n").asc_nulls_first(), "offset")))
            .withColumn("missing", F.max(F.col("n").isNull()).over(whole))
            .withColumn("size", F.count(F.lit(1)).over(whole))
            .where((F.col("rank") <= n) & ~F.col("missing"))
            .select("window", "term_id", "offset", "rank", "size"))


def phrase_candidates(index: DataFrame, seeds: DataFrame, n: int = RAREST) -> DataFrame:
    """(key, window, start): where all of a phrase's rarest terms stand at their
    offsets.  The shifted posting list of the rarest term is intersected with
    those of the next ones, so each step has at most the rows of the one before."""
    first = maybe_broadcast(stored(seeds.where("rank = 1").select("window", "term_id", "offset"), "seed-terms"))
    now = stored(index.join(first, "term_id").select("key", "window", (F.col("pos") - F.col("offset")).alias("start"))
                 .where("start >= 0").distinct(), "phrase-starts")
    for rank in range(2, n + 1):
        wanted = stored(now.join(maybe_broadcast(seeds.where(F.col("rank") == rank).select("window", "term_id", "offset")), "window")
                        .select("term_id", "key", (F.col("start") + F.col("offset")).alias("pos"), "window", "start"), "phrase-terms")
        lists = index.join(maybe_broadcast(seeds.where(F.col("rank") == rank).select("term_id").distinct()), "term_id", "left_semi")
        both = lists.join(maybe_broadcast(wanted), ["term_id", "key", "pos"]).select("key", "window", "start").distinct()
        short = seeds.where(f"rank = 1 and size < {rank}").select("window")
        now = stored(both.unionByName(now.join(maybe_broadcast(short), "window", "left_semi")), "phrase-starts")
    return now


def exact_matches(docs: DataFrame, candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, key, n_words and ``found``: the confirmed (window, start, len)."""
    per_doc = stored(candidates.join(maybe_broadcast(phrases), "window")
                     .groupBy("key").agg(F.collect_list(F.struct("window", "start", "phrase")).alias("tries")), "phrase-candidates")
    size = per_doc.agg(F.sum(F.expr("64 + aggregate(tries, 0L, (a, t) -> a + 64 + octet_length(t.phrase))"))).first()[0] or 0
    side = F.broadcast(per_doc) if size < 24 << 20 else per_doc
    joined = (docs.select("doc_id", "text", document_key().alias("key")).join(side, "key", "left")
              .select("doc_id", "key", "tries", split_words(F.col("text")).alias("w")))
    confirmed = F.expr(f"""
        transform(
          filter(tries, t -> translate(array_join(slice(w, t.start + 1, size(split(t.phrase, ' '))), ' '),
                                       '{_UPPER}', '{_LOWER}') = t.phrase),
          t -> struct(t.window AS window, t.start AS start, size(split(t.phrase, ' ')) AS len))""")
    return joined.select("doc_id", "key", F.size("w").cast("long").alias("n_words"),
                         F.when(F.col("tries").isNotNull(), confirmed).alias("found"))


def near_candidates(index: DataFrame, terms: DataFrame, width: int = NEAR, n: int = RAREST) -> DataFrame:
    """(key, window, at): places of a phrase's rarest term with its ``n`` rarest
    distinct terms within ``width`` words.

    Overlapping windows share their rarest terms, so places are kept for each
    distinct run of rarest terms (the first, the first two, ...), not for each
    window: the list of the first is intersected by blocks of positions with
    those of the next, and only what is left is given to the windows."""
    distinct = terms.groupBy("window", "term_id").agg(F.min("offset").alias("offset"))
    ranked = rarest_terms(index, distinct, n)
    runs = stored(ranked.groupBy("window").agg(*[F.max(F.when(F.col("rank") == r, F.col("term_id"))).alias(f"t{r}") for r in range(1, n + 1)],
                                               F.least(F.first("size"), F.lit(n)).cast("int").alias("last")), "near-runs")
    block = lambda at: F.floor(at / F.lit(2 * width + 1))
    first = maybe_broadcast(runs.select(F.col("t1").alias("term_id")).distinct())
    now = index.join(first, "term_id", "left_semi").select("key", F.col("pos").alias("at"), F.col("term_id").alias("t1")).distinct()
    found = None
    for r in range(1, n + 1):
        have = [f"t{k}" for k in range(1, r + 1)]
        if r > 1:
            asked = stored(runs.where(F.col("last") >= r).select(*have).distinct(), "near-asked")
            wanted = now.join(maybe_broadcast(asked), have[:-1]).withColumn(
                "block", F.explode(F.array_distinct(F.array(block(F.col("at") - width), block(F.col("at") + width)))))
            lists = (index.join(maybe_broadcast(asked.select(F.col(have[-1]).alias("term_id")).distinct()), "term_id", "left_semi")
                     .select(F.col("term_id").alias(have[-1]), "key", block(F.col("pos")).alias("block"), "pos"))
            now = stored(lists.join(maybe_broadcast(stored(wanted, "near-wanted")), [have[-1], "key", "block"])
                         .where(F.abs(F.col("pos") - F.col("at")) <= width).select("key", "at", *have).distinct(), "near-places")
        ended = stored(runs.where(F.col("last") == r).select("window", *have), "near-ended")
        mine = now.join(maybe_broadcast(ended), have).select("key", "window", "at")
        found = mine if found is None else found.unionByName(mine)
    return found


def near_matches(docs: DataFrame, index: DataFrame, terms: DataFrame, width: int = NEAR) -> DataFrame:
    """doc_id, key and n_near, the number of phrases that have a place of their
    rarest term in the text with all their other terms within ``width`` words."""
    need = terms.groupBy("window").agg(F.collect_set("term").alias("need"))
    tries = stored(near_candidates(index, terms, width).join(maybe_broadcast(stored(need, "near-needs")), "window")
                   .groupBy("key").agg(F.collect_list(F.struct("window", "at", "need")).alias("tries")), "near-tries")
    held = docs.select("doc_id", "text", document_key().alias("key")).join(maybe_broadcast(tries), "key").select(
        "doc_id", "key", "tries", split_words(F.col("text")).alias("w"))
    around = f"slice(w, greatest(t.at - {width}, 0) + 1, t.at + {width} - greatest(t.at - {width}, 0) + 1)"
    near = F.expr(f"""
        filter(tries, t -> size(array_except(t.need, split(translate(array_join({around}, ' '), '{_UPPER}', '{_LOWER}'), ' '))) = 0)""")
    return held.select("doc_id", "key", F.size(F.array_distinct(F.transform(near, lambda t: t["window"]))).cast("long").alias("n_near"))


def matched(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(found, windows, index, terms): per document the confirmed windows, the
    windows of each item, the postings and the terms of the windows; all stored."""
    by_item = stored(item_windows(benchmark, width), "benchmark-items")
    phrases = stored(by_item.select("phrase").distinct().withColumn("window", F.monotonically_increasing_id()), "benchmark-phrases")
    windows = stored(by_item.join(phrases, "phrase").select("window", "item_id"), "benchmark-windows")
    terms = stored(phrase_terms(phrases), "benchmark-terms")
    index = build_index(docs, stored(terms.select("term", "term_id").distinct(), "benchmark-vocabulary"))
    seeds = stored(rarest_terms(index, terms), "benchmark-seeds")
    return stored(exact_matches(docs, phrase_candidates(index, seeds), phrases), "phrase-matches"), windows, index, terms


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near per document."""
    found, windows, index, terms = matched(docs, benchmark, width)
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1)))))
    items = (found.where("size(found) > 0").select("doc_id", "key", F.explode(F.expr("array_distinct(found.window)")).alias("window"))
             .join(maybe_broadcast(windows.where("item_id is not null")), "window")
             .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("_id", "_key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    near = near_matches(docs, index, terms).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.max("n_near").alias("n_near"))
    # one small table of what was found, joined to all documents once
    extra = (items.unionByName(near, allowMissingColumns=True).groupBy("_id", "_key")
             .agg(F.max("items").alias("items"), F.max("n_near").alias("n_near")))
    out = found.select("doc_id", "key", "n_words", F.coalesce(F.when(F.size("found") > 0, n_hit), F.lit(0)).cast("long").alias("n_hit"))
    return out.join(extra, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, as they are."""
    found = matched(docs, benchmark, width)[0]
    bad = stored(found.where("size(found) > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "contaminated")
    own = docs.withColumn("_row", document_key())
    return own.join(maybe_broadcast(bad), (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)
