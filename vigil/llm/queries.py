"""The registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return put


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.decontaminate import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_html_wrappers")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.wrappers import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.urlfilter import judge
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op5_quality_cnn")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.quality import judge_quality
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import pack_documents, vocabulary
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_phrase_automata")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.passages import without_repeats
    return without_repeats(table(spark, sf_dir, "documents"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.fingerprints import with_neighbours
    return with_neighbours(table(spark, sf_dir, "documents"))


@query("op9_minimax_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.sharding import minimax_shards
    return minimax_shards(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.langid import language_id
    return language_id(table(spark, sf_dir, "documents"))


@query("op11_vector_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.packing import vocabulary
    from vigil.llm.vectorpack import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.spelling import spelling_forms
    return spelling_forms(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.prefixtrie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations"))
