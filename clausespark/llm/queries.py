"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausespark.llm import cap_filters, fingerprints, gray_index, hard_negatives, language_id, mixing, personal_data, positional_index, prefix_trie, quality, quotes, secret_scan, sharding, spans
from clausespark.llm.common import table

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def wrap(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op2_mix_sources")
def op2_mix_sources(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op10_minimax_shards")
def op10_minimax_shards(spark, folder):
    return sharding.shard(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("op4_gray_simhash")
def op4_gray_simhash(spark, folder):
    return gray_index.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op9_simhash_fingerprints")
def op9_simhash_fingerprints(spark, folder):
    return fingerprints.compare_with_edited(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_positional_decontamination", positional_index.ORACLE)
def op3_positional_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return positional_index.mark_contaminated(docs, table(spark, folder, "benchmark")).drop("text")


@query("op1_bigru_language")
def op1_bigru_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op6_crf_secrets")
def op6_crf_secrets(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"), secret_scan.train())
    return spans.digest(found, secret_scan.BASE_KINDS, [secret_scan.KIND])


@query("op8_crf_personal_data")
def op8_crf_personal_data(spark, folder):
    found = personal_data.scan(table(spark, folder, "documents").select("doc_id", "text"), personal_data.train())
    return spans.digest(found, personal_data.BASE_KINDS, personal_data.KINDS)


@query("op7_ordinal_quality")
def op7_ordinal_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rated = quality.rate(docs, quality.fit(docs, table(spark, folder, "labels")))
    return rated.select("doc_id", language_id.held_out().alias("held_out"), "expected_grade", "top_probability", "selected")


@query("op5_quotation_links")
def op5_quotation_links(spark, folder):
    return quotes.formatted(table(spark, folder, "conversations"))


@query("op11_centroid_prefix_trie")
def op11_centroid_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query("op12_threshold_hard_negatives", hard_negatives.ORACLE)
def op12_threshold_hard_negatives(spark, folder):
    return hard_negatives.mine(table(spark, folder, "embeddings"))


@query("op13_cap_filter_dedup")
def op13_cap_filter_dedup(spark, folder):
    return cap_filters.near_duplicates(table(spark, folder, "embeddings"))
