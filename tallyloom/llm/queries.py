"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_pairs, decontaminate, filter_audit, html_extract, jaccard, pii, quality_model, quality_rules, repeats, secrets, sentencepieces, sharding, whitening
from tallyloom.llm.common import table


def piece_model() -> str:
    """The tokenizer of the contract; the operator takes any model's path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The contract's bound on a score that counts as good.
ACCEPT = 0.3


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fitted(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"]
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.components(docs, rule=jaccard.Rule(width=3, p=90, q=100))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), piece_model(), keep=["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return sharding.shard(table(spark, sf_dir, "documents")).select(*names)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, keep=["page_id", "url"])


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), byte_model(), keep=["doc_id"])


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3: the base spans."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4: the counts and the base rules."""
    return quality_rules.base_rules(quality_rules.statistics(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8: the base spans."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7: each shard's number of records, bounds of its slots, and the sum of all sizes."""
    one = op7_sharding(spark, sf_dir)
    shards = one.groupBy("shard").agg(F.count("*").alias("records"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return shards.crossJoin(F.broadcast(one.agg(F.sum("size").alias("size"))))  # one row


_QUERIES = [op1_decontamination, op2_quality_classifier, op3_pii, op4_quality_rules, op5_jaccard_join, op6_sentencepiece, op7_sharding, op8_secrets, op9_substring_dedup, op10_html_extraction, op11_byte_pairs, op12_whitening, op13_filter_audit, pii_base, quality_counts, secrets_base, sharding_law]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
