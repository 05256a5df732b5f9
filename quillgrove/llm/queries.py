"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import chat_format, conversation_repair, decontamination, html_template, hyper_minhash, line_dedup, packing, quality_ledger, simhash_vptree, token_alignment, token_io, toxicity, url_trust
from quillgrove.session import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_text(read_table(spark, sf_dir, "pages"))


#: The host rules that the url query applies.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


#: A conversation whose texts hold control strings of chat templates.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    turns = chat_format.canonical_turns(chat_format.turn_records(rows), strict=True)
    return chat_format.digest_conversations(chat_format.format_turns(turns))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_io.token_path(spark, "tokens")
    token_io.write_tokens(read_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_io.token_digests(spark, path)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars_left"), "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.store(read_table(spark, sf_dir, "documents"))
    rows = quality_ledger.judge(rows, quality_ledger.STANDARD)
    base_failed = F.col("failed").bitwiseAND(F.lit(quality_ledger.BASE.mask)) != 0
    rows = rows.withColumn("base_failed", base_failed).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policies rejects, and rejects alone, from a stored ledger."""
    rows = quality_ledger.store(read_table(spark, sf_dir, "documents"))
    return quality_ledger.ablations(rows, [quality_ledger.BASE, quality_ledger.STANDARD])


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(read_table(spark, sf_dir, "conversations"), damage=True)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_scores(read_table(spark, sf_dir, "documents"), TOKENIZER, PIECE_MODEL)


def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=5, similarity=0.85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_template": op1_html_template,
    "op2_url_trust": op2_url_trust,
    "op3_simhash_vptree": op3_simhash_vptree,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_token_blocks": op6_token_blocks,
    "op7_line_chunks": op7_line_chunks,
    "op8_packing": op8_packing,
    "op9_quality_ledger": op9_quality_ledger,
    "op10_template_windows": op10_template_windows,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_hyper_minhash": op13_hyper_minhash,
    "quality_ablations": quality_ablations,
}

SQL: dict[str, str] = {
    "op2_url_trust": url_trust.oracle(URL_RULES),
    "op4_chat_format": chat_format.SQL,
    "op9_quality_ledger": quality_ledger.SQL,
    "op11_conversation_repair": conversation_repair.oracle(),
    "quality_ablations": quality_ledger.ABLATION_SQL,
}
