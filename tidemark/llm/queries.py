"""The queries of this subpackage, one for each operator, over whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cap_filters, chat, hard_negatives, line_dedup, mixing, packing, perplexity, rule_ensemble, simhash, spelling, token_counts, token_orc, url_reputation
from tidemark.llm.shared import new_path


def tokenizer() -> str:
    """The place of the tokenizer's file, looked up when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity", "lower", "upper")


#: Repeated lines, paragraphs and runs of sentences of so many words are removed.
RUN_WORDS = 25


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the removed places, as start-stop in characters, and what is left of its text."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"), min_words=RUN_WORDS)
    places = F.array_join(F.transform("removed", lambda p: F.concat_ws("-", p["start"], p["stop"])), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), places.alias("removed"), F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0, "seed": "mix"}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=2, capacity=1024)


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's rendering as number of characters and MD5, its masks as start-stop."""
    found = chat.perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    return found.select("conv_id", "speaker", "segment", "n_turns", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), masks.alias("masks"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return token_orc.digests(token_orc.read_tokens(spark, path))


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_reputation.judge(table(spark, sf_dir, "pages"), url_reputation.good_page(F.col("html")), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_ensemble.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", (rule_ensemble.remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


#: Texts with more tokens than this are marked.
TOKEN_LIMIT = 1024


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored counts of every prefix; a text's own count is that of its longest one."""
    found = token_counts.totals(token_counts.prefix_table(table(spark, sf_dir, "documents"), tokenizer()))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.occurrences(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_perplexity": op1_perplexity,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_mix_sources": op4_mix_sources,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_token_orc": op7_token_orc,
    "op8_url_reputation": op8_url_reputation,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_cap_filters": op10_cap_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.oracle("documents", RUN_WORDS),
    "op4_mix_sources": mixing.oracle("documents", **MIX),
    "op6_chat_perspectives": chat.oracle("conversations"),
    "op8_url_reputation": url_reputation.oracle("pages", RULES),
    "op11_hard_negatives": hard_negatives.oracle("embeddings"),
    "op13_spelling_variants": spelling.oracle("documents"),
}
