"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.shared import table


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.token_records import token_records

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("key", "removed")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.mixing import Mix

    return Mix(table(spark, sf_dir, "documents")).shares()


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.embedding_groups import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from tidelog.llm.pieces import encoded

    ways = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return ways.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "n_ways", "last_score", "ids_crc32", "ways_crc32", "same")


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.ngram_trie import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quotes import linked_conversations

    return linked_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {"op3_token_records": op3_token_records, "op10_simhash": op10_simhash, "op6_quality_rules": op6_quality_rules, "op4_mixing": op4_mixing, "op1_quality_model": op1_quality_model, "op9_embedding_groups": op9_embedding_groups, "op8_toxicity": op8_toxicity, "op2_pieces": op2_pieces, "op5_quotes": op5_quotes, "op7_ngram_trie": op7_ngram_trie}


def oracle_sql() -> dict[str, str]:
    from tidelog.llm.oracles import MIXING, QUALITY_RULES, QUOTES

    return {"op4_mixing": MIXING, "op5_quotes": QUOTES, "op6_quality_rules": QUALITY_RULES}
