"""The queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_chats, text_part

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_chats(turns.withColumn("parts", text_part(F.col("text")))))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), counted="n_replaced")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op4_mixing, op10_pseudonyms)}


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES |= {f.__name__: f for f in (op9_ngram_join,)}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES |= {f.__name__: f for f in (op8_packing,)}


def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import embedding_join

    return embedding_join(table(spark, sf_dir, "embeddings"))


QUERIES |= {f.__name__: f for f in (op7_embedding_join,)}


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op3_lm_scoring,)}


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import fit, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES |= {f.__name__: f for f in (op6_quality_mil,)}


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_labeller import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES |= {f.__name__: f for f in (op5_html_text,)}


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import Ranks, encode, read_ranks

    ranks = Ranks(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    out = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, carry=["doc_id"])
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(ranks.decoded(F.col("ids")), 256).alias("decoded_sha256"))


QUERIES |= {f.__name__: f for f in (op12_byte_bpe,)}


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_collocations,)}


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op13_spelling,)}
