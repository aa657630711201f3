"""A corpus pipeline of five stages, each over all that the one before kept.

documents -> quality rules -> n-gram Jaccard join -> pseudonyms -> mixing -> packing. Every stage takes (spark, docs, sf_dir); all but the
last return the columns of documents, in their order. What a stage returns is written and read again before the next, and what it wrote on the way is deleted.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    from spandrel.llm.quality_rules import quality_rules

    return quality_rules(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one with the smallest doc_id. Rows without words stay."""
    from spandrel.llm.ngram_join import jaccard_join

    return jaccard_join(docs, n_words=5, threshold=(80, 100), carry=COLUMNS).filter("kept").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; n_chars follows the text."""
    from spandrel.llm.pseudonyms import pseudonymise

    out = pseudonymise(docs.select(*COLUMNS), counted="_changed")
    return out.withColumn("n_chars", F.when(F.col("_changed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target asks."""
    from spandrel.llm.mixing import mixed_documents

    return mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document, with its ids' place."""
    import public_tokenizers

    from spandrel.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("pii_pseudonyms", private), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: The tokenizer has no SQL form, so the pipeline is tested against a brute-force version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        docs = settled(spark, f"stage-{name}", partial(stage, spark, docs, sf_dir))
