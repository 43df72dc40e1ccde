"""Problem 7: all documents as token ids of byte_bpe_50k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.tokenizer import encode
from sievework.sources.tables import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"])


def p7_tokens_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, documents, tokens): the corpus's size in tokens by language code as given."""
    per = encode(table(spark, sf_dir, "documents"), keep=["lang"], counts_only=True)
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_tokens_by_language": p7_tokens_by_language}
