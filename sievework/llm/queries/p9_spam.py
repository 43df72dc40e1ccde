"""Problem 9: documents of keywords, links or product tags instead of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.spam import spam_pages
from sievework.sources.tables import table


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, spam_share, redundancy, sentence_density, is_spam) of every document with words."""
    return spam_pages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).filter("is_spam").select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores}
