"""Problem 8: documents into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.packing import pack
from sievework.llm.tokenizer import encode
from sievework.sources.tables import table

CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, start, size, container_id): where every document's tokens go."""
    sizes = encode(table(spark, sf_dir, "documents"), keep=["doc_id"], counts_only=True)
    return pack(sizes, id_col="doc_id", size_col="n_tokens", capacity=CAPACITY)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, the least number of containers that the tokens need, and the share of space used."""
    out = p8_containers(spark, sf_dir).agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
    return out.withColumn("least", F.ceil(F.col("tokens") / CAPACITY)).withColumn("used", F.col("tokens") / (F.col("containers") * CAPACITY))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents in containers, containers above the capacity, and documents whose parts don't follow one another from
    token 0 on, don't add up to their tokens, or are several without need."""
    parts = p8_containers(spark, sf_dir)
    over = parts.groupBy("container_id").agg(F.sum("size").alias("fill")).agg(F.count_if(F.col("fill") > CAPACITY).alias("overfull"))
    sizes = encode(table(spark, sf_dir, "documents"), keep=["doc_id"], counts_only=True)
    per = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("tokens"), F.max(F.col("start") + F.col("size")).alias("end"), F.count_if(F.col("start") != F.col("part") * CAPACITY).alias("misplaced"))
    whole = (F.col("tokens") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("misplaced") == 0) & (F.col("parts") == F.ceil(F.col("n_tokens") / CAPACITY))
    docs = per.join(sizes, "doc_id", "full_outer").filter("n_tokens > 0 or parts > 0").agg(F.count(F.col("parts")).alias("documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("broken"))
    return docs.crossJoin(over)


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks}
ORACLES = {"p8_checks": "select count(*) documents, 0::bigint broken, 0::bigint overfull from documents where text <> ''"}
