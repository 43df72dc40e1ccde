"""New samples as a stream: finished ones are dropped, the touched studies' aggregates are worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from sievework.functions.missing import is_missing


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def study_counts(rows: DataFrame) -> DataFrame:
    """(gse, field, n_total, n_ns) of phase rows."""
    return rows.groupBy("gse", "field").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(is_missing(F.col("value"), "cache")).alias("n_ns"))


def merge_batch(batch: DataFrame, batch_id: int, rows_path: str, counts_path: str) -> None:
    """Add a batch's new (gsm, field) rows and write the counts of the studies it touches as this batch's version.

    A batch that is run again after a failure overwrites its own files, so it counts once."""
    spark = batch.sparkSession
    new = batch.filter("gsm is not null and field is not null").groupBy("gse", "gsm", "field").agg(F.max("value").alias("value"))
    old = _read(spark, rows_path)
    if old is not None:
        old = old.filter(F.col("batch") != batch_id).select("gse", "gsm", "field", "value")
        new = new.join(old.select("gsm", "field").distinct(), ["gsm", "field"], "left_anti")
    new = new.select("gse", "gsm", "field", "value").persist()
    new.write.mode("overwrite").parquet(f"{rows_path}/batch={batch_id}")
    touched = new.select("gse").distinct()
    rows = new if old is None else old.join(touched, "gse", "left_semi").unionByName(new)
    study_counts(rows).write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")
    new.unpersist()


def latest_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """The counts of each study and field by its last batch."""
    df = spark.read.parquet(counts_path)
    return df.groupBy("gse", "field").agg(F.max_by(F.struct("n_total", "n_ns"), "batch").alias("c")).select("gse", "field", "c.n_total", "c.n_ns")


def start(spark: SparkSession, source: str, schema: str, rows_path: str, counts_path: str, checkpoint: str, *, files_per_batch: int = 100) -> StreamingQuery:
    """Run over all Parquet files in ``source`` and those that come while it runs, until there are no more. schema: gse, gsm, field, value."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda b, i: merge_batch(b, i, rows_path, counts_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(stream: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type, dropping those later than ``late``; works on a stream and on a table."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
