"""What the operators need of the running session: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default bound, in rows, for a side that an operator broadcasts; callers check it before they do.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievework-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage.

    A checkpoint keeps its plan's estimated size, a product over joins; over rounds that build on each other the estimates
    double their digits every time until planning does nothing but multiply them. So the rows are taken without it (and
    without inferred constraints); what is really there shows at the next shuffle.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    there = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(there.queryExecution().toRdd(), there.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let go of what earlier rounds left behind: their shuffle files, broadcasts, checkpoints and compiled code go only when the
    driver collects its garbage, which it may not do for a long time while rounds go on."""
    gc.collect()
    spark._jvm.System.gc()


def count_by(df: DataFrame, col: str) -> dict:
    """Row counts for a column of few, fixed values (kinds, stages), for driver-side control."""
    return {r[0]: r[1] for r in df.groupBy(col).agg(F.count(F.lit(1))).collect()}


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven to have at most ``rows`` rows.

    The check stops at ``rows + 1``; a larger side is left to a shuffled join.
    """
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside; the one before stands again afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
