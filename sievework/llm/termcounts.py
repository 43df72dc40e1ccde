"""Occurrence and record counts of every term, kept up to date by signed deltas.

Added records come with sign +1, deleted ones with -1, a changed one as its old form with -1 and its new form with +1.
A change is first summed per (source, term, record), so that a frequent term is spread over its records, then compared
with the stored cell to tell whether the record begins or ceases to hold the term, and only then summed per term (with
partial sums before the shuffle). The store keeps three tables in buckets by hash: cells (term in record, in buckets by
record, so that a term of a tenth of all rows is spread over all of them), terms and records; their number is set by the
first load's size. An update reads and rewrites only the buckets that its change touches, as a new version; the manifest,
written last, names the valid version of each bucket, so an update that dies leaves the counts as they were and is
overwritten by the next.

Defined results: null terms, and rows with a null record, don't count; occurrences of null count 0 but the record holds the
term; deleting what was never added is carried as a negative count until its addition arrives late; an empty change
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.runtime import cut

KEYS = {"cells": ["src", "term", "record"], "terms": ["src", "term"], "records": ["src", "record"]}
VALUES = {"cells": ["occ", "n"], "terms": ["occ", "records"], "records": ["terms"]}
#: The columns whose hash gives a row's bucket.
SPREAD = {"cells": ["src", "record"], "terms": ["src", "term"], "records": ["src", "record"]}


class TermCounts:
    """The store below ``path``, a folder that all executors share. buckets: of each table; by default one for each
    ``bucket_rows`` cells of the first load, eight at least."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.buckets, self.bucket_rows = spark, path.rstrip("/"), buckets, bucket_rows

    def _folder(self, name: str = ""):
        """The file system and path of a folder of the store."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def remove(self) -> None:
        """Delete the store with all versions."""
        fs, path = self._folder()
        fs.delete(path, True)

    def _manifest(self) -> dict[str, dict[int, int]]:
        """Table -> bucket -> version; at most three times ``buckets`` rows."""
        fs, path = self._folder("manifest")
        if not fs.exists(path):
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest").groupBy("kind", "bucket").agg(F.max("version").alias("version"), F.max("buckets").alias("buckets")).collect()
        out: dict[str, dict[int, int]] = {}
        for r in rows:
            out.setdefault(r["kind"], {})[r["bucket"]] = r["version"]
            self.buckets = r["buckets"]
        return out

    def _read(self, kind: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
        """The valid rows of a table, of some buckets."""
        at = {b: v for b, v in manifest.get(kind, {}).items() if only is None or b in only}
        fields = ", ".join([f"{k} string" for k in KEYS[kind]] + [f"{v} long" for v in VALUES[kind]])
        if not at:
            return self.spark.createDataFrame([], fields)
        paths = [f"{self.path}/{kind}/version={v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(fields).parquet(*paths)

    def terms(self) -> DataFrame:
        """(src, term, occ, records) of the terms that any record holds."""
        return self._read("terms", self._manifest()).filter("records > 0")

    def totals(self) -> DataFrame:
        """(src, total): the records that hold any term, for each source."""
        return self._read("records", self._manifest()).filter("terms > 0").groupBy("src").agg(F.count(F.lit(1)).alias("total"))

    def update(self, changes: DataFrame) -> None:
        """Merge changes (src, term, record, occ, sign) into the counts."""
        manifest = self._manifest()
        version = 1 + max((v for at in manifest.values() for v in at.values()), default=0)
        delta = changes.filter("src is not null and term is not null and record is not null").groupBy(*KEYS["cells"]).agg(F.sum(F.coalesce("occ", F.lit(0)) * F.col("sign")).alias("occ"), F.sum("sign").cast("long").alias("n"))
        delta = cut(delta.filter("occ <> 0 or n <> 0"))
        if self.buckets is None:
            self.buckets = max(8, -(-delta.count() // self.bucket_rows))
        held = lambda n: F.when(n > 0, 1).otherwise(0)
        if manifest:
            old = self._read("cells", manifest, self._touched(delta, "cells")).select(*KEYS["cells"], F.col("occ").alias("occ0"), F.col("n").alias("n0"))
            cells = delta.join(old, KEYS["cells"], "full_outer")
            for c in ("occ", "n", "occ0", "n0"):
                cells = cells.withColumn(c, F.coalesce(c, F.lit(0)))
            cells = cut(cells.withColumn("turn", held(F.col("n") + F.col("n0")) - held(F.col("n0"))))
        else:
            cells = delta.withColumns({"occ0": F.lit(0), "n0": F.lit(0), "turn": held(F.col("n"))})
        self._write("cells", cells.select(*KEYS["cells"], (F.col("occ") + F.col("occ0")).alias("occ"), (F.col("n") + F.col("n0")).alias("n")).filter("occ <> 0 or n <> 0"), version)
        changed = cells.filter("occ <> 0 or turn <> 0")
        self._merge("terms", changed.groupBy("src", "term").agg(F.sum("occ").alias("occ"), F.sum("turn").alias("records")), manifest, version)
        self._merge("records", changed.filter("turn <> 0").groupBy("src", "record").agg(F.sum("turn").alias("terms")), manifest, version)
        new = [(k, b, version) for k in KEYS for b in self._written(k, version)]
        gone = [(k, b, version) for k in KEYS for b in (self._touched(delta, k) if manifest else ()) if b in manifest.get(k, {}) and (k, b, version) not in new and k == "cells"]
        for k, b, _ in gone:  # a bucket that became empty gets an empty version
            self._read(k, {}).write.parquet(f"{self.path}/{k}/version={version}/bucket={b}")
        if new or gone:
            self.spark.createDataFrame([(*x, self.buckets) for x in new + gone], "kind string, bucket int, version int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _bucket(self, kind: str):
        return F.pmod(F.xxhash64(*SPREAD[kind]), F.lit(self.buckets)).cast("int")

    def _touched(self, df: DataFrame, kind: str) -> set[int]:
        """The buckets (a fixed number at most) that a change falls into."""
        return {r[0] for r in df.select(self._bucket(kind)).distinct().collect()}

    def _merge(self, kind: str, delta: DataFrame, manifest: dict, version: int) -> None:
        keys, values = KEYS[kind], VALUES[kind]
        if manifest:
            delta = cut(delta)
            delta = self._read(kind, manifest, self._touched(delta, kind)).union(delta.select(*keys, *values)).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        self._write(kind, delta.select(*keys, *values), version)

    def _write(self, kind: str, df: DataFrame, version: int) -> None:
        df.withColumn("bucket", self._bucket(kind)).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/version={version}")

    def _written(self, kind: str, version: int) -> list[int]:
        """The buckets that a finished write has made."""
        fs, path = self._folder(f"{kind}/version={version}")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def mark_terms(terms: DataFrame, totals: DataFrame, *, rare: int = 2, common_in: int = 100) -> DataFrame:
    """terms with total and mark: ``rare`` up to ``rare`` occurrences, else ``common`` if more than one in ``common_in`` records of the source holds it, else null. totals has a row for each source."""
    mark = F.when(F.col("occ") <= rare, "rare").when(F.col("records") * common_in > F.col("total"), "common")
    return terms.join(F.broadcast(totals), "src").withColumn("mark", mark)
