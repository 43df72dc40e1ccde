"""Records that differ only in how they are written, found over a dictionary encoding.

Every distinct value of a column is canonicalised once and its canonical form gets an integer id; records become tuples
of (field, id) integers, and equal tuples are one record.

Values that make up more than one in ``hot`` of the rows are at most ``hot`` in number; they are joined by a broadcast
of that proven size, and so are the hot tuples, so neither join sends a third of all rows to one task. Everything else
is aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.runtime import cut

#: A row that doesn't matter for the content: everything but letters, digits, %, a + or - after a letter or digit and not before one, and a point between digits.
NOISE = r"(?s)(?![\p{L}\p{N}%])(?!(?<=[\p{L}\p{N}])[+\-](?![\p{L}\p{N}]))(?!(?<=\p{Nd})\.(?=\p{Nd}))."
#: What parts a label.
PARTED = r"[;|\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]"


def content(col: Column) -> Column:
    """The canonical form of a label: its parts' letters, digits and meaningful signs, without case, sorted. Empty for a label without any; null stays null."""
    parts = F.transform(F.split(F.lower(col), PARTED), lambda p: F.regexp_replace(p, NOISE, ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "|")


def _hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, hot: int) -> DataFrame:
    """Inner join of rows with one row per key; keys with ``n`` > total / hot (fewer than ``hot``) by broadcast, the rest by shuffle."""
    limit = max(total // hot, 1)
    many = F.broadcast(right.filter(F.col(n) > limit).drop(n))
    few = left.join(F.broadcast(right.filter(F.col(n) > limit).select(*on)), on, "left_anti")
    return left.join(many, on).unionByName(few.join(right.filter(F.col(n) <= limit).drop(n), on))


def encode(df: DataFrame, columns: dict[str, Column | None], total: int, hot: int) -> DataFrame:
    """``df`` with each of ``columns`` replaced by the integer id of its canonical form (the value itself where None)."""
    for name, canon in columns.items():
        raw = df.groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
        raw = cut(raw.select(F.coalesce(F.col(name), F.lit("")).alias("value"), F.col(name).isNull().alias("absent"), "rows", *([canon.alias("canon")] if canon is not None else [F.col(name).alias("canon")])))
        ids = cut(raw.select("canon", "absent").distinct().select("canon", "absent", F.monotonically_increasing_id().alias("id")))
        same = (F.col("c.canon").eqNullSafe(F.col("i.canon"))) & (F.col("c.absent") == F.col("i.absent"))
        codes = cut(raw.alias("c").join(ids.alias("i"), same).select("c.value", "c.absent", "c.rows", "i.id"))
        left = df.withColumns({"value": F.coalesce(F.col(name), F.lit("")), "absent": F.col(name).isNull()}).drop(name)
        df = _hot_join(left, codes, ["value", "absent"], "rows", total, hot).withColumnRenamed("id", name).drop("value", "absent")
    return df


def duplicates(df: DataFrame, *, id_col: str, exact: list[str], text: str, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(records, copies) of the rows of ``df``, of which those are the same record whose ``exact`` columns are equal and whose ``text`` has the same content.

    records: (first_id, n_copies) with the smallest id of each; copies: (first_id, copy_id), a row for each further row.
    Null is a value of its own: nulls are equal to nulls only. Rows must have an id; repeated ids count as copies of their
    own only once. Other columns don't matter, whatever their names. Empty input gives empty tables.
    """
    rows = df.select(F.col(id_col).alias("rid"), *[F.col(c).cast("string").alias(f"e{i}") for i, c in enumerate(exact)], F.col(text).alias("t")).filter("rid is not null")
    total = rows.count()
    fields = [f"e{i}" for i in range(len(exact))] + ["t"]
    codes = encode(rows, {**{f: None for f in fields[:-1]}, "t": content(F.col("t"))}, total, hot)
    # the tuple: field numbers with value ids, in the order of the field numbers
    codes = cut(codes.select("rid", F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(fields)]).alias("tuple")))
    records = cut(codes.groupBy("tuple").agg(F.min("rid").alias("first_id"), F.count(F.lit(1)).alias("n_copies")))
    several = records.filter("n_copies > 1").withColumn("n", F.col("n_copies")).drop("n_copies")
    copies = _hot_join(codes, several, ["tuple"], "n", total, hot).filter("rid <> first_id").select("first_id", F.col("rid").alias("copy_id"))
    return records.select("first_id", "n_copies"), copies
