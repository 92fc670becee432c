"""Work along an order, for keys of any size: running sums, last values carried forward, and row numbers.

Rows are dealt by ranges of (key, order, spread), so that a key with a third of all rows spreads over tasks. The
ranges are stored, since a task run again must not deal them anew. Windows run inside a (range, key), and one row
for each (range, key) says what the ranges before it hand over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.sinks import stored

START = Window.unboundedPreceding


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` stored by ranges of ``order`` and of a hash of each row, with ``_range`` numbering them in that order.

    The hash lets rows that are equal in the order spread too.
    """
    spread = F.xxhash64(*df.columns)
    return stored(df.repartitionByRange(*order, spread).withColumn("_range", F.spark_partition_id()))


def _beside(rows: DataFrame, handed: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``handed``, which has one row for each (range, key), null keys too."""
    other = handed.select(F.col("_range").alias("_r"), F.col(key).alias("_k"), *[c for c in handed.columns if c not in ("_range", key)])
    return rows.join(other, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_r", "_k")


def prefix_sums(df: DataFrame, key: str, order: str, value: str, out: str, kind: str = "decimal(18,2)") -> DataFrame:
    """``df`` with the sum of ``value`` of all rows of its key up to its place in the order, equals included.

    The same as a window over the key with a RANGE frame. Equal places that lie across the edge of a range share
    a value: the last place of a range also takes what the ranges after it hold of that place. Null values add
    nothing, null keys are one key; places aren't null.
    """
    rows = ranged(df, key, order)
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,6)")
    place = rows.groupBy("_range", key, order).agg(number(value).alias("_s"))
    edges = place.groupBy("_range", key).agg(
        F.min(F.struct(order, "_s")).alias("first"), F.max(order).alias("last"), F.sum("_s").alias("total"))
    # one row a (key, range)
    along = Window.partitionBy(key).orderBy("_range")
    same = Window.partitionBy(key, "first_at").orderBy(F.desc("_range"))
    edges = edges.select("_range", key, F.col(f"first.{order}").alias("first_at"), F.col("first._s").alias("first_sum"), "last", "total")
    edges = edges.withColumn("from_here", F.sum("first_sum").over(same.rowsBetween(START, 0)))
    edges = edges.select(
        "_range", key, "last", F.coalesce(F.sum("total").over(along.rowsBetween(START, -1)), F.lit(0)).alias("_before"),
        F.when(F.lead("first_at").over(along) == F.col("last"), F.lead("from_here").over(along)).otherwise(0).alias("_after"),
    )
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range", key).orderBy(order)), F.lit(0))
    summed = _beside(rows.withColumn("_own", own), edges, key)
    shared = F.when(F.col(order) == F.col("last"), F.col("_after")).otherwise(0)
    return summed.select(*df.columns, (F.col("_own") + F.col("_before") + shared).cast(kind).alias(out))


def asof_merge(lines: DataFrame, versions: DataFrame, key: str, at: str, start: str, carried: list[str]) -> DataFrame:
    """``lines`` with the ``carried`` columns of their key's last version that starts at ``at`` or before it.

    Versions and lines go in one order, and the last version seen is carried forward: through a range by a
    window, into it by one row for each (range, key). No pairs of lines and versions are made, so the work is that
    of sorting, however many versions a key has. Lines before any version get nulls; of versions that start
    together the one with the greatest carried columns counts. Lines and versions without a key are one key's.
    """
    line, version = F.struct(*lines.columns), F.struct(*carried)
    both = lines.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), line.alias("_line"), F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType).alias("_version"))
    both = both.unionByName(versions.select(F.col(key).alias("_key"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(lines.select(line.alias("l")).schema["l"].dataType).alias("_line"), version.alias("_version")))
    rows = stored(both.repartitionByRange("_key", "_at", "_kind", F.xxhash64("_line", "_version")).withColumn("_range", F.spark_partition_id()))
    # versions that start together may lie in two ranges: the greatest of a place is the one that is handed on
    keyed = rows.groupBy("_range", "_key").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_version"))).alias("top"))
    handed = keyed.select("_range", "_key", F.max("top").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(START, -1)).alias("_handed"))
    along = Window.partitionBy("_range", "_key").orderBy("_at", "_kind", "_version").rowsBetween(START, 0)
    seen = F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_version"))).over(along)
    found = _beside(rows.withColumn("_seen", seen).where("_kind = 1"), handed, "_key")
    best = F.greatest(F.col("_seen"), F.col("_handed"))["_version"]
    return found.select("_line.*", *[best[c].alias(c) for c in carried])


def dense_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with numbers from 1 to its count in the given order: ranges, ranks inside them, and one offset a range.

    Rows that are equal in the order are numbered in any order.
    """
    rows = ranged(df, *order)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(START, -1)), F.lit(0)).alias("_from"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_from") + F.col("_own")).cast("long").alias(out))
