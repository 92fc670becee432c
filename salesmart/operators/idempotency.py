"""Does a rerun leave the tables as they were? Fingerprints kept by partition, so that only what was rewritten is hashed.

A partition's fingerprint is its rows and two sums of row hashes. Sums add up: a table's fingerprint after a rerun
is the one before, less the old fingerprints of the rewritten partitions, plus their new ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import partition_dates
from .quality import row_hashes

FIGURES = ("row_cnt", "hash_sum", "reverse_hash_sum")


def partition_fingerprints(name: str, table: DataFrame, method: str = "md5") -> DataFrame:
    """table_name, dt, row_cnt, hash_sum, reverse_hash_sum of each partition; one pass, combined before the shuffle."""
    forward, backward = row_hashes(table, method)
    return table.groupBy("dt").agg(F.count(F.lit(1)).alias("row_cnt"), forward.alias("hash_sum"), backward.alias("reverse_hash_sum")).select(F.lit(name).alias("table_name"), "dt", *FIGURES)


def rewritten_fingerprints(spark: SparkSession, name: str, path: str, dates: list[str], method: str = "md5") -> DataFrame:
    """Fingerprints of the given partitions of a stored table, of which alone files are read. Partitions that went have none."""
    have = [d for d in partition_dates(spark, path) if d in set(dates)]
    if not have:
        return spark.createDataFrame([], "table_name string, dt string, row_cnt long, hash_sum decimal(38,0), reverse_hash_sum decimal(38,0)")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/dt={d}" for d in have])
    return partition_fingerprints(name, rows.withColumn("dt", F.col("dt").cast("string")), method)


def replaced(stored_prints: DataFrame, new: DataFrame, dates: list[str]) -> DataFrame:
    """The stored fingerprints with those of the rewritten ``dates`` in the place of theirs, for all tables in ``new`` or not."""
    return stored_prints.where(~F.col("dt").isin(dates)).unionByName(new)


def totals(prints: DataFrame) -> DataFrame:
    """A fingerprint of each table: the sums of its partitions'."""
    return prints.groupBy("table_name").agg(*[F.sum(c).cast("long" if c == "row_cnt" else "decimal(38,0)").alias(c) for c in FIGURES])


def idempotency_check(before: DataFrame, new: DataFrame, dates: list[str]) -> DataFrame:
    """One row a table: figures before, after a rerun of ``dates``, rewritten and changed partitions, and the verdict.

    ``before`` has the fingerprints of all partitions, ``new`` those of the rewritten ones. After = before - old + new;
    a change that adds up to nothing in the totals still shows as changed partitions, and fails.
    """
    old = before.where(F.col("dt").isin(dates))
    either = old.select("table_name", "dt", *[F.col(c).alias(f"_o_{c}") for c in FIGURES]).join(new.select("table_name", "dt", *[F.col(c).alias(f"_n_{c}") for c in FIGURES]), ["table_name", "dt"], "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in FIGURES])
    moved = either.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("rewritten_cnt"), F.count_if(~same).alias("changed_cnt"),
        *[F.sum(F.coalesce(F.col(f"_n_{c}"), F.lit(0)) - F.coalesce(F.col(f"_o_{c}"), F.lit(0))).alias(f"_d_{c}") for c in FIGURES],
    )
    kind = {"row_cnt": "long"}
    after = [(F.col(c) + F.coalesce(F.col(f"_d_{c}"), F.lit(0))).cast(kind.get(c, "decimal(38,0)")).alias(f"{c}_after") for c in FIGURES]
    rows = totals(before).join(moved, "table_name", "full_outer")
    rows = rows.select("table_name", *[F.coalesce(F.col(c), F.lit(0)).cast(kind.get(c, "decimal(38,0)")).alias(c) for c in FIGURES], *[f"_d_{c}" for c in FIGURES], F.coalesce("rewritten_cnt", F.lit(0)).alias("rewritten_cnt"), F.coalesce("changed_cnt", F.lit(0)).alias("changed_cnt"))
    return rows.select("table_name", *[F.col(c).alias(f"{c}_before") for c in FIGURES], *after, "rewritten_cnt", "changed_cnt", F.when(F.col("changed_cnt") == 0, "PASS").otherwise("FAIL").alias("check_result"))
