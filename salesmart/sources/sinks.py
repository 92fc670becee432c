"""Partitioned Parquet sinks that replace what they are meant to replace and nothing else."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared checkpoint folder; a temporary one only on one machine, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='salesmart-')}"
    return f"{base.rstrip('/')}/layer-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table and read back, as a layer that others build on."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_dates(df: DataFrame) -> DataFrame:
    """``df`` dealt to a fixed number of tasks by dt: many small files are written side by side."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dt")


def dealt_by_date(df: DataFrame, *order: str) -> DataFrame:
    """``df`` stored as a table whose buckets are ``to_dates``' tasks, sorted by dt and ``order``, and read back.

    Whatever is grouped or joined by dt and more needn't be moved again. The table's files are in the shared folder.
    """
    spark = df.sparkSession
    path = scratch(spark)
    name = f"dated_{path.rsplit('-', 1)[-1]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to_dates(df).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "dt").sortBy("dt", *order).saveAsTable(name)
    return spark.table(name)


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partition_dates(spark: SparkSession, path: str) -> list[str]:
    """Partition dates of a dataset, from its folder names."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName()[3:] for s in fs.listStatus(p) if s.getPath().getName().startswith("dt="))


def _drop(spark: SparkSession, path: str, dt: str) -> None:
    fs, p = filesystem(spark, f"{path}/dt={dt}")
    fs.delete(p, True)


def overwrite_partition(df: DataFrame, path: str, dt: str) -> None:
    """Replace one date; an empty ``df`` empties it. ``df`` may carry dt or not."""
    df.drop("dt").write.mode("overwrite").parquet(f"{path}/dt={dt}")


def overwrite_dynamic(df: DataFrame, path: str) -> None:
    """Replace the dates that ``df`` has and leave the others.

    Rows are rebalanced by date: small dates share a task, so files stay few, and adaptive execution
    splits a large date over tasks.
    """
    df.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def overwrite_dates(df: DataFrame, path: str, dates: list[str]) -> None:
    """Replace the given dates by their rows of ``df``; dates without rows go, other dates keep their files.

    ``df`` may read from ``path``.
    """
    rows = stored(df.where(F.col("dt").isin(dates)))
    overwrite_dynamic(rows, path)
    have = {r["dt"] for r in rows.select("dt").distinct().collect()}  # one row a date
    for dt in partition_dates(df.sparkSession, path):
        if dt in dates and dt not in have:
            _drop(df.sparkSession, path, dt)


def _files(spark: SparkSession, path: str, dt: str) -> set[str]:
    fs, p = filesystem(spark, f"{path}/dt={dt}")
    return {s.getPath().getName() for s in fs.listStatus(p)}


def replace_dates(df: DataFrame, path: str, dates: list[str]) -> None:
    """``overwrite_dates`` where ``df`` doesn't read from ``path`` and a task has whole dates: rows are written once and not moved.

    A date whose files are still the old ones has no rows in ``df``, and goes.
    """
    spark = df.sparkSession
    old = {dt: _files(spark, path, dt) for dt in set(partition_dates(spark, path)) & set(dates)}
    df.where(F.col("dt").isin(dates)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("dt").parquet(path)
    for dt, names in old.items():
        if _files(spark, path, dt) == names:
            _drop(spark, path, dt)


def overwrite_range(df: DataFrame, path: str, start: str, end: str, amount: str | None = None) -> DataFrame:
    """Replace all dates from ``start`` to ``end``: dates that ``df`` lacks go.

    Returns one row comparing what was written with ``df`` (rows, dates, first and last date, sum of
    ``amount`` within 0.01) and raises if they differ. ``df`` must not read from ``path``.
    """
    spark = df.sparkSession
    df = stored(df.where(F.col("dt").between(start, end)))  # computed once, read for the facts, the write and the dates

    def facts(x: DataFrame):
        total = F.sum(F.col(amount).cast("decimal(38,2)")) if amount else F.lit(None).cast("decimal(38,2)")
        return x.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("dt").alias("date_count"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), total.alias("total"))

    want = facts(df).first()
    overwrite_dynamic(df, path)
    have = {r["dt"] for r in df.select("dt").distinct().collect()}  # one row a date
    for dt in partition_dates(spark, path):
        if start <= dt <= end and dt not in have:
            _drop(spark, path, dt)
    schema = df.schema
    out = spark.read.schema(schema).parquet(path).where(F.col("dt").between(start, end))
    checked = facts(out)
    got = checked.first()
    same = want[:4] == got[:4] and (want[4] is None or abs(want[4] - got[4]) <= 0.01)
    if not same:
        raise RuntimeError(f"{path}: wrote {got}, expected {want}")
    return checked
