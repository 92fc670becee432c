"""Serving table: guarded upsert and the read queries of a dashboard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.parsing import ratio

#: Most days, both ends included, that one trend query may span.
TREND_DAYS = 31


def upsert_conflicts(target: DataFrame, incoming: DataFrame, source_system: str) -> DataFrame:
    """Dates of ``incoming`` that ``target`` holds under another source."""
    other = target.where(~F.col("source_system").eqNullSafe(F.lit(source_system))).select("dt")
    return incoming.select("dt").distinct().join(other, "dt", "left_semi")


def serving_upsert(target: DataFrame, incoming: DataFrame, source_system: str) -> DataFrame:
    """``target`` with the rows of ``incoming`` inserted or put in the place of theirs, by dt.

    Raises ValueError without a source, and for the whole batch if any of its dates is held under another.
    """
    if not source_system:
        raise ValueError("source_system must be given")
    if not upsert_conflicts(target, incoming, source_system).isEmpty():
        raise ValueError(f"dates of the batch belong to a source other than {source_system}")
    new = incoming.withColumn("source_system", F.lit(source_system)).select(*target.columns)
    return target.join(new.select("dt"), "dt", "left_anti").select(*target.columns).unionByName(new)


def overview_by_date(serving: DataFrame, dt: str) -> DataFrame:
    return serving.where(F.col("dt") == dt)


def overview_trend(serving: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, ascending; at most 31 days."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    if not 1 <= days <= TREND_DAYS:
        raise ValueError(f"a trend spans 1 to {TREND_DAYS} days, not {days}")
    return serving.where(F.col("dt").between(start, end)).orderBy("dt")


def overview_comparison(serving: DataFrame) -> DataFrame:
    """Every day against the one before it of the same source: five changes in per cent, null where it was 0."""
    w = Window.partitionBy("source_system").orderBy("dt")
    names = {"total_sales": "sales", "total_orders": "orders", "total_customers": "customers", "total_quantity": "quantity", "avg_order_value": "aov"}
    b = serving.select("dt", "source_system", *names, F.lag("dt").over(w).alias("prev_dt"), *[F.lag(c).over(w).alias(f"_{n}") for c, n in names.items()])
    return b.select("dt", "source_system", "prev_dt", F.col("prev_dt").isNotNull().alias("available"),
                    *[ratio(F.col(c) - F.col(f"_{n}"), F.col(f"_{n}"), 100).alias(f"{n}_change_pct") for c, n in names.items()])


def anomaly_list(serving: DataFrame, source_system: str, start: str, end: str) -> DataFrame:
    """Medium and high anomalies of one source, ascending."""
    return serving.where(F.col("anomaly_level").isin("MEDIUM", "HIGH") & (F.col("source_system") == source_system) & F.col("dt").between(start, end)).orderBy("dt")
