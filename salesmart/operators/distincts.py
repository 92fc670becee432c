"""Distinct counts that add up: a bitmap of dictionary numbers for each day, combined for any span without the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .analytics import KIND, money
from .ordered import dense_numbers
from ..functions.parsing import ratio


def orders(c: DataFrame) -> DataFrame:
    """dt, invoice, customerid, amount: lines summed by order and day, which have the lines' values, days and sums in fewer rows."""
    return c.groupBy("dt", "invoice", "customerid").agg(F.sum("amount").alias("amount"))


def _first_days(c: DataFrame, column: str) -> DataFrame:
    return c.select(F.col(column).alias("value"), F.col("dt").try_cast("date").alias("day")).where("value is not null").groupBy("value").agg(F.min("day").alias("first"))


def dictionary(c: DataFrame, column: str) -> DataFrame:
    """Every value of the column with its number, from 1: value, number. Dense numbers fill few bitmaps, and numbers by first days few a day."""
    return dense_numbers(_first_days(c, column), ["first", "value"], "number").drop("first")


def extended(known: DataFrame, c: DataFrame, column: str) -> DataFrame:
    """A dictionary with the values of ``c`` that it lacks numbered after its own; numbers given before stay."""
    new = _first_days(c, column).join(known, "value", "left_anti")
    top = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
    return known.unionByName(dense_numbers(new, ["first", "value"], "number").crossJoin(F.broadcast(top)).select("value", (F.col("number") + F.col("top")).alias("number")))


def daily_bitmaps(c: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """kind, dt, bucket, bits: for each column with a dictionary the set of its values on each day, 32,768 numbers a bitmap.

    Numbers meet before a bitmap is made of them, so that no bitmap of a few numbers is moved; a bitmap has 32,768 rows at most.
    """
    out = None
    for column, numbers in sorted(dictionaries.items()):
        seen = c.select("dt", F.col(column).alias("value")).distinct().join(numbers, "value")
        seen = seen.select("dt", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("place")).repartition("dt", "bucket")
        bits = seen.groupBy("dt", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits = bits.select(F.lit(column).alias("kind"), "dt", "bucket", "bits")
        out = bits if out is None else out.unionByName(bits)
    return out


def daily_sums(c: DataFrame) -> DataFrame:
    return c.groupBy("dt").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))


def distinct_counts(bitmaps: DataFrame, span) -> DataFrame:
    """span, kind, n: how many different values a span of days has. ``span`` is a column of dt."""
    spans = bitmaps.groupBy(span.alias("span"), "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return spans.groupBy("span", "kind").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def monthly_trend(bitmaps: DataFrame, sums: DataFrame) -> DataFrame:
    """``monthly_sales_trend`` from stored days."""
    month = F.substring("dt", 1, 7)
    n = distinct_counts(bitmaps, month).groupBy("span").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("invoice", "customerid")])
    s = sums.groupBy(month.alias("span")).agg(money("amount", KIND).alias("monthly_sales"))
    return s.join(n, "span").select(F.col("span").alias("month"), "monthly_sales", F.coalesce("invoice", F.lit(0)).cast("long").alias("monthly_orders"), F.coalesce("customerid", F.lit(0)).cast("long").alias("monthly_customers"))


def alltime_summary(bitmaps: DataFrame, sums: DataFrame) -> DataFrame:
    """``kpi_summary`` from stored days; every span is one key, its buckets are many."""
    n = distinct_counts(bitmaps, F.lit("all")).agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in ("invoice", "customerid")])
    row = sums.agg(F.sum("amount").cast(KIND).alias("total_sales")).crossJoin(F.broadcast(n))
    return row.select("total_sales", F.col("invoice").alias("total_orders"), F.col("customerid").alias("total_customers"), ratio(F.col("total_sales"), F.col("invoice")).alias("avg_order_value"), ratio(F.col("total_sales"), F.col("customerid")).alias("avg_customer_value"))
