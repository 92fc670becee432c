"""Hot keys found in one pass, and grouping that salts them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import ratio

#: Counters of a summary, and how many times the rows divided by them a key's count may be off.
COUNTERS, ERROR = 4096, 3.5


def heavy_hitters(df: DataFrame, key: Column, share: float, counters: int = COUNTERS) -> DataFrame:
    """Keys that may have more than ``share`` of the rows: key, row_cnt (an estimate), total.

    Summaries of the Misra-Gries family, with ``counters`` counters, are filled a task each and merged, so the
    table is read once and a task sends no more than its summary. Counts are within ERROR * total / counters of the
    true ones, and every key above the share comes back; at most half the counters' number of rows do.
    """
    if share * counters < 2 * ERROR:
        raise ValueError(f"a share of {share} takes {int(2 * ERROR / share) + 1} counters")
    one = df.select(key.cast("string").alias("k")).agg(F.expr(f"approx_top_k(k, {counters // 2}, {counters})").alias("top"), F.count(F.lit(1)).alias("total"))
    found = one.select(F.explode("top").alias("t"), "total").select(F.col("t.item").alias("key"), F.col("t.count").alias("row_cnt"), "total")
    return found.where(F.col("row_cnt") + F.col("total") * (ERROR / counters) > F.col("total") * share)


def salts_of(hitters: DataFrame, tasks: int) -> DataFrame:
    """key, salts: as many as the key's share of the rows is of ``tasks`` tasks, at least two."""
    return hitters.select("key", F.greatest(F.lit(2), F.ceil(F.col("row_cnt") * tasks / F.col("total"))).cast("int").alias("salts"))


def sales_summary_by_hitters(dwd: DataFrame, share: float = 0.05, tasks: int | None = None) -> DataFrame:
    """``dws_sales_summary`` with hot (dt, country) keys found and salted by their share; cold keys aren't split.

    A hot key's rows are dealt by a hash of the invoice for its orders, of the customer for its customers, so
    that distinct counts of the salts add up. The salts (one row a hot key, at most the summary's size) are
    broadcast.
    """
    spark = dwd.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("|", "dt", "country")
    salts = salts_of(heavy_hitters(dwd, key, share), tasks)
    lines = dwd.withColumn("_k", key).join(F.broadcast(salts), F.col("_k") == F.col("key"), "left").withColumn("_m", F.coalesce("salts", F.lit(1)))
    by = lambda c: F.pmod(F.crc32(c), F.col("_m"))
    orders = lines.groupBy("dt", "country", by("invoice").alias("_salt")).agg(F.count_distinct("invoice").alias("_o"), F.sum("amount").alias("_s"))
    orders = orders.groupBy("dt", "country").agg(F.sum("_o").alias("total_orders"), F.sum("_s").alias("_s"))
    people = lines.groupBy("dt", "country", by("customerid").alias("_salt")).agg(F.count_distinct("customerid").alias("_c"))
    g = orders.join(people.groupBy("dt", "country").agg(F.sum("_c").alias("total_customers")), ["dt", "country"])
    money = "decimal(14,2)"
    return g.select("country", "total_orders", "total_customers", F.col("_s").cast(money).alias("total_sales"), F.coalesce(ratio(F.col("_s"), F.col("total_orders"), kind=money), F.lit(0).cast(money)).alias("avg_order_value"), "dt")
