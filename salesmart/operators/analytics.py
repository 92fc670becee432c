"""All-time analytics over first-generation clean lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.parsing import ratio
from ..sources.sinks import stored
from .marts import HIGH, level, money

KIND = "decimal(18,2)"


def _month() -> Column:
    return F.substring("dt", 1, 7).alias("month")


def kpi_summary(c: DataFrame) -> DataFrame:
    g = c.agg(F.sum("amount").alias("_s"), F.count_distinct("invoice").alias("total_orders"), F.count_distinct("customerid").alias("total_customers"))
    return g.select(F.col("_s").cast(KIND).alias("total_sales"), "total_orders", "total_customers", ratio(F.col("_s"), F.col("total_orders")).alias("avg_order_value"), ratio(F.col("_s"), F.col("total_customers")).alias("avg_customer_value"))


def top(df: DataFrame, value: str, *keys: str, n: int = 10) -> DataFrame:
    """The ``n`` rows greatest in ``value``; ties by key."""
    return df.orderBy(F.desc(value), *keys).limit(n)


def _products(c: DataFrame, value: Column) -> DataFrame:
    return c.groupBy("stockcode", "description").agg(value.alias("total"))


def top_products_by_sales(c: DataFrame, n: int = 10) -> DataFrame:
    return top(_products(c, money("amount", KIND)), "total", "stockcode", "description", n=n)


def top_products_by_quantity(c: DataFrame, n: int = 10) -> DataFrame:
    return top(_products(c, F.sum("quantity")), "total", "stockcode", "description", n=n)


def top_products_by_avg_price(c: DataFrame, n: int = 10) -> DataFrame:
    return top(_products(c, ratio(F.sum("price"), F.count("price"))), "total", "stockcode", "description", n=n)


def customer_order_stats(c: DataFrame) -> DataFrame:
    return c.groupBy("customerid").agg(F.count_distinct("invoice").alias("order_count"), money("amount", KIND).alias("total_spent"))


def top_customers_by_spend(c: DataFrame, n: int = 10) -> DataFrame:
    return top(customer_order_stats(c).drop("order_count"), "total_spent", "customerid", n=n)


def top_customers_by_orders(c: DataFrame, n: int = 10) -> DataFrame:
    return top(customer_order_stats(c).drop("total_spent"), "order_count", "customerid", n=n)


def top_customers_by_avg_order(c: DataFrame, n: int = 10) -> DataFrame:
    s = customer_order_stats(c)
    return top(s.select("customerid", ratio(F.col("total_spent"), F.col("order_count")).alias("avg_order_value")), "avg_order_value", "customerid", n=n)


def country_sales(c: DataFrame) -> DataFrame:
    return c.groupBy("country").agg(money("amount", KIND).alias("total_sales")).orderBy(F.desc("total_sales"), "country")


def country_customers(c: DataFrame) -> DataFrame:
    return c.groupBy("country").agg(F.count_distinct("customerid").alias("customer_cnt")).orderBy(F.desc("customer_cnt"), "country")


def monthly_sales_trend(c: DataFrame) -> DataFrame:
    return c.groupBy(_month()).agg(money("amount", KIND).alias("monthly_sales"), F.count_distinct("invoice").alias("monthly_orders"), F.count_distinct("customerid").alias("monthly_customers"))


def monthly_sales(c: DataFrame) -> DataFrame:
    return c.groupBy(_month()).agg(money("amount", KIND).alias("monthly_sales")).orderBy("month")


def monthly_orders(c: DataFrame) -> DataFrame:
    return c.groupBy(_month()).agg(F.count_distinct("invoice").alias("monthly_orders")).orderBy("month")


def global_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """RANK by ``value`` descending over all rows, without one task holding them.

    Rows are counted by value; values are ranged over tasks, ranks run inside a range, and each range
    starts after the rows of the ranges before it. The ranges are stored, so that a task run again can't
    number them anew.
    """
    counts = stored(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(F.desc(value)).withColumn("_range", F.spark_partition_id()))
    sums = counts.groupBy("_range").agg(F.sum("_n").alias("_m"))
    before = sums.select("_range", F.coalesce(F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_own", own).join(F.broadcast(before), "_range").select(value, (F.col("_own") + F.col("_from") + 1).cast("long").alias(name))
    return df.join(ranks, value)


def customer_rank(c: DataFrame) -> DataFrame:
    """Customers ranked by spending."""
    spent = c.groupBy("customerid").agg(money("amount", KIND).alias("total_spent"))
    return global_rank(spent, "total_spent", "spend_rank").select("customerid", "total_spent", "spend_rank")


def top_customer_per_country(c: DataFrame) -> DataFrame:
    g = c.groupBy("country", "customerid").agg(money("amount", KIND).alias("total_spent"))
    w = Window.partitionBy("country").orderBy(F.desc("total_spent"), "customerid")
    return g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def customer_cumulative_spend(c: DataFrame) -> DataFrame:
    """Running spending of each customer by time; lines of one time share a value (a RANGE frame)."""
    w = Window.partitionBy("customerid").orderBy("invoicedate")
    return c.select("customerid", "invoice", "stockcode", "invoicedate", "amount", F.sum("amount").over(w).cast(KIND).alias("cumulative_spent"))


def repeat_purchase_summary(c: DataFrame) -> DataFrame:
    g = customer_order_stats(c).agg(F.count(F.lit(1)).alias("total_customers"), F.count_if(F.col("order_count") > 1).alias("repeat_customers"))
    return g.withColumn("repeat_rate_pct", ratio(F.col("repeat_customers"), F.col("total_customers"), 100))


def monthly_growth(c: DataFrame) -> DataFrame:
    """Sales of each month against the month before it that has sales; the window runs over months."""
    m = monthly_sales_trend(c).select("month", "monthly_sales").withColumn("prev_month_sales", F.lag("monthly_sales").over(Window.orderBy("month")))
    diff = F.col("monthly_sales") - F.col("prev_month_sales")
    return m.select("month", "monthly_sales", "prev_month_sales", diff.cast(KIND).alias("growth_amt"), ratio(diff, F.col("prev_month_sales"), 100).alias("growth_rate_pct"))


def customer_value_alltime(c: DataFrame) -> DataFrame:
    g = c.groupBy("customerid").agg(F.count_distinct("invoice").alias("order_count"), F.sum("amount").alias("_s"))
    return g.select("customerid", "order_count", F.col("_s").cast(KIND).alias("total_spent"), level(F.col("_s")).alias("customer_level"))


def sales_summary_alltime(c: DataFrame) -> DataFrame:
    g = c.groupBy("country").agg(F.count_distinct("invoice").alias("total_orders"), F.count_distinct("customerid").alias("total_customers"), F.sum("amount").alias("_s"))
    return g.select("country", "total_orders", "total_customers", F.col("_s").cast(KIND).alias("total_sales"), ratio(F.col("_s"), F.col("total_orders")).alias("avg_order_value"))


def customer_level_counts(c: DataFrame) -> DataFrame:
    return customer_value_alltime(c).groupBy("customer_level").agg(F.count(F.lit(1)).alias("customer_cnt")).orderBy(F.desc("customer_cnt"), "customer_level")


def monthly_top3_countries(c: DataFrame) -> DataFrame:
    g = c.groupBy(_month(), "country").agg(money("amount", KIND).alias("total_sales"))
    w = Window.partitionBy("month").orderBy(F.desc("total_sales"), "country")
    return g.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3")


def country_rank_alltime(c: DataFrame) -> DataFrame:
    """Countries by sales; the window runs over one row a country."""
    return sales_summary_alltime(c).drop("avg_order_value").withColumn("sales_rank", F.rank().over(Window.orderBy(F.desc("total_sales"))).cast("long"))


def high_value_customers(c: DataFrame) -> DataFrame:
    return customer_value_alltime(c).where(F.col("customer_level") == HIGH).orderBy(F.desc("total_spent"), "customerid")


def top10_products(c: DataFrame, n: int = 10) -> DataFrame:
    g = c.groupBy("stockcode", "description").agg(F.sum("quantity").alias("total_qty"), money("amount", KIND).alias("total_sales"))
    return top(g, "total_sales", "stockcode", "description", n=n)


def concentration(c: DataFrame, keys: list[str], name: str, counted: str, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Sales of the top k groups for each k, and their share of all sales.

    Only the largest k is taken from the sorted groups; numbering runs over those rows.
    """
    g = c.groupBy(*keys).agg(F.sum("amount").alias("_s"))
    best = g.orderBy(F.desc("_s"), *keys).limit(max(ks))
    best = best.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("_s"), *keys)))
    rows = best.select("_s", F.explode(F.array(*[F.when(F.col("_rn") <= k, F.lit(k)) for k in ks])).alias("_k")).where("_k is not null")
    rows = rows.groupBy("_k").agg(F.count(F.lit(1)).alias(counted), F.sum("_s").alias("_g"))
    total = c.agg(F.sum("amount").alias("_t"))
    return rows.crossJoin(F.broadcast(total)).select(F.concat(F.lit("TOP"), F.col("_k")).alias(name), counted, F.col("_g").cast(KIND).alias("group_sales"), ratio(F.col("_g"), F.col("_t"), 100).alias("sales_contribution_pct"))


def customer_revenue_concentration(c: DataFrame) -> DataFrame:
    return concentration(c, ["customerid"], "customer_group", "customer_count")


def product_sales_concentration(c: DataFrame) -> DataFrame:
    return concentration(c, ["stockcode", "description"], "product_group", "product_count")


def country_value_analysis(c: DataFrame) -> DataFrame:
    s = sales_summary_alltime(c)
    return s.select("*", ratio(F.col("total_sales"), F.col("total_customers")).alias("avg_customer_value"), ratio(F.col("total_orders"), F.col("total_customers")).alias("avg_orders_per_customer"))


def level_distribution_alltime(c: DataFrame) -> DataFrame:
    g = customer_value_alltime(c).groupBy("customer_level").agg(F.count(F.lit(1)).alias("customer_cnt"), F.sum("total_spent").alias("_s"))
    everything = Window.partitionBy()  # three rows
    return g.select("customer_level", "customer_cnt", F.col("_s").cast(KIND).alias("total_spent"), ratio(F.col("customer_cnt"), F.sum("customer_cnt").over(everything), 100).alias("customer_cnt_pct"), ratio(F.col("_s"), F.sum("_s").over(everything), 100).alias("sales_pct"))


def order_frequency(stats: DataFrame) -> DataFrame:
    """Customers by number of orders, from rows with order_count."""
    n = F.col("order_count")
    bucket = F.when(n == 1, "1_order").when(n <= 3, "2_3_orders").when(n <= 10, "4_10_orders").otherwise("10plus_orders")
    g = stats.groupBy(bucket.alias("order_frequency_level")).agg(F.count(F.lit(1)).alias("customer_cnt"))
    return g.withColumn("customer_pct", ratio(F.col("customer_cnt"), F.sum("customer_cnt").over(Window.partitionBy()), 100))


def high_value_order_frequency(c: DataFrame) -> DataFrame:
    return order_frequency(customer_value_alltime(c).where(F.col("customer_level") == HIGH))


def _high_lines(c: DataFrame) -> DataFrame:
    return c.join(customer_value_alltime(c).where(F.col("customer_level") == HIGH).select("customerid"), "customerid", "left_semi")


def high_value_preference_alltime(c: DataFrame, n: int = 20) -> DataFrame:
    g = _high_lines(c).groupBy("stockcode", "description").agg(F.count_distinct("customerid").alias("high_value_customer_cnt"), F.count_distinct("invoice").alias("high_value_order_cnt"), F.sum("quantity").alias("total_quantity"), money("amount", KIND).alias("total_sales"))
    return g.orderBy(F.desc("high_value_customer_cnt"), F.desc("total_sales"), "stockcode", "description").limit(n)


def high_value_country_distribution(c: DataFrame) -> DataFrame:
    g = _high_lines(c).groupBy("country").agg(F.count_distinct("customerid").alias("high_value_customer_cnt"), F.count_distinct("invoice").alias("high_value_order_cnt"), money("amount", KIND).alias("total_sales"))
    return g.select("*", ratio(F.col("total_sales"), F.col("high_value_customer_cnt")).alias("avg_sales_per_customer"), ratio(F.col("high_value_order_cnt"), F.col("high_value_customer_cnt")).alias("avg_orders_per_customer"))


def high_value_contribution_alltime(c: DataFrame) -> DataFrame:
    high = customer_value_alltime(c).where(F.col("customer_level") == HIGH).select("customerid", F.lit(True).alias("_high"))
    mine = lambda x: F.when(F.col("_high"), F.col(x))
    g = c.join(high, "customerid", "left").agg(F.count_distinct(mine("customerid")).alias("high_value_customer_cnt"), F.count_distinct(mine("invoice")).alias("high_value_order_cnt"), F.coalesce(F.sum(mine("amount")), F.lit(0)).alias("_h"), F.sum("amount").alias("_s"))
    return g.select("high_value_customer_cnt", "high_value_order_cnt", F.col("_h").cast(KIND).alias("high_value_total_sales"), F.col("_s").cast(KIND).alias("total_sales"), ratio(F.col("_h"), F.col("_s"), 100).alias("sales_contribution_pct"),
                    ratio(F.col("_h"), F.col("high_value_customer_cnt")).alias("avg_sales_per_customer"), ratio(F.col("high_value_order_cnt"), F.col("high_value_customer_cnt")).alias("avg_orders_per_customer"))
