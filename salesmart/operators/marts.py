"""Daily marts over clean sale lines. All take a whole range of dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.parsing import blank, ratio

# Level names and default thresholds.
HIGH, MEDIUM, LOW = "High Value", "Medium Value", "Low Value"
LEVELS = (5000, 1000)
ANOMALY = {"high_pct": -50, "high_loss": 30000, "any_pct": -40, "medium_pct": -40, "medium_loss": 20000}


def level(total: Column, levels: tuple[int, int] = LEVELS) -> Column:
    return F.when(total >= levels[0], HIGH).when(total >= levels[1], MEDIUM).otherwise(LOW)


def money(c: Column | str, kind: str = "decimal(14,2)") -> Column:
    return F.round(F.sum(c), 2).cast(kind)


def dws_customer_value(dwd: DataFrame, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """Orders, spending and value level of each customer and day."""
    g = dwd.groupBy("dt", "customerid").agg(F.count_distinct("invoice").alias("order_count"), F.sum("amount").alias("_s"))
    return g.select("customerid", "order_count", F.col("_s").cast("decimal(12,2)").alias("total_spent"), level(F.col("_s"), levels).alias("customer_level"), "dt")


def dws_sales_summary(dwd: DataFrame, salts: int = 0) -> DataFrame:
    """Orders, customers and sales of each country and day.

    With ``salts``, sums and distincts run in two steps: by country and a hash of the invoice (customer),
    then by country. Rows of one invoice share a salt, so distinct counts add up; the result is the same.
    """
    if not salts:
        g = dwd.groupBy("dt", "country").agg(F.count_distinct("invoice").alias("total_orders"), F.count_distinct("customerid").alias("total_customers"), F.sum("amount").alias("_s"))
    else:
        by = lambda c: F.pmod(F.crc32(c), F.lit(salts))
        orders = dwd.groupBy("dt", "country", by("invoice").alias("_salt")).agg(F.count_distinct("invoice").alias("_o"), F.sum("amount").alias("_s"))
        orders = orders.groupBy("dt", "country").agg(F.sum("_o").alias("total_orders"), F.sum("_s").alias("_s"))
        people = dwd.groupBy("dt", "country", by("customerid").alias("_salt")).agg(F.count_distinct("customerid").alias("_c"))
        g = orders.join(people.groupBy("dt", "country").agg(F.sum("_c").alias("total_customers")), ["dt", "country"])
    return g.select("country", "total_orders", "total_customers", F.col("_s").cast("decimal(14,2)").alias("total_sales"),
                    F.coalesce(ratio(F.col("_s"), F.col("total_orders"), kind="decimal(14,2)"), F.lit(0).cast("decimal(14,2)")).alias("avg_order_value"), "dt")


def marked_lines(dwd: DataFrame, customer_value: DataFrame) -> DataFrame:
    """``dwd`` with is_high: whether the customer is of high value on the day. Stored, it serves both marts below."""
    high = customer_value.where(F.col("customer_level") == HIGH).select("dt", "customerid", F.lit(True).alias("_high"))
    return dwd.join(high, ["dt", "customerid"], "left").select(*dwd.columns, F.col("_high").isNotNull().alias("is_high"))


def ads_high_value_contribution(dwd: DataFrame, customer_value: DataFrame) -> DataFrame:
    """Share of high-value customers in each day's sales; days without any keep a row of zeros."""
    return contribution_of(marked_lines(dwd, customer_value))


def contribution_of(lines: DataFrame) -> DataFrame:
    """``ads_high_value_contribution`` from marked lines."""
    mine = lambda c: F.when(F.col("is_high"), F.col(c))
    g = lines.groupBy("dt").agg(
        F.count_distinct(mine("customerid")).alias("high_value_customer_cnt"), F.count_distinct(mine("invoice")).alias("high_value_order_cnt"),
        F.coalesce(F.sum(mine("amount")), F.lit(0)).alias("_h"), F.sum("amount").alias("_s"),
    )
    return _contribution(g)


def _contribution(g: DataFrame) -> DataFrame:
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return g.select(
        "high_value_customer_cnt", "high_value_order_cnt", F.col("_h").cast("decimal(14,2)").alias("high_value_total_sales"), F.col("_s").cast("decimal(14,2)").alias("total_sales"),
        zero(ratio(F.col("_h"), F.col("_s"), 100), "decimal(10,2)").alias("sales_contribution_pct"),
        zero(ratio(F.col("_h"), F.col("high_value_customer_cnt")), "decimal(14,2)").alias("avg_sales_per_customer"),
        zero(ratio(F.col("high_value_order_cnt"), F.col("high_value_customer_cnt")), "decimal(10,2)").alias("avg_orders_per_customer"), "dt",
    )


def contribution_by_value(dwd: DataFrame, customer_value: DataFrame) -> DataFrame:
    """``ads_high_value_contribution`` where the customers' values are those of all these lines: sums come from the values.

    Lines meet the high-value customers for their orders alone; Catalyst drops that join where the orders aren't read.
    """
    high = customer_value.where(F.col("customer_level") == HIGH)
    people = high.groupBy("dt").agg(F.count(F.lit(1)).alias("_c"), F.sum("total_spent").alias("_h"))
    orders = dwd.join(high.select("dt", "customerid"), ["dt", "customerid"], "left_semi").groupBy("dt").agg(F.count_distinct("invoice").alias("_o"))
    g = dwd.groupBy("dt").agg(F.sum("amount").alias("_s")).join(people, "dt", "left").join(orders, "dt", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return _contribution(g.select("dt", count("_c").alias("high_value_customer_cnt"), count("_o").alias("high_value_order_cnt"), F.coalesce("_h", F.lit(0)).alias("_h"), "_s"))


def ads_level_distribution(customer_value: DataFrame) -> DataFrame:
    """Customers and spending of each level and day, with shares of the day."""
    g = customer_value.groupBy("dt", "customer_level").agg(F.count(F.lit(1)).alias("customer_cnt"), F.sum("total_spent").alias("_s"))
    day = Window.partitionBy("dt")
    return g.select(
        "customer_level", "customer_cnt", F.col("_s").cast("decimal(14,2)").alias("total_spent"),
        ratio(F.col("customer_cnt"), F.sum("customer_cnt").over(day), 100, "decimal(10,2)").alias("customer_cnt_pct"),
        ratio(F.col("_s"), F.sum("_s").over(day), 100, "decimal(10,2)").alias("sales_pct"), "dt",
    )


def ads_country_rank(summary: DataFrame) -> DataFrame:
    """Countries of each day by sales; ties share a rank."""
    rank = F.rank().over(Window.partitionBy("dt").orderBy(F.desc("total_sales"))).cast("long")
    return summary.select("country", rank.alias("sales_rank"), "total_orders", "total_customers", "total_sales", "avg_order_value", "dt")


def latest_description(lines: DataFrame, *keys: str) -> DataFrame:
    """One description a key: non-blank first, then the latest, then the greatest. Combined before the shuffle."""
    return lines.groupBy(*keys).agg(best_description().alias("description"))


def best_description() -> Column:
    """Of a group's descriptions the non-blank, latest, greatest one."""
    order = F.struct((~blank("description")).alias("a"), F.col("invoicedate").alias("b"), F.coalesce("description", F.lit("")).alias("c"))
    return F.max_by(F.struct("description"), order)["description"]


def ads_high_value_preference(dwd: DataFrame, customer_value: DataFrame) -> DataFrame:
    """What each day's high-value customers buy, ranked by sales."""
    high = customer_value.where(F.col("customer_level") == HIGH).select("dt", "customerid")
    return _preference(dwd.join(high, ["dt", "customerid"], "left_semi"))


def preference_of(lines: DataFrame) -> DataFrame:
    """``ads_high_value_preference`` from marked lines."""
    return _preference(lines.where("is_high"))


def _preference(lines: DataFrame) -> DataFrame:
    g = lines.groupBy("dt", "stockcode").agg(
        best_description().alias("description"), F.count_distinct("customerid").alias("high_value_customer_cnt"), F.count_distinct("invoice").alias("high_value_order_cnt"),
        F.sum("quantity").alias("total_quantity"), money("amount").alias("total_sales"),
    )
    return g.withColumn("sales_rank", F.rank().over(Window.partitionBy("dt").orderBy(F.desc("total_sales"))).cast("long"))


def ads_sales_overview(dwd: DataFrame) -> DataFrame:
    """The day's figures."""
    g = dwd.groupBy("dt").agg(F.sum("amount").alias("_s"), F.count_distinct("invoice").alias("total_orders"), F.count_distinct("customerid").alias("total_customers"), F.sum("quantity").alias("total_quantity"))
    return g.select(F.col("_s").cast("decimal(18,2)").alias("total_sales"), "total_orders", "total_customers", "total_quantity",
                    F.coalesce(ratio(F.col("_s"), F.col("total_orders")), F.lit(0)).cast("decimal(18,2)").alias("avg_order_value"), "dt")


def ads_sales_anomaly(overview: DataFrame, limits: dict = ANOMALY) -> DataFrame:
    """Each day against the one before it that has sales: changes, loss, level and driver.

    Levels and driver compare exact fractions by cross-multiplication; only the output is rounded. The
    window runs over one row a day.
    """
    w = Window.orderBy("dt")
    names = {"dt": "prev_dt", "total_sales": "prev_sales", "total_orders": "_po", "total_customers": "_pc", "total_quantity": "_pq"}
    b = overview.select("*", *[F.lag(c).over(w).alias(n) for c, n in names.items()])
    whole = lambda c, k=1: (F.col(c) * k).cast("decimal(38,0)")
    s, ps = whole("total_sales", 100), whole("prev_sales", 100)
    o, po = whole("total_orders"), whole("_po")
    # (difference, base) of each change
    parts = {
        "sales": (s - ps, ps), "orders": (o - po, po), "customers": (whole("total_customers") - whole("_pc"), whole("_pc")),
        "quantity": (whole("total_quantity") - whole("_pq"), whole("_pq")), "aov": (s * po - ps * o, o * ps),
    }
    parts = {k: (n.cast("decimal(38,0)"), d.cast("decimal(38,0)")) for k, (n, d) in parts.items()}
    pct = lambda k: F.when(parts[k][1] != 0, F.round((parts[k][0] * 100).cast("decimal(24,0)") / parts[k][1].cast("decimal(24,0)"), 2)).cast("decimal(18,2)")
    falls = lambda k, by: (parts[k][1] != 0) & (parts[k][0] * 100 <= parts[k][1] * by)
    loss = F.col("prev_sales") - F.col("total_sales")
    some = F.lit(False)
    for k in ("orders", "customers", "quantity", "aov"):
        some = some | F.coalesce(falls(k, limits["any_pct"]), F.lit(False))
    both = (po != 0) & (o * ps != 0)
    no, na = parts["orders"][0] * parts["aov"][1], parts["aov"][0] * po
    return b.select(
        "total_sales", "total_orders", "total_customers", "total_quantity", "avg_order_value", "prev_dt", "prev_sales",
        pct("sales").alias("sales_change_pct"), loss.cast("decimal(18,2)").alias("sales_loss_amount"),
        pct("orders").alias("orders_change_pct"), pct("customers").alias("customers_change_pct"), pct("quantity").alias("quantity_change_pct"), pct("aov").alias("aov_change_pct"),
        F.when(F.col("prev_dt").isNull(), "NOT_EVALUATED").when(falls("sales", limits["high_pct"]) & (loss >= limits["high_loss"]) & some, "HIGH")
        .when(falls("sales", limits["medium_pct"]) & (loss >= limits["medium_loss"]), "MEDIUM").otherwise("NORMAL").alias("anomaly_level"),
        F.when(both & (no <= na), "ORDERS").when(both & (na < no), "AVG_ORDER_VALUE").alias("primary_driver"), "dt",
    )


def dws_customer_value_star(fact: DataFrame, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """Orders, amount and level of each version of a customer and day."""
    g = fact.groupBy("dt", "user_id").agg(F.count_distinct("order_id").alias("total_orders"), F.sum("amount").alias("_s"))
    return g.select("user_id", "total_orders", F.col("_s").cast("decimal(14,2)").alias("total_amount"), level(F.col("_s"), levels).alias("customer_level"), "dt")


def bi_export_long(contribution: DataFrame, distribution: DataFrame, rank: DataFrame) -> DataFrame:
    """Three figures a day in long form: dt, metric_name, metric_value."""
    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.groupBy("dt").agg(F.coalesce(value, F.lit(0)).cast("decimal(18,2)").alias("metric_value")).select("dt", F.lit(name).alias("metric_name"), "metric_value")

    return one(contribution, "High Value Sales Contribution Pct", F.max("sales_contribution_pct")).unionByName(
        one(distribution, "Total Customer Count", F.sum("customer_cnt"))).unionByName(one(rank, "Total Sales", F.sum("total_sales")))
