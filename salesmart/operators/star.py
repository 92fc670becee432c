"""Star schema: customer versions over time, dimensions, and the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.parsing import blank, packed, unpacked
from ..sources import sinks
from .marts import latest_description
from .ordered import asof_merge

OPEN_END = "9999-12-31"
#: What tells lines apart, and all that the star schema's keys need of a line.
SAME = ("invoice", "customerid", "country", "stockcode", "dt", "quantity", "amount")
LINE = (*SAME, "invoicedate")


def daily_customer_country(dwd: DataFrame) -> DataFrame:
    """Country of each customer's latest line of a day; equal times take the lowest country.

    Lines are combined by country before the shuffle, so the window runs over a customer's few countries.
    """
    last = dwd.groupBy("dt", "customerid", "country").agg(F.max("invoicedate").alias("_last"))
    w = Window.partitionBy("dt", "customerid").orderBy(F.desc("_last"), "country")
    return last.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("dt", "customerid", "country")


def version_key(customer, country, start) -> F.Column:
    return F.md5(F.concat_ws("|", customer, country, start))


def scd2_history(daily: DataFrame) -> DataFrame:
    """All versions of each customer in one pass: a version opens where the country differs from the day before it.

    A version ends the day before the next opens. Its key depends only on customer, country and first
    day, so the history of a whole range equals day-by-day processing.
    """
    w = Window.partitionBy("customerid").orderBy("dt")
    opened = daily.withColumn("_prev", F.lag("country").over(w)).where(~F.col("country").eqNullSafe(F.col("_prev")))
    nxt = F.lead("dt").over(w)
    return opened.withColumn("_next", nxt).select(
        version_key("customerid", "country", "dt").alias("user_id"), "customerid", "country", F.to_date("dt").alias("start_date"),
        F.coalesce(F.date_sub(F.to_date("_next"), 1), F.to_date(F.lit(OPEN_END))).alias("end_date"), F.col("_next").isNull().alias("is_current"),
    )


def scd2_snapshot(history: DataFrame, dt: str) -> DataFrame:
    """The history as known on a day: later versions are absent and the one they close is open."""
    day = F.to_date(F.lit(dt))
    later = F.col("end_date") >= day
    return history.where(F.col("start_date") <= day).select(
        "user_id", "customerid", "country", "start_date", F.when(later, F.to_date(F.lit(OPEN_END))).otherwise(F.col("end_date")).alias("end_date"), later.alias("is_current"), F.lit(dt).alias("dt"),
    )


def scd2_append_guard(snapshot_dates: DataFrame, dwd_dates: DataFrame, bizdate: str) -> DataFrame:
    """One row: may the snapshot of ``bizdate`` be appended? bizdate, max_snapshot_dt, next_dwd_dt, guard_status."""
    top = snapshot_dates.agg(F.max("dt").alias("max_snapshot_dt"))
    nxt = dwd_dates.select("dt").crossJoin(F.broadcast(top)).where("dt > max_snapshot_dt").agg(F.min("dt").alias("next_dwd_dt"))
    status = (
        F.when(F.col("max_snapshot_dt").isNull(), "INITIAL_LOAD").when(F.col("bizdate") <= F.col("max_snapshot_dt"), "BLOCK_HISTORY_OVERWRITE")
        .when(F.col("next_dwd_dt").isNull(), "BLOCK_NO_NEXT_DWD_DT").when(F.col("bizdate") == F.col("next_dwd_dt"), "ALLOW").otherwise("BLOCK_GAP")
    )
    return top.crossJoin(nxt).withColumn("bizdate", F.lit(bizdate)).select("bizdate", "max_snapshot_dt", "next_dwd_dt", status.alias("guard_status"))


def star_partition_state(tables: dict[str, DataFrame], dwd_dates: DataFrame, start_dt: str) -> DataFrame:
    """One row: empty_tables, min_dt, max_dt, first_dwd_dt, state of the star tables before a range load from ``start_dt``."""
    tops = None
    for name, t in sorted(tables.items()):
        one = t.agg(F.max("dt").alias("m")).withColumn("t", F.lit(name))
        tops = one if tops is None else tops.unionByName(one)
    facts = tops.agg(F.count_if(F.col("m").isNull()).alias("empty_tables"), F.min("m").alias("min_dt"), F.max("m").alias("max_dt"))
    n = len(tables)
    first = dwd_dates.agg(F.min("dt").alias("first_dwd_dt"))
    state = (
        F.when((F.col("empty_tables") == n) & (F.col("first_dwd_dt") == start_dt), "INITIAL").when(F.col("empty_tables") == n, "BLOCK_INITIAL_START")
        .when(F.col("empty_tables") > 0, "BLOCK_PARTIAL_DATE").when(F.col("min_dt") == F.col("max_dt"), "APPEND").otherwise("BLOCK_PARTITION_MISMATCH")
    )
    return facts.crossJoin(first).select("empty_tables", "min_dt", "max_dt", "first_dwd_dt", state.alias("state"))


def dim_product(dwd: DataFrame) -> DataFrame:
    """Each day's products with their description."""
    return latest_description(dwd.select("dt", "stockcode", "description", "invoicedate"), "dt", "stockcode").select(F.md5("stockcode").alias("product_id"), "stockcode", "description", "dt")


def dim_geo(dwd: DataFrame) -> DataFrame:
    return dwd.where(~blank("country")).select("country", "dt").distinct().select(F.md5("country").alias("geo_id"), "country", "dt")


def dim_date(dwd: DataFrame) -> DataFrame:
    """One row a business date; weeks are ISO weeks."""
    d = F.col("date_id")
    return dwd.select("dt").distinct().withColumn("date_id", F.to_date("dt")).select(
        "date_id", F.col("dt").alias("date_str"), F.year(d).alias("year_num"), F.month(d).alias("month_num"), F.dayofmonth(d).alias("day_num"),
        F.quarter(d).alias("quarter_num"), F.weekofyear(d).alias("weekofyear_num"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), "dt",
    )


def fact_order(dwd: DataFrame, history: DataFrame, product: DataFrame, date: DataFrame, geo: DataFrame, asof: bool = False, by_date: bool = False) -> DataFrame:
    """One row a sale line with its keys; identical lines are told apart by their number.

    The customer version is the one valid on the line's day: an equi-join on the customer with a range
    condition on the dates. With ``asof`` customers' days and versions are merged in order of time instead, for customers
    with very many versions or lines, and lines meet their day; versions must not overlap. Lines move to their versions, and then once to the
    products of their day, where identical ones are numbered too. With ``by_date`` they go to their date as a whole
    instead, for a table that is written by dates: the facts then needn't be moved again.
    """
    same = list(SAME)
    b = dwd.select(*same).withColumn("_day", F.to_date("dt"))
    h = history.select("customerid", "user_id", "start_date", "end_date")
    if asof:
        keyed = _keyed(b.select("customerid", "_day").distinct(), history, asof)
        f = b.join(keyed, ["customerid", "_day"]).withColumn("user_id", unpacked("_user")).drop("_user")
    else:
        f = b.join(h, (b["customerid"] == h["customerid"]) & (b["_day"] >= h["start_date"]) & (b["_day"] <= h["end_date"])).drop(h["customerid"])
    f = sinks.to_dates(f) if by_date else f.repartition("dt", "stockcode")
    # identical lines have the same versions, so that numbering them a version gives each line its number
    f = f.withColumn("_seq", F.row_number().over(Window.partitionBy(*same, "user_id").orderBy(F.lit(1))))
    f = f.join(product.select("dt", "stockcode", "product_id"), ["dt", "stockcode"]).join(geo.select("dt", "country", "geo_id"), ["dt", "country"]).join(date.select("dt", "date_id"), "dt")
    return _facts(f)


def _keyed(days: DataFrame, history: DataFrame, asof: bool) -> DataFrame:
    """Customers' ``days`` (customerid, _day) that have a valid version, with its key as bytes in _user."""
    h = history.select("customerid", "start_date", "end_date", packed("user_id").alias("_user"))
    if asof:
        return asof_merge(days, h, "customerid", "_day", "start_date", ["_user", "end_date"]).where("_day <= end_date").drop("end_date")
    h = h.withColumnRenamed("customerid", "_c")
    return days.join(h, (F.col("customerid") == F.col("_c")) & F.col("_day").between(F.col("start_date"), F.col("end_date"))).select(*days.columns, "_user")


def dated_facts(lines: DataFrame, history: DataFrame, asof: bool = False) -> DataFrame:
    """``fact_order`` of lines with the products, countries and dates of these very lines, for a table that is written by dates.

    Those dimensions' keys follow from a line itself. Customers' days meet the versions instead of their lines and bring
    back their key as bytes, so that lines move to their date alone; those that ``sinks.dealt_by_date`` stored don't move.
    """
    b = sinks.to_dates(lines.select(*SAME)).where(F.col("stockcode").isNotNull() & ~blank("country") & F.to_date("dt").isNotNull())
    days = b.select("customerid", "dt").distinct().withColumn("_day", F.to_date("dt"))
    f = b.join(sinks.to_dates(_keyed(days, history, asof).select("customerid", "dt", "_user")), ["customerid", "dt"])
    f = f.withColumn("_seq", F.row_number().over(Window.partitionBy(*SAME, "_user").orderBy(F.lit(1)))).withColumn("_day", F.to_date("dt"))
    return _facts(f.select("*", unpacked("_user").alias("user_id"), F.md5("stockcode").alias("product_id"), F.col("_day").alias("date_id"), F.md5("country").alias("geo_id")))


def _facts(f: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return f.select(
        F.md5(F.concat_ws("|", *[text(c) for c in ("invoice", "customerid", "country", "stockcode", "_day", "quantity", "amount", "_seq")])).alias("order_line_id"),
        F.col("invoice").alias("order_id"), "user_id", "product_id", "date_id", "geo_id", "quantity", "amount", "dt",
    )
