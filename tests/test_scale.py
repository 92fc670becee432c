"""Forms that keep what is moved and written in proportion to the tables."""

import random

from pyspark.sql import functions as F

from salesmart.functions import parsing as P
from salesmart.operators import analytics as A, distincts as B, star as S
from salesmart.plans import catalogue as C
from salesmart.sources import retail as R, sinks

SF = "/root/testdata/sf0.001"


def test_one_format_a_date_gives_what_all_four_give(spark):
    rng = random.Random(3)
    pieces = ["2011", "1", "01", "12", "31", "-", "/", ":", " ", "8", "08", "59", "x", ".", "+"]
    rows = [(None,), ("",), ("2011-12-09 08:26:00",), (" 9/12/2011 8:26",), ("09/12/2011 8:26:01",), ("2011-12-09 8:26",), ("31/2/2010 08:26",)]
    rows += [("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string")
    each = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in P.DATE_FORMATS])
    assert df.where(each.isNotNull()).count() >= 4
    assert df.where(~each.eqNullSafe(P.parse_invoice_ts("t"))).count() == 0
    used = df.select(P.parse_invoice_ts("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in used.lower()


def test_lines_move_to_their_order_and_part_alone(spark):
    """With no table small enough to broadcast, the lines are below two exchanges; customers meet the orders first."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.retail_from_orders(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [(line.index("SortMergeJoin"), line) for line in plan.splitlines() if "SortMergeJoin" in line]
    lines_at = next(i for i, line in enumerate(plan.splitlines()) if "l_orderkey" in line and "Scan" in line)
    above = [line for line in plan.splitlines()[:lines_at] if "SortMergeJoin" in line]
    assert len(joins) == 3 and len(above) == 2


def test_layers_write_no_csv_and_are_its_records(spark):
    t = C.Context(spark, SF)
    raw = t.raw
    assert "csv" not in t.__dict__
    assert raw.drop("batch_dt").exceptAll(t.csv).count() == t.csv.exceptAll(raw.drop("batch_dt")).count() == 0


def test_shuffles_follow_the_tables(spark):
    keys = ("spark.sql.shuffle.partitions", C._HASHED_KEY)
    old = [spark.conf.get(k) for k in keys]
    try:
        C.fit(spark, 100 * C.SHARE)
        assert spark.conf.get(keys[0]) == "100"
        C.fit(spark, 3 * C.SHARE)
        assert spark.conf.get(keys[0]) == "100" and spark.conf.get(keys[1]) == C.HASHED
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def test_facts_move_to_their_versions_and_their_day_alone(spark, tmp_path):
    """Written by dates, lines are below two exchanges; identical lines keep a number each."""
    t = C.Context(spark, SF)
    plain = S.fact_order(t.dwd, t.history, t.product, t.date, t.geo)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        product = S.dim_product(sinks.to_dates(t.dwd.select("dt", "stockcode", "description", "invoicedate")))
        by_date = S.fact_order(t.dwd, t.history, product, F.broadcast(t.date), F.broadcast(t.geo), by_date=True)
        plan = sinks.to_dates(by_date)._jdf.queryExecution().executedPlan().toString()
        # lines to versions, the versions, lines to dates, products to dates
        assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 4
        assert by_date.exceptAll(plain).count() == plain.exceptAll(by_date).count() == 0
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    doubled = t.dwd.unionByName(t.dwd)
    facts = S.fact_order(doubled, t.history, t.product, t.date, t.geo)
    assert facts.count() == 2 * t.dwd.count() == facts.select("order_line_id").distinct().count()


def test_a_refreshed_table_builds_no_other(spark):
    t = C.Context(spark, SF)
    assert set(t.refreshed("overview", "anomaly")[0]) == {"overview", "anomaly"} and not t.refreshed()[0]


def test_bitmaps_are_few_and_made_where_they_stay(spark):
    """Numbers follow first days, a bitmap is made of all its numbers at once, and lines are summed by order, not stored."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")), "yyyy-MM-dd").alias("dt")
    lines = spark.range(160000).select(day, (F.col("id") + 1000000).cast("string").alias("invoice"), (F.col("id") % 900).cast("string").alias("customerid"), F.lit(2).cast("decimal(12,2)").alias("amount"))
    lines = lines.unionByName(lines.where("invoice like '%7'")).localCheckpoint()
    orders = B.orders(lines)
    assert orders.count() == 160000 and orders.agg(F.sum("amount")).first()[0] == 2 * lines.count()
    numbers = {c: sinks.stored(B.dictionary(orders, c)) for c in ("invoice", "customerid")}
    made = B.daily_bitmaps(orders, numbers)
    plan = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "bitmap_construct_agg" in line or "Exchange" in line]
    final = [i for i, line in enumerate(plan) if "bitmap_construct_agg" in line and "partial_bitmap" not in line]
    assert len(final) == 2 and all("partial_bitmap" in plan[i + 1] for i in final)  # no bitmap is moved
    bits, sums = sinks.stored(made), sinks.stored(B.daily_sums(orders))
    assert bits.where("kind = 'invoice'").count() <= 40 + 160000 // 32768 + 1  # by the invoices' order as texts it would be 200
    assert B.alltime_summary(bits, sums).collect() == A.kpi_summary(lines).collect()
    new = orders.withColumn("invoice", F.concat(F.lit("9"), "invoice"))
    later = B.extended(numbers["invoice"], new, "invoice").where("number > 160000").join(new.withColumnRenamed("invoice", "value"), "value")
    assert {r["n"] for r in later.groupBy("dt").agg((F.max("number") - F.min("number") + 1).alias("n")).collect()} == {4000}  # side by side


def test_bitmap_queries_store_orders_and_no_lines(spark):
    old = dict(C._STORED)
    C._STORED.clear()
    try:
        queries = C.queries()
        got = queries["kpi_summary_bitmaps"](spark, SF).collect()
        assert {k[-1] for k in C._STORED} == {"orders", "numbers_invoice", "numbers_customerid", "bitmaps", "day_sums"}
        assert got == queries["kpi_summary"](spark, SF).collect() and got[0]["total_orders"] > 0
    finally:
        C._STORED.clear()
        C._STORED.update(old)
