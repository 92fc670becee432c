"""Steps that queries share: rows are computed once, and what a query doesn't read isn't stored."""

import random

from pyspark.sql import functions as F

from salesmart.functions import parsing as P
from salesmart.operators import layers as L, marts as M, quality as Q
from salesmart.plans import catalogue as C
from salesmart.sources import retail as R

SF = "/root/testdata/sf0.001"


def test_dates_in_full_shape_give_what_the_formats_give(spark):
    rng = random.Random(5)
    rows = [("2011-12-09 08:26\n",), ("9/12/2011 8:26\n",), ("0000-01-01 00:00",), ("2011-02-29 08:26",), ("2012-02-29 8:26:59",), ("29/2/2011 8:26",), ("29/02/2012 8:26",), ("2011-12-09 24:00",), ("2011-12-09T08:26",), ("1/1/0000 1:00",), ("2011-12-09 08:26:60",), ("\t9/12/2011 8:26",), ("2011-12-09 8:26:0",)]
    for _ in range(2000):
        y, m, d, h, mi, s = rng.choice(("2011", "1582", "0001", "9999", "12011")), rng.randint(0, 13), rng.randint(0, 32), rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 61)
        time = f"{h:0{rng.choice((1, 2))}d}:{mi:02d}" + rng.choice(("", f":{s:02d}"))
        rows.append((rng.choice((f"{y}-{m:02d}-{d:02d} {time}", f"{d}/{m:0{rng.choice((1, 2))}d}/{y} {time}")),))
    df = spark.createDataFrame(rows, "t string")
    assert df.where(P.parse_invoice_ts("t").isNotNull()).count() > 300
    assert df.where(~P._by_format(F.trim("t")).eqNullSafe(P.parse_invoice_ts("t"))).count() == 0


def test_clean_lines_alone_store_no_layer_below(spark, tmp_path):
    old = dict(C._STORED)
    C._STORED.clear()
    try:
        alone = C.Context(spark, SF).dwd
        assert {k[-1] for k in C._STORED} == {"dwd"}
        below = C.Context(spark, SF).over("raw", "ods")
        assert {k[-1] for k in C._STORED} == {"raw", "ods", "dwd"}
        again = L.dwd_clean(below.ods)
        assert alone.exceptAll(again).count() == again.exceptAll(alone).count() == 0
    finally:
        C._STORED.clear()
        C._STORED.update(old)


def test_typing_and_copying_parse_a_row_once(spark):
    raw = L.ods_raw(R.retail_from_orders(spark, SF), "2010-01-01")
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp(")
    one = parses(raw.select(P.parse_invoice_ts("invoicedate")))
    assert one > 0 and parses(L.ods_typed(raw)) == one
    assert parses(R.replicate_dataset(raw.drop("batch_dt"), 3, 2)) == one


def test_contribution_by_value_moves_no_lines_for_its_shares(spark):
    t = C.Context(spark, SF)
    lines = t.dwd.where("dt > '1998'").unionByName(t.dwd.where("dt <= '1998' and amount < 10"))  # and days without any high-value customer
    value = M.dws_customer_value(lines)
    want, got = M.ads_high_value_contribution(lines, value), M.contribution_by_value(lines, value)
    assert want.schema.names == got.schema.names and want.dtypes == got.dtypes and want.where("high_value_customer_cnt = 0").count() > 0
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    plan = M.contribution_by_value(t.dwd, t.value).select("sales_contribution_pct")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_sanity_checks_store_no_marked_lines(spark):
    old = dict(C._STORED)
    C._STORED.clear()
    try:
        assert C.queries()["result_sanity_checks"](spark, SF).count() == 18
        assert {k[-1] for k in C._STORED} == {"dwd", "value"}
    finally:
        C._STORED.clear()
        C._STORED.update(old)


def test_row_hashes_add_longs_and_give_the_decimal_sums(spark):
    df = spark.range(3000).select((F.col("id") % 2500).alias("a"), F.when(F.col("id") % 7 > 0, F.md5(F.col("id").cast("string"))).alias("b"))
    row = F.concat_ws("#|#", F.coalesce(F.col("a").cast("string"), F.lit("<NULL>")), F.coalesce("b", F.lit("<NULL>")))
    for method, h in (("md5", lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10)), ("crc32", F.crc32)):
        got = df.agg(*Q.row_hashes(df, method))
        assert tuple(got.first()) == tuple(df.agg(*[F.sum(h(s).cast("decimal(20,0)")).cast("decimal(38,0)") for s in (row, F.reverse(row))]).first())
        assert "sum(cast(conv" not in got._jdf.queryExecution().optimizedPlan().toString() and {f.dataType.simpleString() for f in got.schema} == {"decimal(38,0)"}
        assert tuple(df.limit(0).agg(*Q.row_hashes(df, method)).first()) == (0, 0)


def test_star_gate_finds_orphans_and_repeated_keys_and_moves_no_fact(spark):
    t = C.Context(spark, SF)
    none, wrong = F.lit(None).cast("string"), F.lit("x" * 16)
    bad = t.fact.withColumn("user_id", F.when(F.col("order_id").like("%1"), none).when(F.col("order_id").like("%2"), wrong).otherwise(F.col("user_id")))
    bad = bad.withColumn("product_id", F.when(F.col("order_id").like("%3"), F.upper("product_id")).otherwise(F.col("product_id"))).withColumn("geo_id", F.when(F.col("order_id").like("%5"), none).otherwise(F.col("geo_id")))
    bad = bad.withColumn("order_line_id", F.when(F.col("order_id").like("%7"), none).when(F.col("order_id").like("%8"), F.col("order_id")).otherwise(F.col("order_line_id"))).localCheckpoint()
    product = t.product.unionByName(t.product.where("stockcode like '%4'")).localCheckpoint()
    history = t.history.unionByName(t.history.where("customerid like '%6'")).withColumn("user_id", F.when(F.col("customerid").like("%9"), none).otherwise(F.col("user_id"))).localCheckpoint()
    star = M.dws_customer_value_star(bad)
    rules = {r["rule_code"]: r["abnormal_cnt"] for r in Q.star_quality_rules(t.dwd, history, product, t.geo, t.date, bad, star).collect()}
    left = lambda dim, keys: bad.join(dim.select(*keys).distinct(), keys, "left_anti").count()
    assert rules["STAR_015"] == left(history, ["user_id"]) + left(product, ["dt", "product_id"]) + left(t.geo, ["dt", "geo_id"]) + left(t.date, ["dt", "date_id"]) > 0
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1").count()
    assert rules["STAR_011"] == twice(bad, "order_line_id") > 1 and rules["STAR_005"] == twice(product, "dt", "product_id") > 0 and rules["STAR_013"] == twice(history, "user_id") > 1
    assert rules["STAR_006"] == rules["STAR_007"] == 0
    plan = t.star_rules._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
