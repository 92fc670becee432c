"""Golden rows, properties and sinks of the retail operators."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from salesmart.functions.parsing import normal_customer, parse_invoice_ts, parse_price, parse_quantity
from salesmart.operators import analytics as A, layers as L, marts as M, quality as Q, serving as V, star as S
from salesmart.sources import retail as R, sinks

RETAIL = ", ".join(f"{c} string" for c in R.COLUMNS)


def line(invoice="1", stock="p1", desc="thing", q="2", when="2010-12-01 08:26:00", price="3.50", cust="100", country="France"):
    return (invoice, stock, desc, q, when, price, cust, country)


@pytest.fixture(scope="module")
def records():
    return [
        line(), line(when="2010-12-01 08:28"), line(when="1/12/2010 08:30:00"), line(when="1/12/2010 8:30"),  # four formats
        line(when="31/2/2010 08:26", q="x", price="abc"), line(when="garbage"), line(when=" "), line(when=None),  # dates
        line(q=""), line(q="x"), line(q="3.7"), line(price=None), line(price="abc"), line(price="2.555", q="1"),
        line(invoice=" c9"), line(q="-6"), line(q="0"), line(price="0.00"), line(cust=""), line(country=" "), line(stock=""), line(desc=""),
        line(invoice="2", stock=" 85123a ", cust="17850.0", when="2010-12-02 09:00:00", price="6000", q="1"), line(invoice="3", cust="A12.0", when="2010-12-02 09:00:00"),
    ]


@pytest.fixture(scope="module")
def layers(spark, records):
    raw = L.ods_raw(spark.createDataFrame(records, RETAIL), "2010-12-03")
    ods = L.ods_typed(raw).cache()
    return raw, ods, L.ods_reject(raw, "2010-12-03"), L.dwd_clean(ods).cache()


def test_layers(layers, records):
    raw, ods, reject, dwd = layers
    codes = {r.reject_code: r.n for r in reject.groupBy("reject_code").agg(F.count("*").alias("n")).collect()}
    assert codes == {"EMPTY_INVOICE_DATE": 2, "DATE_PARSE_FAILED": 2, "EMPTY_QUANTITY": 1, "QUANTITY_PARSE_FAILED": 2, "EMPTY_PRICE": 1, "PRICE_PARSE_FAILED": 1}
    assert ods.count() + reject.count() == raw.count() == len(records)
    rows = dwd.collect()
    assert len(rows) == 8 and {r.customerid for r in rows} == {"100", "17850", "A12.0"}
    assert {r.stockcode for r in rows} == {"P1", "85123A"} and {r.amount for r in rows} == {D("7.00"), D("2.56"), D("6000.00")}
    assert sorted({r.invoicedate for r in rows})[:3] == ["2010-12-01 08:26:00", "2010-12-01 08:28:00", "2010-12-01 08:30:00"]


def test_parsing(spark):
    df = spark.createDataFrame([("13/13/2010 1:00", "99999999999999999999", "99999999999.1", " 17850 ")], "a string, b string, c string, d string")
    row = df.select(parse_invoice_ts("a").alias("a"), parse_quantity("b").alias("b"), parse_price("c").alias("c"), normal_customer("d").alias("d")).first()
    assert tuple(row) == (None, None, None, "17850")


def test_csv_round_trip(spark, tmp_path):
    rows = [line(desc='a, "b"', invoice=" 7 ", cust=""), line(desc="é")]
    R.write_retail_csv(spark.createDataFrame(rows, RETAIL), f"file://{tmp_path}/csv")
    assert sorted(map(tuple, R.read_retail_csv(spark, f"file://{tmp_path}/csv").collect())) == sorted(rows)


def test_marts(layers):
    dwd = layers[3]
    value = M.dws_customer_value(dwd)
    assert {(r.customerid, r.customer_level) for r in value.collect()} == {("100", "Low Value"), ("17850", "High Value"), ("A12.0", "Low Value")}
    con = {r.dt: r for r in M.ads_high_value_contribution(dwd, value).collect()}
    assert con["2010-12-01"].high_value_customer_cnt == 0 and con["2010-12-01"].sales_contribution_pct == 0
    assert con["2010-12-02"].sales_contribution_pct == D("99.88") and con["2010-12-02"].avg_orders_per_customer == 1
    assert M.dws_sales_summary(dwd, salts=7).exceptAll(M.dws_sales_summary(dwd)).count() == 0
    whole = M.ads_sales_overview(dwd)
    days = [M.ads_sales_overview(L.in_range(dwd, d, d)) for d in ("2010-12-01", "2010-12-02")]
    assert whole.exceptAll(days[0].unionByName(days[1])).count() == 0


def overview(spark, rows):
    return spark.createDataFrame([(d, D(s), o, c, q, D(a)) for d, s, o, c, q, a in rows], "dt string, total_sales decimal(18,2), total_orders long, total_customers long, total_quantity long, avg_order_value decimal(18,2)")


@pytest.mark.parametrize("now, level", [(("30000.00", 60), "HIGH"), (("30000.01", 60), "MEDIUM"), (("40000.00", 60), "NORMAL"), (("36000.00", 100), "MEDIUM"), (("36000.01", 100), "NORMAL")])
def test_anomaly_limits(spark, now, level):
    df = overview(spark, [("2010-01-01", "60000.00", 100, 100, 100, "600.00"), ("2010-01-05", now[0], now[1], 100, 100, "1.00")])
    first, second = M.ads_sales_anomaly(df).orderBy("dt").collect()
    assert (first.anomaly_level, first.primary_driver, first.prev_dt) == ("NOT_EVALUATED", None, None)
    assert second.anomaly_level == level and second.prev_dt == "2010-01-01"


def test_anomaly_driver(spark):
    df = overview(spark, [("2010-01-01", "100.00", 10, 1, 1, "10.00"), ("2010-01-02", "25.00", 5, 1, 1, "5.00"), ("2010-01-03", "0.00", 0, 0, 0, "0.00"), ("2010-01-04", "5.00", 1, 1, 1, "5.00")])
    rows = M.ads_sales_anomaly(df).orderBy("dt").collect()
    assert [r.primary_driver for r in rows] == [None, "ORDERS", None, None]
    assert (rows[1].orders_change_pct, rows[1].aov_change_pct, rows[2].aov_change_pct, rows[3].sales_change_pct) == (D("-50.00"), D("-50.00"), None, None)


def fold(days):
    """Day-by-day processing of customer versions."""
    versions = {}
    for d in sorted(days):
        for cust, country in days[d].items():
            own = versions.setdefault(cust, [])
            if not own or own[-1][0] != country:
                if own:
                    own[-1][2] = d - timedelta(1)
                own.append([country, d, date(9999, 12, 31)])
    return {(c, *v) for c, own in versions.items() for v in own}


def test_scd2_equals_a_daily_fold(spark):
    rng = random.Random(3)
    days = {date(2010, 1, 1) + timedelta(i): {f"c{k}": rng.choice("ABC") for k in range(8) if rng.random() < 0.6} for i in range(40)}
    daily = spark.createDataFrame([(str(d), c, x) for d, m in days.items() for c, x in m.items()], "dt string, customerid string, country string")
    history = S.scd2_history(daily).cache()
    assert {(r.customerid, r.country, r.start_date, r.end_date) for r in history.collect()} == fold(days)
    for d in (date(2010, 1, 7), date(2010, 1, 23)):
        snap = {(r.customerid, r.country, r.start_date, r.end_date) for r in S.scd2_snapshot(history, str(d)).collect()}
        assert snap == fold({k: v for k, v in days.items() if k <= d})


def test_star_keys(spark):
    daily = spark.createDataFrame([("2010-01-15", "12431", "Belgium"), ("2010-03-04", "12431", "Australia")], "dt string, customerid string, country string")
    assert {r.user_id for r in S.scd2_history(daily).collect()} == {"57d1ccdac3e283cfd7d9eeb640f56ef5", "5b3505b2200cc7e59ae46e9c5a199e99"}


def test_star(spark):
    rows = [line(when="2010-01-01 08:00:00", cust="1", country="B"), line(when="2010-01-01 09:00:00", cust="1", country="A"), line(when="2010-01-01 09:00:00", cust="1", country="C"), line(when="2010-01-02 09:00:00", cust="1", country="C", desc=" "), line(when="2010-01-02 08:00:00", cust="1", country="C", desc="old"), line(when="2010-01-02 08:30:00", cust="1", country="C", desc="new"), line(cust="2"), line(cust="2")]
    dwd = L.dwd_clean(L.ods_typed(spark.createDataFrame(rows, RETAIL))).cache()
    daily = S.daily_customer_country(dwd)
    assert {(r.dt, r.country) for r in daily.where("customerid = '1'").collect()} == {("2010-01-01", "A"), ("2010-01-02", "C")}
    history, product, geo, day = S.scd2_history(daily), S.dim_product(dwd), S.dim_geo(dwd), S.dim_date(dwd)
    assert product.where("dt = '2010-01-02'").first().description == "new"
    fact = S.fact_order(dwd, history, product, day, geo).cache()
    assert fact.count() == len(rows) == fact.select("order_line_id").distinct().count()
    result = Q.star_quality_rules(dwd, history, product, geo, day, fact, M.dws_customer_value_star(fact))
    assert Q.assert_gate(result, 18).where("check_status = 'FAIL'").count() == 0
    broken = Q.star_quality_rules(dwd, history, product.limit(0), geo, day, fact, M.dws_customer_value_star(fact))
    with pytest.raises(RuntimeError, match="STAR_015"):
        Q.assert_gate(broken)
    with pytest.raises(RuntimeError):
        Q.assert_gate(result, 17)


def test_guard(spark):
    dates = spark.createDataFrame([("2010-01-01",), ("2010-01-03",), ("2010-01-05",)], "dt string")
    status = lambda snap, d: S.scd2_append_guard(snap, dates, d).first().guard_status
    one = dates.where("dt = '2010-01-01'")
    assert [status(one, d) for d in ("2010-01-01", "2010-01-03", "2010-01-05")] == ["BLOCK_HISTORY_OVERWRITE", "ALLOW", "BLOCK_GAP"]
    assert status(dates, "2010-01-06") == "BLOCK_NO_NEXT_DWD_DT" and status(dates.limit(0), "2010-01-01") == "INITIAL_LOAD"
    state = lambda *t: S.star_partition_state(dict(enumerate(map(str, t))) and {str(i): x for i, x in enumerate(t)}, dates, "2010-01-01").first().state
    assert [state(dates.limit(0), dates.limit(0)), state(one, dates.limit(0)), state(one, dates), state(one, one)] == ["INITIAL", "BLOCK_PARTIAL_DATE", "BLOCK_PARTITION_MISMATCH", "APPEND"]


SERVING = [("2009-12-10", "38806.36", 20, 18, 1000, "1940.32"), ("2009-12-13", "25000.00", 15, 14, 700, "1666.67"), ("2009-12-14", "9999.99", 8, 7, 300, "1250.00")]


def test_serving(spark):
    s = overview(spark, SERVING).withColumn("source_system", F.when(F.col("dt") == "2009-12-14", "other_source").otherwise("retail_canonical"))
    rows = {r.dt: r for r in V.overview_comparison(s).collect()}
    assert (rows["2009-12-13"].prev_dt, rows["2009-12-13"].available, rows["2009-12-14"].available) == ("2009-12-10", True, False)
    changed = overview(spark, [("2010-01-01", "300.00", 1, 0, 5, "1.00"), ("2010-01-02", "1000.00", 1, 3, 5, "1.00")]).withColumn("source_system", F.lit("x"))
    row = V.overview_comparison(changed).where("available").first()
    assert (row.sales_change_pct, row.orders_change_pct, row.customers_change_pct) == (D("233.33"), D("0.00"), None)
    new = overview(spark, [("2009-12-13", "1.00", 1, 1, 1, "1.00"), ("2009-12-15", "2.00", 1, 1, 1, "2.00")])
    out = {r.dt: r.total_sales for r in V.serving_upsert(s, new, "retail_canonical").collect()}
    assert out == {"2009-12-10": D("38806.36"), "2009-12-13": D("1.00"), "2009-12-14": D("9999.99"), "2009-12-15": D("2.00")}
    with pytest.raises(ValueError):
        V.serving_upsert(s, new, "another")
    with pytest.raises(ValueError):
        V.serving_upsert(s, new, "")
    for ends in (("2010-01-02", "2010-01-01"), ("2010-01-01", "2010-02-01")):
        with pytest.raises(ValueError):
            V.overview_trend(s, *ends)
    assert V.overview_trend(s, "2009-12-01", "2009-12-31").count() == 3


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    day = lambda *rows: spark.createDataFrame(list(rows), "v long, dt string")
    read = lambda: sorted((r.dt, r.v) for r in spark.read.schema("v long, dt string").parquet(path).collect())
    sinks.overwrite_dynamic(day((1, "2010-01-01"), (2, "2010-01-02"), (3, "2010-01-04")), path)
    sinks.overwrite_dynamic(day((5, "2010-01-02")), path)
    assert read() == [("2010-01-01", 1), ("2010-01-02", 5), ("2010-01-04", 3)]
    facts = sinks.overwrite_range(day((7, "2010-01-01"), (8, "2010-01-09")), path, "2010-01-01", "2010-01-03", "v").first()
    assert read() == [("2010-01-01", 7), ("2010-01-04", 3)] and (facts.row_count, facts.total) == (1, 7)
    sinks.overwrite_partition(day((9, "2010-01-04")).where("false"), path, "2010-01-04")
    assert read() == [("2010-01-01", 7)]


def test_replicate_and_profile(spark):
    df = spark.createDataFrame([line(invoice=" 1 "), line(when="29/2/2012 8:30")], RETAIL)
    out = R.replicate_dataset(df, 3, 1, trim=True, lineage=True)
    assert out.count() == 6 and out.select("source_row_id").distinct().count() == 2
    assert {r.invoicedate for r in out.collect()} >= {"2010-12-01 08:26:00", "2012-12-01 08:26:00", "2012-02-29 08:30:00", "2013-02-28 08:30:00"}
    assert R.replicate_dataset(df, 2).columns == df.columns
    with pytest.raises(Exception, match="can't be parsed"):
        R.replicate_dataset(spark.createDataFrame([line(when="x")], RETAIL), 2, 1).collect()
    p = R.dataset_profile(df.union(spark.createDataFrame([line(when="x")], RETAIL))).first()
    assert tuple(p) == (3, 2, 1, "2010-12-01", "2012-02-29")


def test_fingerprint_and_reconcile(layers):
    dwd = layers[3]
    for method in ("md5", "crc32"):
        a = Q.table_fingerprint({"t": dwd}, method).collect()
        assert a == Q.table_fingerprint({"t": dwd.repartition(3)}, method).collect() != Q.table_fingerprint({"t": dwd.limit(3)}, method).collect()
    o = M.ads_sales_overview(dwd)
    assert Q.reconcile_tables(o, o, "dt", ["total_sales"]).count() == 0
    moved = o.where("dt > '2010-12-01'").withColumn("total_sales", F.col("total_sales") + D("0.001"))
    kinds = lambda tol: sorted(r.diff_kind for r in Q.reconcile_tables(o, moved, "dt", ["total_sales"], tol).collect())
    assert kinds(0.0) == ["mismatch", "missing_right"] and kinds(0.001) == ["missing_right"]


def test_global_rank(spark):
    values = [i % 17 for i in range(200)]
    out = A.global_rank(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long"), "v", "r")
    assert {(r.v, r.r) for r in out.collect()} == {(v, 1 + sum(x > v for x in values)) for v in values}


def test_entry_without_the_corpus_package(tmp_path):
    """Nothing outside the corpus package imports it, and the entry loads where it and its pipeline are deleted."""
    import ast
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    for f in (root / "salesmart").rglob("*.py"):
        if "llm" not in f.relative_to(root / "salesmart").parts:
            for n in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] + [a.name for a in n.names] if isinstance(n, ast.ImportFrom) else []
                assert not any("llm" in x.split(".") or x == "corpus_pipeline" for x in names), f
    shutil.copytree(root / "salesmart", tmp_path / "salesmart", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_range_validation(layers):
    """Missing dates, extra dates, doubled keys and shares out of range are told apart, at their levels."""
    dwd = layers[3]
    value, summary = M.dws_customer_value(dwd), M.dws_sales_summary(dwd)
    marts = {"dws_customer_value": value, "dws_sales_summary": summary, "ads_high_value_contribution": M.ads_high_value_contribution(dwd, value), "ads_level_distribution": M.ads_level_distribution(value), "ads_country_rank": M.ads_country_rank(summary), "ads_high_value_preference": M.ads_high_value_preference(dwd, value)}

    def failed(**changed):
        return {(r.table_name, r.check_item, r.check_level) for r in Q.mart_range_validation(dwd, {**marts, **changed}).collect() if r.check_status == "FAIL"}

    usual = failed()
    assert all(lvl == "WARN" and t == "ads_high_value_preference" for t, _, lvl in usual)
    day = summary.agg(F.min("dt")).first()[0]
    lost = failed(dws_sales_summary=summary.where(F.col("dt") != day)) - usual
    assert lost == {("dws_sales_summary", i, "BLOCK") for i in ("date_count", "missing_dates", "sales_match_lines")}
    more = failed(ads_country_rank=marts["ads_country_rank"].unionByName(marts["ads_country_rank"].limit(1).withColumn("dt", F.lit("1999-01-01")))) - usual
    assert more == {("ads_country_rank", "date_count", "BLOCK"), ("ads_country_rank", "sales_match_lines", "BLOCK")}
    preference = marts["ads_high_value_preference"]
    assert failed(ads_high_value_preference=preference.unionByName(preference)) - usual == {("ads_high_value_preference", "doubled_keys", "BLOCK")}
    contribution, levels = marts["ads_high_value_contribution"], marts["ads_level_distribution"]
    assert failed(ads_high_value_contribution=contribution.withColumn("sales_contribution_pct", F.lit(101).cast("decimal(10,2)"))) - usual == {("ads_high_value_contribution", "share_in_range", "BLOCK")}
    assert failed(ads_level_distribution=levels.withColumn("customer_cnt_pct", (F.col("customer_cnt_pct") + 1).cast("decimal(10,2)"))) - usual == {("ads_level_distribution", "shares_add_up", "BLOCK")}
    assert ("dwd_retail_clean", "non_empty", "BLOCK") in {(r.table_name, r.check_item, r.check_level) for r in Q.mart_range_validation(dwd.where("false"), {n: m.where("false") for n, m in marts.items()}).collect() if r.check_status == "FAIL"}


def test_replicated_table_is_whole(spark):
    """The queries replicate every landed row, and shift every row whose date parses, in all four formats."""
    from salesmart.plans import catalogue

    sf, q = "/root/testdata/sf0.001", catalogue.queries()
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    profile = q["dataset_profile"](spark, sf).first()
    assert q["replicate_dataset_unshifted"](spark, sf).count() == 3 * rows == 3 * profile.row_count
    shifted = q["replicate_dataset_parseable"](spark, sf)
    assert shifted.count() == 3 * profile.parseable > 2 * rows
    assert shifted.where("not invoicedate rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$'").count() == 0
