"""Quality gates, profiles, fingerprints and reconciliation.

Gates return a row for each rule; rules are declared as data over one row of figures, so that each table
is read once and the expected number of rules follows from the declaration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.parsing import blank, packed, parse_invoice_ts, parse_price, parse_quantity, ratio
from ..sources.sinks import stored

VALUE = "decimal(38,6)"
BLOCK, WARN = "BLOCK", "WARN"


def gate(figures: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows of rules (code, table, item, level, abnormal, actual, threshold, detail) over one row of figures."""
    made = [
        F.struct(F.lit(code).alias("rule_code"), F.lit(table).alias("table_name"), F.lit(item).alias("check_item"), F.lit(lvl).alias("check_level"),
                 F.coalesce(abnormal.cast("long"), F.lit(1).cast("long")).alias("abnormal_cnt"), actual.cast(VALUE).alias("actual_value"), F.lit(threshold).cast(VALUE).alias("threshold_value"), F.lit(detail).alias("check_detail"))
        for code, table, item, lvl, abnormal, actual, threshold, detail in rules
    ]
    rows = figures.select(F.explode(F.array(*made)).alias("r")).select("r.*")
    return rows.withColumn("check_status", F.when(F.col("abnormal_cnt") == 0, "PASS").otherwise("FAIL"))


def assert_gate(result: DataFrame, rules: int | None = None) -> DataFrame:
    """``result``, unless a blocking rule failed or rows are missing: then RuntimeError."""
    rows = result.collect()  # one row a rule
    if not rows or (rules is not None and len(rows) != rules):
        raise RuntimeError(f"a gate gave {len(rows)} rules instead of {rules or 'some'}")
    failed = sorted(r["rule_code"] for r in rows if r["check_status"] != "PASS" and r["check_level"] == BLOCK)
    if failed:
        raise RuntimeError(f"blocking rules failed: {', '.join(failed)}")
    return result


def _cross(*frames: DataFrame) -> DataFrame:
    """Side by side: each frame has one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def _counted(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _filled(code, table, column):
    return (code, table, "non_empty", BLOCK, F.when(F.col(column) > 0, 0).otherwise(1), F.col(column), 1, "row count >= 1")


def _zero(code, table, item, column, detail, lvl=BLOCK):
    return (code, table, item, lvl, F.col(column), F.col(column), 0, detail)


def _near(code, table, item, left, right, tolerance, detail):
    diff = F.abs(F.coalesce(F.col(left), F.lit(0)) - F.coalesce(F.col(right), F.lit(0)))
    return (code, table, item, BLOCK, F.when(diff <= tolerance, 0).otherwise(1), diff, tolerance, detail)


def _admitted() -> Column:
    return parse_invoice_ts("invoicedate").isNotNull() & parse_quantity("quantity").isNotNull() & parse_price("price").isNotNull()


def ods_ingestion_balance(source: DataFrame, raw: DataFrame, ods: DataFrame, reject: DataFrame, bizdate: str) -> DataFrame:
    """One row of counts and passes: every raw record is typed, rejected or of another date, and stored as such."""
    ok, day = _admitted(), F.date_format(parse_invoice_ts("invoicedate"), "yyyy-MM-dd")
    m = raw.agg(F.count(F.lit(1)).alias("raw_cnt"), _counted(ok & (day == bizdate), "expected_ods_cnt"), _counted(~ok, "expected_reject_cnt"), _counted(ok & (day != bizdate), "expected_other_date_cnt"))
    s = source.agg(F.count(F.lit(1)).alias("source_cnt"))
    o = ods.where(F.col("dt") == bizdate).agg(F.count(F.lit(1)).alias("ods_cnt"))
    j = reject.agg(F.count(F.lit(1)).alias("reject_cnt"))
    return _cross(m, s, o, j).select(
        "*", F.expr("source_cnt = raw_cnt").alias("source_pass"), F.expr("raw_cnt = expected_ods_cnt + expected_reject_cnt + expected_other_date_cnt").alias("balance_pass"),
        F.expr("ods_cnt = expected_ods_cnt").alias("ods_pass"), F.expr("reject_cnt = expected_reject_cnt").alias("reject_pass"),
    )


def ods_batch_check(raw: DataFrame, reject: DataFrame, ods: DataFrame, expected_raw: int, min_dt: str, max_dt: str, expected_reject: int = 0) -> DataFrame:
    """One row: a whole batch against its expected totals and dates."""
    o = ods.agg(F.count(F.lit(1)).alias("ods_cnt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.count_distinct("dt").alias("dt_cnt"), _counted((F.col("dt") < min_dt) | (F.col("dt") > max_dt) | F.col("dt").isNull(), "outside_cnt"))
    m = _cross(raw.agg(F.count(F.lit(1)).alias("raw_cnt")), reject.agg(F.count(F.lit(1)).alias("reject_cnt")), o)
    return m.select(
        "*", (F.col("raw_cnt") == expected_raw).alias("raw_count_pass"), (F.col("reject_cnt") == expected_reject).alias("reject_count_pass"), F.expr("raw_cnt = ods_cnt + reject_cnt").alias("balance_pass"),
        F.coalesce(F.col("min_dt") == min_dt, F.lit(False)).alias("min_date_pass"), F.coalesce(F.col("max_dt") == max_dt, F.lit(False)).alias("max_date_pass"), F.expr("outside_cnt = 0").alias("date_range_pass"),
    )


def ods_content_profile(ods: DataFrame, reject: DataFrame) -> DataFrame:
    """Named counts of the typed layer and the rejects, in long form: report, item, cnt."""
    texts = ("invoice", "stockcode", "description", "customerid", "country", "invoicedate")
    returned = F.upper(F.trim("invoice")).startswith("C")
    parts = {
        ("rows", "ods_row_cnt"): F.count(F.lit(1)), **{("rows", f"{n}_cnt"): F.count_distinct(c) for n, c in (("invoice", "invoice"), ("customer", "customerid"), ("product", "stockcode"), ("country", "country"))},
        **{("blank", f"null_{c}_cnt"): F.count_if(blank(c)) for c in texts},
        ("numbers", "null_quantity_cnt"): F.count_if(F.col("quantity").isNull()), ("numbers", "null_price_cnt"): F.count_if(F.col("price").isNull()),
        ("numbers", "non_positive_quantity_cnt"): F.count_if(F.col("quantity") <= 0), ("numbers", "non_positive_price_cnt"): F.count_if(F.col("price") <= 0),
        ("numbers", "non_positive_amount_cnt"): F.count_if(F.col("quantity").cast("decimal(18,0)") * F.col("price") <= 0),
        ("returns", "return_order_row_cnt"): F.count_if(returned), ("returns", "return_invoice_cnt"): F.count_distinct(F.when(returned, F.col("invoice"))),
    }
    row = ods.agg(*[c.alias(f"m{i}") for i, c in enumerate(parts.values())])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("report"), F.lit(n).alias("item"), F.col(f"m{i}").cast("long").alias("cnt")) for i, (r, n) in enumerate(parts)])).alias("x")).select("x.*")
    total = reject.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("reject").alias("report"), F.lit("reject_row_cnt").alias("item"), "cnt")
    codes = reject.groupBy(F.col("reject_code").alias("item")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("reject_code").alias("report"), "item", "cnt")
    return long.unionByName(total).unionByName(codes)


def _ods_admits_dwd() -> Column:
    ok = (F.col("quantity") > 0) & (F.col("price") > 0) & ~F.upper(F.trim("invoice")).startswith("C")
    for c in ("customerid", "invoice", "stockcode", "country", "invoicedate"):
        ok = ok & ~blank(c)
    return F.coalesce(ok, F.lit(False))


def dwd_quality_rules(dwd: DataFrame, ods: DataFrame) -> DataFrame:
    """Six rules on clean lines."""
    d = dwd.agg(F.count(F.lit(1)).alias("n"), _counted(F.col("quantity").isNull() | (F.col("quantity") <= 0), "q"), _counted(F.col("price").isNull() | (F.col("price") <= 0), "p"), _counted(blank("customerid"), "c"), _counted(parse_invoice_ts("invoicedate").isNull(), "t"))
    o = ods.agg(_counted(_ods_admits_dwd(), "expected"))
    t = "dwd_retail_clean"
    return gate(_cross(d, o), [
        _zero("DWD_001", t, "quantity_positive", "q", "lines with quantity <= 0"), _zero("DWD_002", t, "price_positive", "p", "lines with price <= 0"),
        _zero("DWD_003", t, "customer_present", "c", "lines without a customer"), _filled("DWD_004", t, "n"),
        _near("DWD_005", t, "rows_match_ods", "n", "expected", 0, "lines expected from the typed layer"), _zero("DWD_006", t, "time_parseable", "t", "lines whose time text doesn't parse"),
    ])


def result_quality_rules(dwd, customer_value, summary, contribution, distribution, rank, preference) -> DataFrame:
    """Eleven rules on the daily marts."""
    total = lambda df, c, n, s: df.agg(F.count(F.lit(1)).alias(n), F.sum(F.col(c).cast("decimal(28,2)")).alias(s))
    sums = distribution.groupBy("dt").agg(F.sum("customer_cnt_pct").alias("a"), F.sum("sales_pct").alias("b"))
    off = lambda c: F.coalesce(F.abs(F.col(c) - 100) > 0.05, F.lit(True))
    f = _cross(
        total(dwd, "amount", "n_dwd", "s_dwd"), total(customer_value, "total_spent", "n_cv", "s_cv"), total(summary, "total_sales", "n_sum", "s_sum"),
        contribution.agg(F.count(F.lit(1)).alias("n_con"), _counted(F.col("sales_contribution_pct").isNull() | ~F.col("sales_contribution_pct").between(0, 100), "bad_pct")),
        distribution.agg(F.count(F.lit(1)).alias("n_dist")), rank.agg(F.count(F.lit(1)).alias("n_rank")), preference.agg(F.count(F.lit(1)).alias("n_pref")),
        sums.agg(_counted(off("a"), "off_a"), _counted(off("b"), "off_b")),
    )
    warn = _filled("RESULT_008", "ads_high_value_preference", "n_pref")
    return gate(f, [
        _filled("RESULT_001", "dws_customer_value", "n_cv"), _filled("RESULT_002", "dws_sales_summary", "n_sum"),
        _near("RESULT_003", "dws_customer_value", "sales_match_dwd", "s_cv", "s_dwd", 0.01, "sales of lines and of the mart"), _near("RESULT_004", "dws_sales_summary", "sales_match_dwd", "s_sum", "s_dwd", 0.01, "sales of lines and of the mart"),
        _filled("RESULT_005", "ads_high_value_contribution", "n_con"), _filled("RESULT_006", "ads_level_distribution", "n_dist"), _filled("RESULT_007", "ads_country_rank", "n_rank"),
        (*warn[:3], WARN, *warn[4:]),
        _zero("RESULT_009", "ads_level_distribution", "customer_pct_sum", "off_a", "dates whose shares don't add to 100 within 0.05"), _zero("RESULT_010", "ads_level_distribution", "sales_pct_sum", "off_b", "dates whose shares don't add to 100 within 0.05"),
        _zero("RESULT_011", "ads_high_value_contribution", "pct_in_range", "bad_pct", "rows whose share is outside 0 to 100"),
    ])


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` (null among them) that several rows have. Rows are counted by a hash first; keys move only where that repeats.

    What repeats is stored, so that its size is known before any key moves.
    """
    h = F.xxhash64(key).alias("_h")
    again = stored(df.groupBy(h).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    return df.select(key, h).join(again, "_h", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)


def _met(fact: DataFrame, dim: DataFrame, key: str, by: list[str], orphans: str, doubled: str) -> DataFrame:
    """One row: facts whose key (beside ``by``) the dimension lacks or that have none, and keys that the dimension has twice."""
    side = lambda df, n: df.select(*by, packed(key).alias("_k")).groupBy(*by, "_k").agg(F.count(F.lit(1)).alias(n))
    # keys with a null meet nothing, and are counted as such below
    g = side(fact, "_w").join(side(dim, "_n"), [*by, "_k"], "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    none = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*by, "_k")])
    return g.agg(F.coalesce(F.sum(F.when((F.col("_n") == 0) | none, F.col("_w"))), F.lit(0)).alias(orphans), _counted(F.col("_n") > 1, doubled))


def star_quality_rules(dwd, history, product, geo, date, fact, star_dws) -> DataFrame:
    """Eighteen rules on the star schema."""
    before = Window.partitionBy("customerid").orderBy("start_date", "user_id").rowsBetween(Window.unboundedPreceding, -1)
    overlap = history.withColumn("_e", F.max("end_date").over(before)).agg(_counted(F.col("_e") >= F.col("start_date"), "overlap"))
    user = history.agg(F.count(F.lit(1)).alias("n_user"), _counted(F.col("start_date") > F.col("end_date"), "bad_range"), _counted(F.col("is_current") & (F.col("end_date") != F.to_date(F.lit("9999-12-31"))), "bad_end"))
    current = history.groupBy("customerid").agg(F.count_if("is_current").alias("_n")).agg(_counted(F.col("_n") != 1, "not_one"))
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("user_id", "product_id", "date_id", "geo_id")])
    facts = fact.agg(F.count(F.lit(1)).alias("n_fact"), F.sum("amount").cast("decimal(28,2)").alias("s_fact"), _counted(null_key, "null_key"), _counted(~F.col("date_id").cast("string").eqNullSafe(F.col("dt")), "bad_date"))
    # a dimension's keys and the facts' meet as counts, so that no fact moves: rows of the dimension and facts a key
    dims = {"product": (product, "product_id", ["dt"]), "geo": (geo, "geo_id", ["dt"]), "date": (date, "date_id", ["dt"]), "user": (history, "user_id", [])}
    met = [_met(fact, df, k, by, f"o_{n}", f"d_{n}") for n, (df, k, by) in dims.items()]
    lines = dwd.agg(F.count(F.lit(1)).alias("n_dwd"), F.sum("amount").cast("decimal(28,2)").alias("s_dwd"))
    day = F.to_date("dt")
    per_day = dwd.select("customerid", "dt").groupBy("customerid", "dt").agg(F.count(F.lit(1)).alias("_w"))
    # a sweep in order of time counts the versions that are open on a day: no pairs of days and versions
    moment = lambda df, at, kind, step, lines: df.select("customerid", at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(step).alias("_step"), lines.cast("long").alias("_w"))
    none = F.lit(0)
    moments = moment(history, F.col("start_date"), 0, 1, none).unionByName(moment(history.where("end_date < date'9999-12-31'"), F.date_add("end_date", 1), 0, -1, none)).unionByName(moment(per_day, day, 1, 0, F.col("_w")))
    open_ = F.sum("_step").over(Window.partitionBy("customerid").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    match = moments.withColumn("_open", open_).agg(F.coalesce(F.sum(F.when((F.col("_kind") == 1) & (F.col("_open") != 1), F.col("_w"))), F.lit(0)).alias("unmatched"))
    mart = star_dws.agg(F.sum("total_amount").cast("decimal(28,2)").alias("s_star"))
    line = repeated(fact, "order_line_id").agg(F.count(F.lit(1)).alias("d_line"))
    f = _cross(user, current, overlap, facts, lines, mart, match, *met, line).withColumn("orphans", sum((F.col(f"o_{n}") for n in dims), F.lit(0)))
    return gate(f, [
        _filled("STAR_001", "dim_user", "n_user"), _zero("STAR_002", "dim_user", "one_current", "not_one", "customers without exactly one current version"),
        _zero("STAR_003", "dim_user", "valid_range", "bad_range", "versions that end before they start"), _zero("STAR_004", "dim_user", "current_open", "bad_end", "current versions that aren't open"),
        _zero("STAR_005", "dim_product", "key_unique", "d_product", "repeated keys"), _zero("STAR_006", "dim_geo", "key_unique", "d_geo", "repeated keys"), _zero("STAR_007", "dim_date", "key_unique", "d_date", "repeated keys"),
        _filled("STAR_008", "fact_order", "n_fact"), _near("STAR_009", "fact_order", "rows_match_dwd", "n_fact", "n_dwd", 0, "rows of lines and facts"), _near("STAR_010", "fact_order", "amount_match_dwd", "s_fact", "s_dwd", 0.01, "amounts of lines and facts"),
        _zero("STAR_011", "fact_order", "line_unique", "d_line", "repeated line ids"), _near("STAR_012", "dws_customer_value_star", "amount_match_fact", "s_star", "s_fact", 0.01, "amounts of facts and the mart"),
        _zero("STAR_013", "dim_user", "key_unique", "d_user", "repeated keys"), _zero("STAR_014", "fact_order", "keys_present", "null_key", "facts with a missing key"), _zero("STAR_015", "fact_order", "no_orphans", "orphans", "facts whose key no dimension has"),
        _zero("STAR_016", "fact_order", "one_version", "unmatched", "lines without exactly one customer version"), _zero("STAR_017", "fact_order", "date_matches", "bad_date", "facts whose date key differs from their date"), _zero("STAR_018", "dim_user", "no_overlap", "overlap", "versions that overlap an earlier one"),
    ])


def quality_gate_summary(result: DataFrame) -> DataFrame:
    """One row: rule counts by level and status."""
    hit = lambda lvl, st: F.count_if((F.col("check_level") == lvl) & (F.col("check_status") == st))
    return result.agg(F.count(F.lit(1)).alias("rule_cnt"), F.count_distinct("rule_code").alias("distinct_rule_cnt"), hit(BLOCK, "PASS").alias("block_pass_cnt"), hit(BLOCK, "FAIL").alias("block_fail_cnt"), hit(WARN, "FAIL").alias("warn_cnt"))


def layer_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and date."""
    parts = [t.groupBy("dt").agg(F.count(F.lit(1)).alias("row_cnt")).select(F.lit(n).alias("table_name"), "dt", "row_cnt") for n, t in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def result_sanity_checks(dwd, customer_value, contribution, distribution, rank, preference) -> DataFrame:
    """Named counts of what shouldn't be there: check_item, abnormal_cnt."""
    lvl, spent = F.col("customer_level"), F.col("total_spent")
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    checks = [
        (dwd, {"dwd_invalid_quantity_cnt": F.col("quantity") <= 0, "dwd_invalid_price_cnt": F.col("price") <= 0, "dwd_null_or_blank_customerid_cnt": blank("customerid"), "dwd_cancel_invoice_cnt": F.upper(F.trim("invoice")).startswith("C"), "dwd_invalid_amount_cnt": bad("amount")}),
        (customer_value, {"dws_null_customer_level_cnt": lvl.isNull(), "dws_invalid_customer_level_cnt": ~lvl.isin("High Value", "Medium Value", "Low Value"), "dws_high_value_boundary_error_cnt": (lvl == "High Value") & (spent < 5000),
                          "dws_medium_value_boundary_error_cnt": (lvl == "Medium Value") & ((spent < 1000) | (spent >= 5000)), "dws_low_value_boundary_error_cnt": (lvl == "Low Value") & (spent >= 1000)}),
        (contribution, {"ads_high_value_sales_contribution_pct_error_cnt": F.col("sales_contribution_pct").isNull() | ~F.col("sales_contribution_pct").between(0, 100)}),
        (distribution.groupBy("dt").agg(F.sum("customer_cnt_pct").alias("a"), F.sum("sales_pct").alias("b")), {"ads_customer_level_customer_pct_sum_error_cnt": F.abs(F.col("a") - 100) > 0.05, "ads_customer_level_sales_pct_sum_error_cnt": F.abs(F.col("b") - 100) > 0.05}),
        (rank, {"ads_country_sales_rank_null_rank_cnt": F.col("sales_rank").isNull(), "ads_country_sales_rank_invalid_sales_cnt": bad("total_sales")}),
        (preference, {"ads_high_value_customer_preference_null_rank_cnt": F.col("sales_rank").isNull(), "ads_high_value_customer_preference_invalid_sales_cnt": bad("total_sales"), "ads_high_value_customer_preference_invalid_quantity_cnt": bad("total_quantity")}),
    ]
    parts = []
    for df, items in checks:
        row = df.agg(*[F.count_if(c).alias(n) for n, c in items.items()])
        parts.append(row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_item"), F.col(n).alias("abnormal_cnt")) for n in items])).alias("x")).select("x.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def dim_conflict_audit(dwd: DataFrame, product: DataFrame, history: DataFrame) -> DataFrame:
    """Products with several descriptions, customers with several countries, and totals of lines and dimensions.

    Long form: table_name, check_item, metric, value. Averages are over the keys in conflict, half up.
    """
    def long(df: DataFrame, table: str, item: str, **metrics: Column) -> DataFrame:
        row = df.agg(*[c.cast("decimal(18,2)").alias(n) for n, c in metrics.items()])
        parts = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])
        return row.select(F.lit(table).alias("table_name"), F.lit(item).alias("check_item"), F.explode(parts).alias("x")).select("table_name", "check_item", "x.*")

    def conflicts(table: str, item: str, key: str, value: str) -> DataFrame:
        g = dwd.where(~blank(key) & ~blank(value)).groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")
        return long(g, table, item, conflict_keys=F.count(F.lit(1)), max_values=F.max("n"), avg_values=ratio(F.sum("n"), F.count(F.lit(1))))

    rows, several = F.count(F.lit(1)), F.count_distinct
    parts = [
        conflicts("dwd_product", "multi_description_per_stockcode", "stockcode", "description"), conflicts("dwd_user", "multi_country_per_customer", "customerid", "country"),
        long(dwd.where(~blank("stockcode")), "dwd_product", "summary", total_rows=rows, unique_stockcodes=several("stockcode"), unique_descriptions=several("description")),
        long(dwd.where(~blank("customerid")), "dwd_user", "summary", total_rows=rows, unique_customers=several("customerid"), unique_countries=several("country")),
        long(product, "dim_product", "summary", total_rows=rows, unique_stockcodes=several("stockcode"), unique_descriptions=several("description")),
        long(history, "dim_user", "summary", total_versions=rows, current_versions=F.count_if("is_current"), unique_customers=several("customerid"), unique_countries=several("country")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dim_conflict_samples(dwd: DataFrame, key: str, value: str, n: int = 20) -> DataFrame:
    """The ``n`` keys with most values, and the values, which are gathered for those keys alone."""
    pairs = dwd.where(~blank(key) & ~blank(value)).select(key, value).distinct()
    top = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("value_cnt")).where("value_cnt > 1").orderBy(F.desc("value_cnt"), key).limit(n)
    g = pairs.join(F.broadcast(top), key).groupBy(key, "value_cnt").agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias("conflicting_values"))
    return g.select(key, "conflicting_values", "value_cnt").orderBy(F.desc("value_cnt"), key)


def dwd_normalization_profile(dwd: DataFrame) -> DataFrame:
    """One row: totals, and how many fields aren't in normal form."""
    loose = lambda c: F.count_if(F.col(c) != F.trim(c)).alias(f"{c}_with_whitespace")
    return dwd.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("invoice").alias("distinct_invoices"), F.count_distinct("customerid").alias("distinct_customers"), F.count_distinct("stockcode").alias("distinct_products"),
        F.sum("quantity").alias("total_quantity"), F.sum("amount").cast("decimal(28,2)").alias("total_amount"), *[loose(c) for c in ("invoice", "stockcode", "description", "country", "customerid")],
        F.count_if(F.col("customerid").rlike(r"\.0$")).alias("customerid_dot_zero"), F.count_if(F.col("customerid").rlike("^[0-9]+$")).alias("numeric_customerid"), F.count_if(~F.col("customerid").rlike("^[0-9]+$")).alias("other_customerid"),
        F.count_if(F.col("stockcode") == F.upper("stockcode")).alias("upper_stockcode"),
    )


def dwd_full_validation(dwd: DataFrame, derived: DataFrame, start_dt: str, end_dt: str) -> DataFrame:
    """One row comparing stored clean lines with those derived again from the typed layer."""
    d = dwd.agg(F.count(F.lit(1)).alias("dwd_rows"), F.count_distinct("dt").alias("dwd_dates"), F.sum("amount").cast("decimal(28,2)").alias("dwd_amount"), _counted(~F.col("dt").between(start_dt, end_dt), "outside_cnt"),
                _counted((F.col("invoice") != F.trim("invoice")) | (F.col("stockcode") != F.upper(F.trim("stockcode"))) | F.col("customerid").rlike(r"^[0-9]+\.0$"), "unnormalised_cnt"),
                _counted(F.col("amount") != F.round(F.col("quantity").cast("decimal(18,0)") * F.col("price"), 2), "amount_error_cnt"))
    e = derived.agg(F.count(F.lit(1)).alias("expected_rows"), F.count_distinct("dt").alias("expected_dates"), F.sum("amount").cast("decimal(28,2)").alias("expected_amount"))
    return _cross(d, e).withColumn("is_pass", F.expr("dwd_rows = expected_rows and dwd_dates = expected_dates and dwd_amount = expected_amount and outside_cnt = 0 and unnormalised_cnt = 0 and amount_error_cnt = 0"))


#: Marts of range validation: keys, and the column that adds up to the lines' sales, where there is one.
RANGE_MARTS = {
    "dws_customer_value": (["dt", "customerid"], "total_spent"), "dws_sales_summary": (["dt", "country"], "total_sales"), "ads_high_value_contribution": (["dt"], "total_sales"),
    "ads_level_distribution": (["dt", "customer_level"], "total_spent"), "ads_country_rank": (["dt", "country"], "total_sales"), "ads_high_value_preference": (["dt", "stockcode"], None),
}
#: Percentages of a mart: those of each row that must lie in 0 to 100, and those that must add up to 100 a date.
RANGE_SHARES = {"ads_high_value_contribution": ("sales_contribution_pct", None), "ads_level_distribution": (None, "customer_cnt_pct")}


def mart_range_validation(dwd: DataFrame, marts: dict[str, DataFrame]) -> DataFrame:
    """Gates over a range of dates: table_name, check_item, check_level, actual_value, expected_value, check_status.

    Lines and five marts must have rows; those marts must have as many dates as the lines and lack none of
    them, the preference mart is only warned of missing dates. Sales must agree with the lines', keys must be
    single, and shares must lie in range and add up. Every mart is read once, and combined by date.
    """
    number = "decimal(28,2)"
    base = dwd.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast(number).alias("sales"))
    none = F.lit(None).cast(number)
    parts = [base.select(F.lit("dwd_retail_clean").alias("table_name"), "dt", "rows", "sales", F.lit(0).cast("long").alias("doubled"), F.lit(0).cast("long").alias("off_row"), none.alias("shares"))]
    for name, (keys, value) in RANGE_MARTS.items():
        row, total = RANGE_SHARES.get(name, (None, None))
        off = F.count_if(F.col(row).isNull() | ~F.col(row).between(0, 100)) if row else F.lit(0).cast("long")
        g = marts[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.sum(value).cast(number) if value else none).alias("_v"), off.alias("_o"), (F.sum(total).cast(number) if total else none).alias("_p"))
        parts.append(g.groupBy("dt").agg(F.sum("_n").alias("rows"), F.sum("_v").cast(number).alias("sales"), F.count_if(F.col("_n") > 1).alias("doubled"), F.sum("_o").alias("off_row"), F.sum("_p").cast(number).alias("shares")).select(F.lit(name).alias("table_name"), "dt", "rows", "sales", "doubled", "off_row", "shares"))
    by_date = reduce(lambda a, b: a.unionByName(b), parts)
    # a date's rows of all tables meet, so that what a mart lacks is seen beside the lines
    tables = ["dwd_retail_clean", *RANGE_MARTS]
    met = by_date.groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("table_name", F.struct("rows", "sales", "doubled", "off_row", "shares")))).alias("m"))
    x = lambda n: F.col("m")[n]
    figures = [
        F.struct(
            F.lit(n).alias("t"), F.coalesce(F.sum(x(n)["rows"]), F.lit(0)).alias("rows"), F.count_if(x(n).isNotNull()).alias("dates"), F.count_if(x("dwd_retail_clean").isNotNull() & x(n).isNull()).alias("missing"),
            F.coalesce(F.sum(x(n)["sales"]), F.lit(0)).cast(number).alias("sales"), F.coalesce(F.sum(x(n)["doubled"]), F.lit(0)).alias("doubled"), F.coalesce(F.sum(x(n)["off_row"]), F.lit(0)).alias("off_row"),
            F.count_if(F.abs(x(n)["shares"] - 100) > 0.05).alias("off_date"),
        ).alias(f"f{i}")
        for i, n in enumerate(tables)
    ]
    one = met.agg(*figures)

    def check(i: int, item: str, lvl: str, actual: str, expected: Column, passes) -> Column:
        a = F.col(f"f{i}")[actual].cast(number)
        e = expected.cast(number)
        return F.struct(F.lit(tables[i]).alias("table_name"), F.lit(item).alias("check_item"), F.lit(lvl).alias("check_level"), a.alias("actual_value"), e.alias("expected_value"), F.when(passes(a, e), "PASS").otherwise("FAIL").alias("check_status"))

    some, equal, near = (lambda a, e: a >= e), (lambda a, e: a == e), (lambda a, e: F.abs(a - e) <= 0.01)
    zero, lines = F.lit(0), F.col("f0")
    checks = [check(0, "non_empty", BLOCK, "rows", F.lit(1), some)]
    for i, (name, (_, value)) in enumerate(RANGE_MARTS.items(), 1):
        lvl = BLOCK if value else WARN
        row, total = RANGE_SHARES.get(name, (None, None))
        checks += [check(i, "non_empty", lvl, "rows", F.lit(1), some), check(i, "date_count", lvl, "dates", lines["dates"], equal), check(i, "missing_dates", lvl, "missing", zero, equal), check(i, "doubled_keys", BLOCK, "doubled", zero, equal)]
        checks += [check(i, "sales_match_lines", BLOCK, "sales", lines["sales"], near)] if value else []
        checks += [check(i, "share_in_range", BLOCK, "off_row", zero, equal)] if row else []
        checks += [check(i, "shares_add_up", BLOCK, "off_date", zero, equal)] if total else []
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def alltime_quality_rules(clean: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """Twenty named checks of the all-time results: check_order, check_name, actual_value, expected_rule, is_pass.

    ``results`` maps each result's name to its rows in order; the top-10 products must have ten, the others some.
    """
    base = clean.agg(F.count_if(F.col("quantity") <= 0).alias("dwd_abnormal_quantity"), F.count_if(F.col("price") <= 0).alias("dwd_abnormal_price"), F.count_if(F.col("customerid").isNull()).alias("dwd_null_customer"), F.count_if(F.upper(F.trim("invoice")).startswith("C")).alias("dwd_return_order"))
    level = results["customer_value"].agg(F.count_if(F.col("customer_level").isNull()).alias("dws_null_customer_level"))
    zero = [*base.columns, *level.columns]
    rows = _cross(base, level).select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("check_order"), F.lit(n).alias("check_name"), F.col(n).alias("actual_value"), F.lit("= 0").alias("expected_rule"), (F.col(n) == 0).alias("is_pass")) for i, n in enumerate(zero)])).alias("x")).select("x.*")
    parts = [rows]
    for i, (name, df) in enumerate((n, d) for n, d in results.items() if n != "customer_value"):
        exact = name == "top10_products"
        n = F.col("actual_value")
        parts.append(df.agg(F.count(F.lit(1)).alias("actual_value")).select(F.lit(i + 6).alias("check_order"), F.lit(f"ads_{name}_row_count" if exact else f"ads_{name}_nonempty").alias("check_name"), "actual_value", F.lit("= 10" if exact else "> 0").alias("expected_rule"), ((n == 10) if exact else (n > 0)).alias("is_pass")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def alltime_quality_summary(rules: DataFrame) -> DataFrame:
    """One row: overall status and the names of failed checks in order."""
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_pass"), F.struct("check_order", "check_name")))), lambda x: x["check_name"]), ",")
    return rules.agg(F.count(F.lit(1)).alias("check_cnt"), F.count_if(~F.col("is_pass")).alias("failed_cnt"), failed.alias("failed_checks")).withColumn("overall_status", F.when(F.col("failed_cnt") == 0, "PASS").otherwise("FAIL"))


def row_hashes(df: DataFrame, method: str = "md5") -> tuple[Column, Column]:
    """Sums over ``df`` of a hash of each row's text and of the reverse: columns by name, nulls as <NULL>.

    ``method`` is md5 (first eight hex digits) or crc32. The sums of two sets of rows add up to that of both.
    """
    row = F.concat_ws("#|#", *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in sorted(df.columns)])

    def total(s: Column) -> Column:
        h = F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") if method == "md5" else F.crc32(s)
        # 32 bits in two halves, whose sums fit a long up to 2^47 rows: decimals are added far more slowly
        high, low = F.sum(F.shiftright(h, 16)), F.sum(h.bitwiseAND(F.lit(0xFFFF)))
        return F.coalesce(high.cast("decimal(20,0)") * 65536 + low, F.lit(0)).cast("decimal(38,0)")

    return total(row), total(F.reverse(row))


def table_fingerprint(tables: dict[str, DataFrame], method: str = "md5") -> DataFrame:
    """Order-free fingerprint of each table: rows, and the sums of ``row_hashes``."""
    parts = []
    for name, t in sorted(tables.items()):
        forward, backward = row_hashes(t, method)
        parts.append(t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_cnt"), forward.alias("hash_sum"), backward.alias("reverse_hash_sum")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def reconcile_tables(left: DataFrame, right: DataFrame, key: str, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Differences by key: diff_kind (missing_left, missing_right, doubled_key or mismatch), column_name, left_value, right_value."""
    def single(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{side}"), *[F.first(c).alias(f"{side}_{c}") for c in columns])

    j = single(left, "l").join(single(right, "r"), key, "full_outer")

    def differs(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        if not tolerance:
            return ~a.eqNullSafe(b)
        near = F.abs(a.cast("decimal(38,6)") - b.cast("decimal(38,6)")) <= tolerance
        return ~F.coalesce(near, a.isNull() & b.isNull())

    none = F.lit(None).cast("string")
    def diff(when: Column, kind: str, column, a=none, b=none) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("diff_kind"), column.alias("column_name"), a.alias("left_value"), b.alias("right_value")))

    both = F.col("_nl").isNotNull() & F.col("_nr").isNotNull()
    found = [diff(F.col("_nl").isNull(), "missing_left", none), diff(F.col("_nr").isNull(), "missing_right", none), diff((F.col("_nl") > 1) | (F.col("_nr") > 1), "doubled_key", none)]
    found += [diff(both & differs(c), "mismatch", F.lit(c), F.col(f"l_{c}").cast("string"), F.col(f"r_{c}").cast("string")) for c in columns]
    return j.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def batch_status(log: DataFrame) -> DataFrame:
    """Status of each batch by its log lines: failed before success before running."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = log.groupBy("batch_id").agg(n("START").alias("start_cnt"), n("SUCCESS").alias("success_cnt"), n("FAILED").alias("failed_cnt"))
    return g.withColumn("batch_status", F.when(F.col("failed_cnt") > 0, "FAILED").when(F.col("success_cnt") > 0, "SUCCESS").when(F.col("start_cnt") > 0, "RUNNING").otherwise("NOT_FOUND"))
