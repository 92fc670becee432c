"""The queries in DuckDB's SQL, written apart from the operators; shares are in whole numbers, rounded half up."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Parameters of registered queries.
BATCH, DAY, START, END = "2026-04-08", "1998-06-30", "1998-01-01", "1999-12-31"
FIRST_DAY, LAST_DAY, EXPECTED_RAW = "1995-01-01", "2001-08-01", 60000
DAY_BEFORE, APPENDED = "1998-06-29", 5
LATE_DAYS = ("1996-03-04", "1996-03-05", "1998-06-30")
GATE_DAYS = ("1998-06-26", "1998-06-27", "1998-06-28", "1998-06-29", "1998-06-30")
GUARD_DAYS = ("1998-06-29", "1998-07-01", "1998-07-05")
ALLTIME_RESULTS = (
    "top10_products", "repeat_purchase_summary", "monthly_sales_trend", "monthly_growth", "high_value_customers", "country_rank_alltime", "customer_revenue_concentration", "country_value_analysis",
    "level_distribution_alltime", "product_sales_concentration", "customer_order_stats", "high_value_preference_alltime", "high_value_order_frequency", "high_value_country_distribution", "high_value_contribution_alltime",
)


def source_of(dt: str) -> Column:
    """Source tag of a day in the registered serving queries."""
    return F.when(F.col(dt).like("%4"), "other_source").otherwise("retail_canonical")


def q(n: str, d: str, kind: str = "DECIMAL(18,2)") -> str:
    """n/d of whole numbers, rounded half up, as hundredths."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    pos = f"(2*({n})+({d}))//(2*({d}))"
    neg = f"-((2*(-({n}))+({d}))//(2*({d})))"
    return f"(CASE WHEN ({d}) = 0 THEN NULL ELSE CAST(CAST(CASE WHEN ({n}) >= 0 THEN {pos} ELSE {neg} END AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS {kind}) END)"


def c(x: str) -> str:
    return f"CAST(({x})*100 AS HUGEINT)"


def avg(sales: str, n: str, kind: str = "DECIMAL(18,2)") -> str:
    return q(c(sales), n, kind)


def share(a: str, b: str, kind: str = "DECIMAL(18,2)") -> str:
    """Per cent of sales."""
    return q(f"{c(a)}*10000", c(b), kind)


def part(a: str, b: str, kind: str = "DECIMAL(18,2)") -> str:
    """Per cent of counts."""
    return q(f"({a})::HUGEINT*10000", b, kind)


def per(a: str, b: str, kind: str = "DECIMAL(18,2)") -> str:
    return q(f"({a})::HUGEINT*100", b, kind)


def level(x: str) -> str:
    return f"CASE WHEN {x} >= 5000 THEN 'High Value' WHEN {x} >= 1000 THEN 'Medium Value' ELSE 'Low Value' END"


_TEXTS = ("invoice", "stockcode", "description", "quantity", "invoicedate", "price", "customerid", "country")
_ISO = "strftime(od, '%Y-%m-%d') || ' ' || lpad(hh::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0')"
_DMY = "day(od) || '/' || month(od) || '/' || year(od) || ' ' || hh || ':' || lpad(mi::VARCHAR, 2, '0')"
_SEC = " || ':' || lpad(ss::VARCHAR, 2, '0')"
_TS = "COALESCE(" + ", ".join(f"TRY_STRPTIME(trim(invoicedate), '{f}')" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M")) + ")"
_Q = "CASE WHEN regexp_full_match(trim(quantity), '[+-]?[0-9]+') THEN TRY_CAST(trim(quantity) AS BIGINT) END"
_P = r"CASE WHEN regexp_full_match(trim(price), '[+-]?[0-9]+(\.[0-9]+)?') THEN TRY_CAST(trim(price) AS DECIMAL(10,2)) END"
_AMOUNT = "CAST(round(quantity::DECIMAL(18,0) * price, 2) AS DECIMAL(12,2))"
_OK = " AND ".join(["quantity > 0", "price > 0", *[f"coalesce(trim({x}), '') <> ''" for x in ("customerid", "invoice", "stockcode", "country", "invoicedate")], "upper(trim(invoice)) NOT LIKE 'C%'"])
_S2 = "CAST(sum(amount) AS DECIMAL(18,2))"
_PRODUCTS = [("total_rows", "count(*)"), ("unique_stockcodes", "count(DISTINCT stockcode)"), ("unique_descriptions", "count(DISTINCT description)")]
_PEOPLE = [("unique_customers", "count(DISTINCT customerid)"), ("unique_countries", "count(DISTINCT country)")]

V: dict[str, str] = {
    "base": """SELECT l.l_orderkey k, l.l_linenumber::BIGINT ln, l.l_partkey pk, l.l_suppkey sk, l.l_returnflag rf, l.l_quantity::BIGINT qty, round(l.l_extendedprice*100)::BIGINT // l.l_quantity::BIGINT // 40 unit,
      o.o_custkey ck, o.o_orderdate od, p.p_name, n.n_name, 8 + l.l_linenumber hh, l.l_partkey % 60 mi, l.l_suppkey % 60 ss
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
      JOIN nation n ON n.n_nationkey = (c.c_nationkey + CASE WHEN o.o_custkey % 5 = 0 AND year(o.o_orderdate) >= 1998 THEN 1 ELSE 0 END) % 25""",
    "retail": f"""SELECT CASE WHEN k % 17 = 0 THEN ' ' ELSE '' END || CASE WHEN rf = 'R' AND k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'C' ELSE 'c' END ELSE '' END || k AS invoice,
      CASE WHEN (pk + sk) % 173 = 0 THEN '' WHEN pk % 13 = 0 THEN ' p' || pk || ' ' WHEN pk % 2 = 0 THEN 'p' || pk ELSE 'P' || pk END AS stockcode,
      CASE WHEN (sk + ln) % 11 = 0 THEN ' ' WHEN sk % 3 = 0 THEN p_name || ' v2' ELSE p_name END AS description,
      CASE WHEN (k + ln) % 181 = 0 THEN '' WHEN (k + ln) % 199 = 0 THEN 'x' WHEN (k + ln) % 229 = 0 THEN '3.7' WHEN (k + ln) % 193 = 0 THEN '0' WHEN rf = 'R' AND k % 3 = 0 THEN '-' || qty ELSE qty::VARCHAR END AS quantity,
      CASE WHEN (k + sk) % 397 = 0 THEN '' WHEN (k + sk) % 401 = 0 THEN 'garbage' WHEN (k + sk) % 409 = 0 THEN '31/2/2010 08:26' WHEN k % 4 = 0 THEN {_ISO}{_SEC} WHEN k % 4 = 1 THEN {_ISO} WHEN k % 4 = 2 THEN {_DMY}{_SEC} ELSE {_DMY} END AS invoicedate,
      CASE WHEN (k * 7 + ln) % 211 = 0 THEN '' WHEN (k * 7 + ln) % 223 = 0 THEN 'abc' WHEN (k + pk) % 197 = 0 THEN '0.00' ELSE (unit // 100)::VARCHAR || '.' || lpad((unit % 100)::VARCHAR, 2, '0') END AS price,
      CASE WHEN (ck + k) % 163 = 0 THEN '' WHEN k % 5 = 0 THEN ck || '.0' ELSE ck::VARCHAR END AS customerid,
      CASE WHEN (k + ln) % 179 = 0 THEN '' ELSE n_name END AS country FROM base""",
    "read_retail_csv": "SELECT * FROM retail",
    "ods_raw": f"SELECT *, '{BATCH}' AS batch_dt FROM retail",
    "parsed": f"SELECT *, {_TS} AS ts, {_Q} AS pq, {_P} AS pp FROM ods_raw",
    "parse_invoice_ts": "SELECT invoicedate, ts AS invoice_ts, count(*) AS row_cnt FROM parsed GROUP BY ALL",
    "parse_quantity": "SELECT quantity, pq AS parsed_quantity, count(*) AS row_cnt FROM parsed GROUP BY ALL",
    "parse_price": "SELECT price, pp AS parsed_price, count(*) AS row_cnt FROM parsed GROUP BY ALL",
    "ods_typed": "SELECT invoice, stockcode, description, pq AS quantity, invoicedate, pp AS price, customerid, country, strftime(ts, '%Y-%m-%d') AS dt FROM parsed WHERE ts IS NOT NULL AND pq IS NOT NULL AND pp IS NOT NULL",
    "ods_reject": f"""SELECT {', '.join(_TEXTS)}, parsed_bizdate, code AS reject_code, CASE code WHEN 'EMPTY_INVOICE_DATE' THEN 'invoice date is empty' WHEN 'DATE_PARSE_FAILED' THEN 'invoice date fits none of the four formats' WHEN 'EMPTY_QUANTITY' THEN 'quantity is empty'
      WHEN 'QUANTITY_PARSE_FAILED' THEN 'quantity is not a whole number' WHEN 'EMPTY_PRICE' THEN 'price is empty' ELSE 'price is not a decimal(10,2)' END AS reject_reason, batch_dt FROM
      (SELECT *, strftime(ts, '%Y-%m-%d') AS parsed_bizdate, CASE WHEN coalesce(trim(invoicedate), '') = '' THEN 'EMPTY_INVOICE_DATE' WHEN ts IS NULL THEN 'DATE_PARSE_FAILED' WHEN coalesce(trim(quantity), '') = '' THEN 'EMPTY_QUANTITY' WHEN pq IS NULL THEN 'QUANTITY_PARSE_FAILED'
      WHEN coalesce(trim(price), '') = '' THEN 'EMPTY_PRICE' WHEN pp IS NULL THEN 'PRICE_PARSE_FAILED' END AS code FROM parsed) WHERE code IS NOT NULL""",
    "dwd_clean": f"""SELECT trim(invoice) AS invoice, upper(trim(stockcode)) AS stockcode, trim(description) AS description, quantity, strftime({_TS}, '%Y-%m-%d %H:%M:%S') AS invoicedate, price,
      regexp_replace(trim(customerid), '^([0-9]+)\\.0$', '\\1') AS customerid, trim(country) AS country, {_AMOUNT} AS amount, dt FROM ods_typed WHERE {_OK}""",
    "clean_simple": f"SELECT * REPLACE (strftime({_TS}, '%Y-%m-%d %H:%M:%S') AS invoicedate), {_AMOUNT} AS amount FROM ods_typed WHERE quantity > 0 AND price > 0 AND customerid IS NOT NULL AND upper(trim(invoice)) NOT LIKE 'C%'",
    "business_dates": f"SELECT DISTINCT dt FROM dwd_clean WHERE dt BETWEEN '{START}' AND '{END}'",
    "t1_window": f"SELECT DISTINCT dt FROM dwd_clean WHERE dt IN ('{DAY}', strftime(DATE '{DAY}' - INTERVAL 1 DAY, '%Y-%m-%d'))",
    "dataset_profile": f"SELECT count(*) AS row_count, count(ts) AS parseable, count(*) FILTER (ts IS NULL) AS unparseable, strftime(min(ts), '%Y-%m-%d') AS min_date, strftime(max(ts), '%Y-%m-%d') AS max_date FROM (SELECT {_TS} AS ts FROM retail)",
    "replicate_dataset": f"""SELECT {', '.join(f'{x}' for x in _TEXTS if x != 'invoicedate')}, strftime({_TS} + to_years(CAST(n - 1 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS invoicedate FROM retail, range(1, 3) r(n) WHERE {_TS} IS NOT NULL""",
    "replicate_dataset_unshifted": f"""SELECT {', '.join(_TEXTS)}, md5(concat_ws('|', {', '.join(f"coalesce({x}, '<NULL>')" for x in _TEXTS)})) AS source_row_id, CAST(n AS INTEGER) AS source_copy_id
      FROM (SELECT {', '.join(f'trim({x}) AS {x}' for x in _TEXTS)} FROM retail), range(1, 4) r(n)""",
    "replicate_dataset_parseable": f"""SELECT {', '.join(f'{x}' for x in _TEXTS if x != 'invoicedate')}, strftime({_TS} + to_years(CAST((n - 1) * 2 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS invoicedate, md5(concat_ws('|', {', '.join(f"coalesce({x}, '<NULL>')" for x in _TEXTS)})) AS source_row_id, CAST(n AS INTEGER) AS source_copy_id
      FROM (SELECT {', '.join(f'trim({x}) AS {x}' for x in _TEXTS)} FROM retail WHERE {_TS} IS NOT NULL), range(1, 4) r(n)""",
    "dws_customer_value": f"SELECT customerid, count(DISTINCT invoice) AS order_count, CAST(sum(amount) AS DECIMAL(12,2)) AS total_spent, {level('sum(amount)')} AS customer_level, dt FROM dwd_clean GROUP BY dt, customerid",
    "dws_sales_summary": f"SELECT country, count(DISTINCT invoice) AS total_orders, count(DISTINCT customerid) AS total_customers, CAST(sum(amount) AS DECIMAL(14,2)) AS total_sales, {avg('sum(amount)', 'count(DISTINCT invoice)', 'DECIMAL(14,2)')} AS avg_order_value, dt FROM dwd_clean GROUP BY dt, country",
    "dws_sales_summary_salted": "SELECT * FROM dws_sales_summary",
    "high_lines": "SELECT d.* FROM dwd_clean d JOIN dws_customer_value v USING (dt, customerid) WHERE v.customer_level = 'High Value'",
    "ads_high_value_contribution": f"""SELECT coalesce(h.n, 0) AS high_value_customer_cnt, coalesce(h.o, 0) AS high_value_order_cnt, CAST(coalesce(h.s, 0) AS DECIMAL(14,2)) AS high_value_total_sales, CAST(t.s AS DECIMAL(14,2)) AS total_sales,
      coalesce({share('h.s', 't.s', 'DECIMAL(10,2)')}, 0)::DECIMAL(10,2) AS sales_contribution_pct, coalesce({avg('h.s', 'h.n', 'DECIMAL(14,2)')}, 0)::DECIMAL(14,2) AS avg_sales_per_customer, coalesce({per('h.o', 'h.n', 'DECIMAL(10,2)')}, 0)::DECIMAL(10,2) AS avg_orders_per_customer, t.dt
      FROM (SELECT dt, sum(amount) s FROM dwd_clean GROUP BY dt) t LEFT JOIN (SELECT dt, sum(amount) s, count(DISTINCT customerid) n, count(DISTINCT invoice) o FROM high_lines GROUP BY dt) h USING (dt)""",
    "ads_level_distribution": f"""SELECT customer_level, n AS customer_cnt, CAST(s AS DECIMAL(14,2)) AS total_spent, {part('n', 'tn', 'DECIMAL(10,2)')} AS customer_cnt_pct, {share('s', 'ts', 'DECIMAL(10,2)')} AS sales_pct, dt
      FROM (SELECT dt, customer_level, count(*) n, sum(total_spent) s FROM dws_customer_value GROUP BY ALL) JOIN (SELECT dt, count(*) tn, sum(total_spent) ts FROM dws_customer_value GROUP BY ALL) USING (dt)""",
    "ads_country_rank": "SELECT country, rank() OVER (PARTITION BY dt ORDER BY total_sales DESC) AS sales_rank, total_orders, total_customers, total_sales, avg_order_value, dt FROM dws_sales_summary",
    "ads_high_value_preference": """SELECT g.*, rank() OVER (PARTITION BY dt ORDER BY total_sales DESC) AS sales_rank FROM (SELECT dt, stockcode, any_value(d.description) AS description, count(DISTINCT customerid) AS high_value_customer_cnt, count(DISTINCT invoice) AS high_value_order_cnt,
      CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(amount) AS DECIMAL(14,2)) AS total_sales FROM high_lines JOIN (SELECT dt, stockcode, description FROM (SELECT *, row_number() OVER (PARTITION BY dt, stockcode ORDER BY coalesce(trim(description), '') = '', invoicedate DESC, description DESC) rn FROM high_lines) WHERE rn = 1) d USING (dt, stockcode) GROUP BY dt, stockcode) g""",
    "ads_sales_overview": f"SELECT {_S2} AS total_sales, count(DISTINCT invoice) AS total_orders, count(DISTINCT customerid) AS total_customers, CAST(sum(quantity) AS BIGINT) AS total_quantity, {avg('sum(amount)', 'count(DISTINCT invoice)')} AS avg_order_value, dt FROM dwd_clean GROUP BY dt",
    "lagged": "SELECT *, lag(dt) OVER w AS pdt, lag(total_sales) OVER w AS ps, lag(total_orders) OVER w AS po, lag(total_customers) OVER w AS pc, lag(total_quantity) OVER w AS pqy FROM ads_sales_overview WINDOW w AS (ORDER BY dt)",
    "fractions": f"SELECT *, {c('total_sales')} s, {c('ps')} p, total_orders::HUGEINT o, po::HUGEINT q, total_customers::HUGEINT cu, pc::HUGEINT qc, total_quantity::HUGEINT qy, pqy::HUGEINT qq FROM lagged",
    "ads_sales_anomaly": f"""SELECT total_sales, total_orders, total_customers, total_quantity, avg_order_value, pdt AS prev_dt, ps AS prev_sales, {q('(s-p)*10000', 'p')} AS sales_change_pct, CAST(ps - total_sales AS DECIMAL(18,2)) AS sales_loss_amount,
      {q('(o-q)*10000', 'q')} AS orders_change_pct, {q('(cu-qc)*10000', 'qc')} AS customers_change_pct, {q('(qy-qq)*10000', 'qq')} AS quantity_change_pct, {q('(s*q-p*o)*10000', 'o*p')} AS aov_change_pct,
      CASE WHEN pdt IS NULL THEN 'NOT_EVALUATED' WHEN (s-p)*100 <= -50*p AND p-s >= 3000000 AND ((o-q)*100 <= -40*q OR (cu-qc)*100 <= -40*qc OR (qy-qq)*100 <= -40*qq OR (s*q-p*o)*100 <= -40*o*p) THEN 'HIGH'
      WHEN (s-p)*100 <= -40*p AND p-s >= 2000000 THEN 'MEDIUM' ELSE 'NORMAL' END AS anomaly_level, CASE WHEN pdt IS NULL THEN NULL WHEN (o-q)*o*p <= (s*q-p*o)*q THEN 'ORDERS' ELSE 'AVG_ORDER_VALUE' END AS primary_driver, dt FROM fractions""",
    "bi_export_long": """SELECT dt, 'High Value Sales Contribution Pct' AS metric_name, CAST(max(sales_contribution_pct) AS DECIMAL(18,2)) AS metric_value FROM ads_high_value_contribution GROUP BY dt
      UNION ALL SELECT dt, 'Total Customer Count', CAST(sum(customer_cnt) AS DECIMAL(18,2)) FROM ads_level_distribution GROUP BY dt UNION ALL SELECT dt, 'Total Sales', CAST(sum(total_sales) AS DECIMAL(18,2)) FROM ads_country_rank GROUP BY dt""",
    "target": f"SELECT *, 'retail_canonical' AS source_system FROM ads_sales_overview WHERE dt <= '{END}'",
    "incoming": f"SELECT * REPLACE (CAST(total_sales + 1 AS DECIMAL(18,2)) AS total_sales), 'retail_canonical' AS source_system FROM ads_sales_overview WHERE dt >= '{START}'",
    "serving_upsert": "SELECT * FROM incoming UNION ALL SELECT * FROM target WHERE dt NOT IN (SELECT dt FROM incoming)",
    "serving": "SELECT *, CASE WHEN dt LIKE '%4' THEN 'other_source' ELSE 'retail_canonical' END AS source_system FROM ads_sales_overview",
    "overview_by_date": f"SELECT * FROM serving WHERE dt = '{DAY}'",
    "overview_trend": f"SELECT * FROM serving WHERE dt BETWEEN '{DAY[:8]}01' AND '{DAY[:8]}30'",
    "overview_comparison": f"""SELECT dt, source_system, pdt AS prev_dt, pdt IS NOT NULL AS available, {q(f"({c('total_sales')}-{c('ps')})*10000", c('ps'))} AS sales_change_pct, {q('(total_orders-po)::HUGEINT*10000', 'po')} AS orders_change_pct, {q('(total_customers-pc)::HUGEINT*10000', 'pc')} AS customers_change_pct,
      {q('(total_quantity-pqy)::HUGEINT*10000', 'pqy')} AS quantity_change_pct, {q(f"({c('avg_order_value')}-{c('pa')})*10000", c('pa'))} AS aov_change_pct FROM (SELECT *, lag(dt) OVER w pdt, lag(total_sales) OVER w ps, lag(total_orders) OVER w po, lag(total_customers) OVER w pc, lag(total_quantity) OVER w pqy, lag(avg_order_value) OVER w pa FROM serving WINDOW w AS (PARTITION BY source_system ORDER BY dt))""",
    "anomaly_list": f"SELECT *, 'retail_canonical' AS source_system FROM ads_sales_anomaly WHERE anomaly_level IN ('MEDIUM', 'HIGH') AND dt NOT LIKE '%4' AND dt BETWEEN '{START}' AND '{END}'",
    # all-time analytics
    "kpi_summary": f"SELECT {_S2} AS total_sales, count(DISTINCT invoice) AS total_orders, count(DISTINCT customerid) AS total_customers, {avg('sum(amount)', 'count(DISTINCT invoice)')} AS avg_order_value, {avg('sum(amount)', 'count(DISTINCT customerid)')} AS avg_customer_value FROM clean_simple",
    "top_products_by_sales": f"SELECT stockcode, description, {_S2} AS total FROM clean_simple GROUP BY ALL ORDER BY total DESC, stockcode, description LIMIT 10",
    "top_products_by_quantity": "SELECT stockcode, description, CAST(sum(quantity) AS BIGINT) AS total FROM clean_simple GROUP BY ALL ORDER BY total DESC, stockcode, description LIMIT 10",
    "top_products_by_avg_price": f"SELECT stockcode, description, {avg('sum(price)', 'count(price)')} AS total FROM clean_simple GROUP BY stockcode, description ORDER BY total DESC, stockcode, description LIMIT 10",
    "customer_order_stats": f"SELECT customerid, count(DISTINCT invoice) AS order_count, {_S2} AS total_spent FROM clean_simple GROUP BY customerid",
    "top_customers_by_spend": "SELECT customerid, total_spent FROM customer_order_stats ORDER BY total_spent DESC, customerid LIMIT 10",
    "top_customers_by_orders": "SELECT customerid, order_count FROM customer_order_stats ORDER BY order_count DESC, customerid LIMIT 10",
    "top_customers_by_avg_order": f"SELECT customerid, {avg('total_spent', 'order_count')} AS avg_order_value FROM customer_order_stats ORDER BY avg_order_value DESC, customerid LIMIT 10",
    "country_sales": f"SELECT country, {_S2} AS total_sales FROM clean_simple GROUP BY country",
    "country_customers": "SELECT country, count(DISTINCT customerid) AS customer_cnt FROM clean_simple GROUP BY country",
    "monthly_sales_trend": f"SELECT substr(dt, 1, 7) AS month, {_S2} AS monthly_sales, count(DISTINCT invoice) AS monthly_orders, count(DISTINCT customerid) AS monthly_customers FROM clean_simple GROUP BY 1",
    "monthly_sales": "SELECT month, monthly_sales FROM monthly_sales_trend",
    "monthly_orders": "SELECT month, monthly_orders FROM monthly_sales_trend",
    "customer_rank": "SELECT customerid, total_spent, rank() OVER (ORDER BY total_spent DESC) AS spend_rank FROM customer_order_stats",
    "top_customer_per_country": f"SELECT country, customerid, total_spent FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY total_spent DESC, customerid) rn FROM (SELECT country, customerid, {_S2} AS total_spent FROM clean_simple GROUP BY ALL)) WHERE rn = 1",
    "customer_cumulative_spend": "SELECT customerid, invoice, stockcode, invoicedate, amount, CAST(sum(amount) OVER (PARTITION BY customerid ORDER BY invoicedate) AS DECIMAL(18,2)) AS cumulative_spent FROM clean_simple",
    "repeat_purchase_summary": f"SELECT count(*) AS total_customers, count(*) FILTER (order_count > 1) AS repeat_customers, {part('count(*) FILTER (order_count > 1)', 'count(*)')} AS repeat_rate_pct FROM customer_order_stats",
    "monthly_growth": f"SELECT month, monthly_sales, p AS prev_month_sales, CAST(monthly_sales - p AS DECIMAL(18,2)) AS growth_amt, {share('monthly_sales - p', 'p')} AS growth_rate_pct FROM (SELECT month, monthly_sales, lag(monthly_sales) OVER (ORDER BY month) p FROM monthly_sales_trend)",
    "customer_value_alltime": f"SELECT customerid, order_count, total_spent, {level('total_spent')} AS customer_level FROM customer_order_stats",
    "sales_summary_alltime": f"SELECT country, count(DISTINCT invoice) AS total_orders, count(DISTINCT customerid) AS total_customers, {_S2} AS total_sales, {avg('sum(amount)', 'count(DISTINCT invoice)')} AS avg_order_value FROM clean_simple GROUP BY country",
    "customer_level_counts": "SELECT customer_level, count(*) AS customer_cnt FROM customer_value_alltime GROUP BY 1",
    "monthly_top3_countries": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY total_sales DESC, country) AS rn FROM (SELECT substr(dt, 1, 7) AS month, country, {_S2} AS total_sales FROM clean_simple GROUP BY ALL)) WHERE rn <= 3",
    "country_rank_alltime": "SELECT country, total_orders, total_customers, total_sales, rank() OVER (ORDER BY total_sales DESC) AS sales_rank FROM sales_summary_alltime",
    "high_value_customers": "SELECT * FROM customer_value_alltime WHERE customer_level = 'High Value'",
    "top10_products": f"SELECT stockcode, description, CAST(sum(quantity) AS BIGINT) AS total_qty, {_S2} AS total_sales FROM clean_simple GROUP BY ALL ORDER BY total_sales DESC, stockcode, description LIMIT 10",
    "country_value_analysis": f"SELECT *, {avg('total_sales', 'total_customers')} AS avg_customer_value, {per('total_orders', 'total_customers')} AS avg_orders_per_customer FROM sales_summary_alltime",
    "level_distribution_alltime": f"SELECT customer_level, n AS customer_cnt, CAST(s AS DECIMAL(18,2)) AS total_spent, {part('n', 'tn')} AS customer_cnt_pct, {share('s', 'ts')} AS sales_pct FROM (SELECT customer_level, count(*) n, sum(total_spent) s FROM customer_value_alltime GROUP BY 1), (SELECT count(*) tn, sum(total_spent) ts FROM customer_value_alltime)",
    "high_simple": "SELECT s.* FROM clean_simple s JOIN customer_value_alltime v USING (customerid) WHERE v.customer_level = 'High Value'",
    "high_value_preference_alltime": f"SELECT stockcode, description, count(DISTINCT customerid) AS high_value_customer_cnt, count(DISTINCT invoice) AS high_value_order_cnt, CAST(sum(quantity) AS BIGINT) AS total_quantity, {_S2} AS total_sales FROM high_simple GROUP BY ALL ORDER BY high_value_customer_cnt DESC, total_sales DESC, stockcode, description LIMIT 20",
    "high_value_country_distribution": f"SELECT *, {avg('total_sales', 'high_value_customer_cnt')} AS avg_sales_per_customer, {per('high_value_order_cnt', 'high_value_customer_cnt')} AS avg_orders_per_customer FROM (SELECT country, count(DISTINCT customerid) AS high_value_customer_cnt, count(DISTINCT invoice) AS high_value_order_cnt, {_S2} AS total_sales FROM high_simple GROUP BY country)",
    "high_value_contribution_alltime": f"SELECT n AS high_value_customer_cnt, o AS high_value_order_cnt, CAST(coalesce(h, 0) AS DECIMAL(18,2)) AS high_value_total_sales, CAST(t AS DECIMAL(18,2)) AS total_sales, {share('h', 't')} AS sales_contribution_pct, {avg('h', 'n')} AS avg_sales_per_customer, {per('o', 'n')} AS avg_orders_per_customer FROM (SELECT count(DISTINCT customerid) n, count(DISTINCT invoice) o, sum(amount) h FROM high_simple), (SELECT sum(amount) t FROM clean_simple)",
    # star
    "daily_customer_country": "SELECT dt, customerid, country FROM (SELECT *, row_number() OVER (PARTITION BY dt, customerid ORDER BY invoicedate DESC, country) rn FROM dwd_clean) WHERE rn = 1",
    "opened": "SELECT * FROM (SELECT *, lag(country) OVER (PARTITION BY customerid ORDER BY dt) AS pc FROM daily_customer_country) WHERE pc IS DISTINCT FROM country",
    "scd2_history": "SELECT md5(customerid || '|' || country || '|' || dt) AS user_id, customerid, country, CAST(dt AS DATE) AS start_date, coalesce(CAST(CAST(nx AS DATE) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS end_date, nx IS NULL AS is_current FROM (SELECT *, lead(dt) OVER (PARTITION BY customerid ORDER BY dt) AS nx FROM opened)",
    "scd2_snapshot": f"""SELECT md5(customerid || '|' || country || '|' || dt) AS user_id, customerid, country, CAST(dt AS DATE) AS start_date, coalesce(CAST(CAST(nx AS DATE) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS end_date, nx IS NULL AS is_current, '{DAY}' AS dt
      FROM (SELECT *, lead(dt) OVER (PARTITION BY customerid ORDER BY dt) AS nx FROM opened WHERE dt <= '{DAY}')""",
    "dim_product": "SELECT md5(stockcode) AS product_id, stockcode, description, dt FROM (SELECT *, row_number() OVER (PARTITION BY dt, stockcode ORDER BY coalesce(trim(description), '') = '', invoicedate DESC, description DESC) rn FROM dwd_clean) WHERE rn = 1",
    "dim_geo": "SELECT DISTINCT md5(country) AS geo_id, country, dt FROM dwd_clean WHERE coalesce(trim(country), '') <> ''",
    "dim_date": "SELECT d AS date_id, dt AS date_str, year(d)::INTEGER AS year_num, month(d)::INTEGER AS month_num, day(d)::INTEGER AS day_num, ceil(month(d) / 3.0)::INTEGER AS quarter_num, week(d)::INTEGER AS weekofyear_num, dayofweek(d) IN (0, 6) AS is_weekend, dt FROM (SELECT DISTINCT dt, CAST(dt AS DATE) d FROM dwd_clean)",
    "fact_order": """SELECT md5(concat_ws('|', b.invoice, b.customerid, b.country, b.stockcode, b.dt, b.quantity, b.amount, b.seq)) AS order_line_id, b.invoice AS order_id, u.user_id, p.product_id, d.date_id, g.geo_id, b.quantity, b.amount, b.dt
      FROM (SELECT *, row_number() OVER (PARTITION BY invoice, customerid, country, stockcode, dt, quantity, amount) AS seq FROM dwd_clean) b JOIN scd2_history u ON b.customerid = u.customerid AND CAST(b.dt AS DATE) BETWEEN u.start_date AND u.end_date
      JOIN dim_product p ON b.stockcode = p.stockcode AND b.dt = p.dt JOIN dim_date d ON b.dt = d.dt JOIN dim_geo g ON b.country = g.country AND b.dt = g.dt""",
    "dws_customer_value_star": f"SELECT user_id, count(DISTINCT order_id) AS total_orders, CAST(sum(amount) AS DECIMAL(14,2)) AS total_amount, {level('sum(amount)')} AS customer_level, dt FROM fact_order GROUP BY dt, user_id",
    "scd2_append_guard": " UNION ALL ".join(f"""SELECT '{d}' AS bizdate, m AS max_snapshot_dt, n AS next_dwd_dt, CASE WHEN m IS NULL THEN 'INITIAL_LOAD' WHEN '{d}' <= m THEN 'BLOCK_HISTORY_OVERWRITE' WHEN n IS NULL THEN 'BLOCK_NO_NEXT_DWD_DT' WHEN '{d}' = n THEN 'ALLOW' ELSE 'BLOCK_GAP' END AS guard_status
      FROM (SELECT max(dt) FILTER (dt <= '{DAY}') m, min(dt) FILTER (dt > '{DAY}') n FROM dwd_clean)""" for d in GUARD_DAYS),
    "star_partition_state": """SELECT count(*) FILTER (m IS NULL) AS empty_tables, min(m) AS min_dt, max(m) AS max_dt, (SELECT min(dt) FROM dwd_clean) AS first_dwd_dt, CASE WHEN count(m) = 3 AND min(m) = max(m) THEN 'APPEND' WHEN count(m) = 3 THEN 'BLOCK_PARTITION_MISMATCH' ELSE 'BLOCK_PARTIAL_DATE' END AS state
      FROM (SELECT max(dt) m FROM dim_product UNION ALL SELECT max(dt) FROM dim_geo UNION ALL SELECT max(dt) FROM dim_date)""",
    # upkeep
    "scd2_append": "SELECT *, (SELECT max(dt) FROM dwd_clean) AS dt FROM scd2_history",
    "scd2_append_changes": f"SELECT *, CASE WHEN start_date = DATE '{DAY}' THEN 'new' WHEN is_current THEN 'unchanged' WHEN end_date = DATE '{DAY}' - INTERVAL 1 DAY THEN 'closing' ELSE 'closed' END AS change FROM scd2_snapshot",
    "delta": f"SELECT * FROM dwd_clean WHERE dt IN {LATE_DAYS} AND regexp_matches(invoice, '[37]$')",
    "early": f"SELECT * FROM dwd_clean WHERE NOT (dt IN {LATE_DAYS} AND regexp_matches(invoice, '[37]$'))",
    "early_daily": "SELECT dt, customerid, country FROM (SELECT *, row_number() OVER (PARTITION BY dt, customerid ORDER BY invoicedate DESC, country) rn FROM early) WHERE rn = 1",
    "early_opened": "SELECT * FROM (SELECT *, lag(country) OVER (PARTITION BY customerid ORDER BY dt) AS pc FROM early_daily) WHERE pc IS DISTINCT FROM country",
    "early_history": "SELECT md5(customerid || '|' || country || '|' || dt) AS user_id, customerid, CAST(dt AS DATE) AS start_date, coalesce(CAST(CAST(nx AS DATE) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS end_date FROM (SELECT *, lead(dt) OVER (PARTITION BY customerid ORDER BY dt) AS nx FROM early_opened)",
    "moved_versions": "SELECT customerid, start_date, end_date FROM early_history WHERE user_id NOT IN (SELECT user_id FROM scd2_history) UNION ALL SELECT customerid, start_date, end_date FROM scd2_history WHERE user_id NOT IN (SELECT user_id FROM early_history)",
    "late_refresh_scope": """SELECT DISTINCT 'same_day' AS rule, dt FROM delta UNION SELECT 'next_day', dt FROM delta UNION SELECT 'next_day', (SELECT min(d.dt) FROM dwd_clean d WHERE d.dt > x.dt) FROM (SELECT DISTINCT dt FROM delta) x
      UNION SELECT 'versions', dt FROM delta UNION SELECT 'versions', d.dt FROM dwd_clean d JOIN moved_versions v ON d.customerid = v.customerid AND CAST(d.dt AS DATE) BETWEEN v.start_date AND v.end_date""",
    "late_refresh_overview": "SELECT * FROM ads_sales_overview",
    "late_refresh_anomaly": "SELECT * FROM ads_sales_anomaly",
    "late_refresh_facts": "SELECT * FROM fact_order",
    "verified_publish": "SELECT *, 2 AS version FROM serving_upsert",
    "third": f"SELECT *, 'retail_canonical' AS source_system FROM ads_sales_overview",
    "verified_publish_refused": "SELECT dt, 'missing_right' AS diff_kind, NULL::VARCHAR AS column_name, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM third WHERE dt LIKE '%5' UNION ALL SELECT dt, 'mismatch', 'total_orders', total_orders::VARCHAR, (total_orders + 1)::VARCHAR FROM third WHERE dt LIKE '%7'",
    "dws_sales_summary_hitters": "SELECT * FROM dws_sales_summary",
    "customer_cumulative_spend_ranged": "SELECT * FROM customer_cumulative_spend",
    "fact_order_asof": "SELECT * FROM fact_order",
    "monthly_sales_trend_bitmaps": "SELECT * FROM monthly_sales_trend",
    "kpi_summary_bitmaps": "SELECT * FROM kpi_summary",
    "replicate_dataset_numbered": f"""SELECT {', '.join(_TEXTS)}, row_number() OVER (PARTITION BY n ORDER BY {', '.join(_TEXTS)}) AS source_row_id, CAST(n AS INTEGER) AS source_copy_id
      FROM (SELECT {', '.join(f'trim({x}) AS {x}' for x in _TEXTS)} FROM retail), range(1, 3) r(n)""",
    # quality
    "ods_ingestion_balance": f"""SELECT *, source_cnt = raw_cnt AS source_pass, raw_cnt = expected_ods_cnt + expected_reject_cnt + expected_other_date_cnt AS balance_pass, ods_cnt = expected_ods_cnt AS ods_pass, reject_cnt = expected_reject_cnt AS reject_pass FROM
      (SELECT count(*) AS raw_cnt, count(*) FILTER (ok AND d = '{DAY}') AS expected_ods_cnt, count(*) FILTER (NOT ok) AS expected_reject_cnt, count(*) FILTER (ok AND d <> '{DAY}') AS expected_other_date_cnt FROM (SELECT ts IS NOT NULL AND pq IS NOT NULL AND pp IS NOT NULL AS ok, strftime(ts, '%Y-%m-%d') AS d FROM parsed)),
      (SELECT count(*) AS source_cnt FROM retail), (SELECT count(*) AS ods_cnt FROM ods_typed WHERE dt = '{DAY}'), (SELECT count(*) AS reject_cnt FROM ods_reject)""",
    "ods_batch_check": f"""SELECT *, raw_cnt = {EXPECTED_RAW} AS raw_count_pass, reject_cnt = 0 AS reject_count_pass, raw_cnt = ods_cnt + reject_cnt AS balance_pass, min_dt = '{FIRST_DAY}' AS min_date_pass, max_dt = '{LAST_DAY}' AS max_date_pass, outside_cnt = 0 AS date_range_pass FROM (SELECT count(*) AS raw_cnt FROM ods_raw), (SELECT count(*) AS reject_cnt FROM ods_reject),
      (SELECT count(*) AS ods_cnt, min(dt) AS min_dt, max(dt) AS max_dt, count(DISTINCT dt) AS dt_cnt, count(*) FILTER (dt < '{FIRST_DAY}' OR dt > '{LAST_DAY}') AS outside_cnt FROM ods_typed)""",
    "quality_gate_summary": "SELECT count(*) AS rule_cnt, count(DISTINCT rule_code) AS distinct_rule_cnt, count(*) FILTER (check_level = 'BLOCK' AND check_status = 'PASS') AS block_pass_cnt, count(*) FILTER (check_level = 'BLOCK' AND check_status = 'FAIL') AS block_fail_cnt, count(*) FILTER (check_level = 'WARN' AND check_status = 'FAIL') AS warn_cnt FROM dwd_quality_rules",
    "dim_conflict_audit": " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, '{i}' AS check_item, unnest(['conflict_keys', 'max_values', 'avg_values']) AS metric, unnest([count(*)::DECIMAL(18,2), max(n)::DECIMAL(18,2), {q('sum(n)*100', 'count(*)')}]) AS value FROM (SELECT {k}, count(DISTINCT {v}) n FROM dwd_clean WHERE coalesce(trim({k}), '') <> '' AND coalesce(trim({v}), '') <> '' GROUP BY 1 HAVING count(DISTINCT {v}) > 1)"
         for t, i, k, v in (("dwd_product", "multi_description_per_stockcode", "stockcode", "description"), ("dwd_user", "multi_country_per_customer", "customerid", "country"))]
        + [f"SELECT '{t}', 'summary', unnest([{', '.join(repr(m) for m, _ in ms)}]), unnest([{', '.join(f'({x})::DECIMAL(18,2)' for _, x in ms)}]) FROM {of}"
           for t, of, ms in (("dwd_product", "dwd_clean WHERE coalesce(trim(stockcode), '') <> ''", _PRODUCTS), ("dwd_user", "dwd_clean WHERE coalesce(trim(customerid), '') <> ''", [("total_rows", "count(*)"), *_PEOPLE]), ("dim_product", "dim_product", _PRODUCTS),
                             ("dim_user", "scd2_history", [("total_versions", "count(*)"), ("current_versions", "count(*) FILTER (is_current)"), *_PEOPLE]))]),
    "dim_conflict_samples_customer": "SELECT customerid, string_agg(DISTINCT country, '|' ORDER BY country) AS conflicting_values, count(DISTINCT country) AS value_cnt FROM dwd_clean WHERE coalesce(trim(country), '') <> '' AND coalesce(trim(customerid), '') <> '' GROUP BY 1 HAVING count(DISTINCT country) > 1 ORDER BY value_cnt DESC, customerid LIMIT 20",
    "dim_conflict_samples": "SELECT stockcode, string_agg(DISTINCT description, '|' ORDER BY description) AS conflicting_values, count(DISTINCT description) AS value_cnt FROM dwd_clean WHERE coalesce(trim(description), '') <> '' AND coalesce(trim(stockcode), '') <> '' GROUP BY 1 HAVING count(DISTINCT description) > 1 ORDER BY value_cnt DESC, stockcode LIMIT 20",
    "dwd_normalization_profile": f"""SELECT count(*) AS row_count, count(DISTINCT invoice) AS distinct_invoices, count(DISTINCT customerid) AS distinct_customers, count(DISTINCT stockcode) AS distinct_products, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount,
      {', '.join(f'count(*) FILTER ({x} <> trim({x})) AS {x}_with_whitespace' for x in ('invoice', 'stockcode', 'description', 'country', 'customerid'))}, count(*) FILTER (regexp_matches(customerid, '\\.0$')) AS customerid_dot_zero,
      count(*) FILTER (regexp_matches(customerid, '^[0-9]+$')) AS numeric_customerid, count(*) FILTER (NOT regexp_matches(customerid, '^[0-9]+$')) AS other_customerid, count(*) FILTER (stockcode = upper(stockcode)) AS upper_stockcode FROM dwd_clean""",
    "dwd_full_validation": f"""SELECT *, dwd_rows = expected_rows AND dwd_dates = expected_dates AND dwd_amount = expected_amount AND outside_cnt = 0 AND unnormalised_cnt = 0 AND amount_error_cnt = 0 AS is_pass FROM (SELECT count(*) AS dwd_rows, count(DISTINCT dt) AS dwd_dates, CAST(sum(amount) AS DECIMAL(28,2)) AS dwd_amount, count(*) FILTER (NOT dt BETWEEN '{FIRST_DAY}' AND '{LAST_DAY}') AS outside_cnt, count(*) FILTER (customerid SIMILAR TO '[0-9]+\\.0' OR invoice <> trim(invoice) OR stockcode <> upper(trim(stockcode))) AS unnormalised_cnt, count(*) FILTER (amount <> round(quantity::DECIMAL(18,0) * price, 2)) AS amount_error_cnt FROM dwd_clean),
      (SELECT count(*) AS expected_rows, count(DISTINCT dt) AS expected_dates, CAST(sum(round(quantity::DECIMAL(18,0) * price, 2)) AS DECIMAL(28,2)) AS expected_amount FROM ods_typed WHERE {_OK})""",
    "alltime_quality_summary": "SELECT count(*) AS check_cnt, count(*) FILTER (NOT is_pass) AS failed_cnt, coalesce(string_agg(check_name, ',' ORDER BY check_order) FILTER (NOT is_pass), '') AS failed_checks, CASE WHEN bool_and(is_pass) THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM alltime_quality_rules",
    "changed": "SELECT * REPLACE (CASE WHEN dt LIKE '%7' THEN CAST(total_sales + 1 AS DECIMAL(18,2)) ELSE total_sales END AS total_sales) FROM ads_sales_overview WHERE dt NOT LIKE '%5'",
    "reconcile_tables": " UNION ALL ".join(["SELECT dt, CASE WHEN a.dt IS NULL THEN 'missing_left' ELSE 'missing_right' END AS diff_kind, NULL::VARCHAR AS column_name, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM ads_sales_overview a FULL JOIN changed b USING (dt) WHERE a.dt IS NULL OR b.dt IS NULL",
      "SELECT dt, 'doubled_key', NULL, NULL, NULL FROM (SELECT dt FROM ads_sales_overview GROUP BY dt HAVING count(*) > 1 UNION SELECT dt FROM changed GROUP BY dt HAVING count(*) > 1)",
      *(f"SELECT dt, 'mismatch', '{x}', a.{x}::VARCHAR, b.{x}::VARCHAR FROM ads_sales_overview a JOIN changed b USING (dt) WHERE a.{x} IS DISTINCT FROM b.{x}" for x in ("total_sales", "total_orders", "avg_order_value"))]),
    "log": "SELECT dt AS batch_id, unnest(list_filter(['START', CASE WHEN d % 5 <> 0 THEN 'SUCCESS' END, CASE WHEN d % 7 = 0 THEN 'FAILED' END], lambda x: x IS NOT NULL)) AS status FROM (SELECT DISTINCT dt, substr(dt, 9, 2)::INTEGER AS d FROM dwd_clean)",
    "batch_status": "SELECT batch_id, count(*) FILTER (status = 'START') AS start_cnt, count(*) FILTER (status = 'SUCCESS') AS success_cnt, count(*) FILTER (status = 'FAILED') AS failed_cnt, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' WHEN bool_or(status = 'START') THEN 'RUNNING' ELSE 'NOT_FOUND' END AS batch_status FROM log GROUP BY batch_id",
    "summary_by_month": "SELECT * EXCLUDE (dt), dt AS day, substr(dt, 1, 7) || '-01' AS dt FROM dws_sales_summary",
    "overwrite_partition": f"SELECT * REPLACE (CASE WHEN dt = '{DAY[:7]}-01' THEN CAST(total_sales + 1 AS DECIMAL(14,2)) ELSE total_sales END AS total_sales) FROM summary_by_month",
    "overwrite_dynamic": f"SELECT * REPLACE (CASE WHEN dt >= '{START}' THEN CAST(total_sales + 1 AS DECIMAL(14,2)) ELSE total_sales END AS total_sales) FROM summary_by_month",
    "overwrite_range": f"SELECT * FROM summary_by_month WHERE dt NOT BETWEEN '{START}' AND '{END}' UNION ALL SELECT * REPLACE (CAST(total_sales + 1 AS DECIMAL(14,2)) AS total_sales) FROM summary_by_month WHERE dt BETWEEN '{START}' AND '{END}' AND dt NOT LIKE '%5-01'",
    "ods_content_sample": f"SELECT * FROM ods_typed WHERE dt = '{DAY}' ORDER BY {', '.join(f'{x} NULLS FIRST' for x in _TEXTS)} LIMIT 20",
    "dwd_normalization_sample": f"SELECT invoice, stockcode, description, customerid, country, quantity, amount FROM dwd_clean WHERE dt = '{DAY}' ORDER BY ALL NULLS FIRST LIMIT 10",
}

for _n, _of in (("order_frequency", "customer_order_stats"), ("high_value_order_frequency", "high_value_customers")):
    V[_n] = f"SELECT b AS order_frequency_level, n AS customer_cnt, {part('n', 't')} AS customer_pct FROM (SELECT CASE WHEN order_count = 1 THEN '1_order' WHEN order_count <= 3 THEN '2_3_orders' WHEN order_count <= 10 THEN '4_10_orders' ELSE '10plus_orders' END AS b, count(*) n FROM {_of} GROUP BY 1), (SELECT count(*) t FROM {_of})"
for _n, _keys, _g, _m in (("customer_revenue_concentration", "customerid", "customer_group", "customer_count"), ("product_sales_concentration", "stockcode, description", "product_group", "product_count")):
    V[_n] = f"SELECT 'TOP' || k AS {_g}, count(*) AS {_m}, CAST(sum(s) AS DECIMAL(18,2)) AS group_sales, {share('sum(s)', 'any_value(t)')} AS sales_contribution_pct FROM (SELECT *, row_number() OVER (ORDER BY s DESC, {_keys}) rn FROM (SELECT {_keys}, sum(amount) s FROM clean_simple GROUP BY ALL)), (SELECT sum(amount) t FROM clean_simple), (VALUES (10), (50)) v(k) WHERE rn <= k GROUP BY k"

MARTS = {"dws_customer_value": ("customerid", "total_spent"), "dws_sales_summary": ("country", "total_sales"), "ads_high_value_contribution": ("dt", "total_sales"), "ads_level_distribution": ("customer_level", "total_spent"), "ads_country_rank": ("country", "total_sales"), "ads_high_value_preference": ("stockcode", None)}
V["layer_row_counts"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, dt, count(*) AS row_cnt FROM {v} GROUP BY dt" for n, v in (("ods_retail", "ods_typed"), ("dwd_retail_clean", "dwd_clean"), *((m, m) for m in MARTS)))
_NUM = "({})::DECIMAL(28,2)".format


def _range(table: str, item: str, lvl: str, actual: str, expected: str, ok: str) -> str:
    return f"SELECT '{table}' AS table_name, '{item}' AS check_item, '{lvl}' AS check_level, {_NUM(actual)} AS actual_value, {_NUM(expected)} AS expected_value, CASE WHEN {ok.format(a=_NUM(actual), e=_NUM(expected))} THEN 'PASS' ELSE 'FAIL' END AS check_status"


_LINE_DATES, _LINE_SALES = "SELECT count(DISTINCT dt) FROM dwd_clean", "SELECT coalesce(sum(amount), 0) FROM dwd_clean"
_RANGE = [_range("dwd_retail_clean", "non_empty", "BLOCK", "SELECT count(*) FROM dwd_clean", "1", "{a} >= {e}")]
for _n, (_k, _s) in MARTS.items():
    _l = "BLOCK" if _s else "WARN"
    _RANGE += [
        _range(_n, "non_empty", _l, f"SELECT count(*) FROM {_n}", "1", "{a} >= {e}"), _range(_n, "date_count", _l, f"SELECT count(DISTINCT dt) FROM {_n}", _LINE_DATES, "{a} = {e}"),
        _range(_n, "missing_dates", _l, f"SELECT count(DISTINCT dt) FROM dwd_clean WHERE dt NOT IN (SELECT dt FROM {_n})", "0", "{a} = {e}"),
        _range(_n, "doubled_keys", "BLOCK", f"SELECT count(*) FROM (SELECT 1 FROM {_n} GROUP BY dt, {_k} HAVING count(*) > 1)", "0", "{a} = {e}"),
    ]
    _RANGE += [_range(_n, "sales_match_lines", "BLOCK", f"SELECT coalesce(sum({_s}), 0) FROM {_n}", _LINE_SALES, "abs({a} - {e}) <= 0.01")] if _s else []
_RANGE += [
    _range("ads_high_value_contribution", "share_in_range", "BLOCK", "SELECT count(*) FROM ads_high_value_contribution WHERE sales_contribution_pct IS NULL OR sales_contribution_pct NOT BETWEEN 0 AND 100", "0", "{a} = {e}"),
    _range("ads_level_distribution", "shares_add_up", "BLOCK", "SELECT count(*) FROM (SELECT dt FROM ads_level_distribution GROUP BY dt HAVING abs(sum(customer_cnt_pct) - 100) > 0.05)", "0", "{a} = {e}"),
]
V["mart_range_validation"] = " UNION ALL ".join(_RANGE)
_PROFILE = [("rows", "ods_row_cnt", "count(*)"), *[("rows", f"{n}_cnt", f"count(DISTINCT {x})") for n, x in (("invoice", "invoice"), ("customer", "customerid"), ("product", "stockcode"), ("country", "country"))],
            *[("blank", f"null_{x}_cnt", f"count(*) FILTER (coalesce(trim({x}), '') = '')") for x in ("invoice", "stockcode", "description", "customerid", "country", "invoicedate")],
            ("numbers", "null_quantity_cnt", "count(*) FILTER (quantity IS NULL)"), ("numbers", "null_price_cnt", "count(*) FILTER (price IS NULL)"), ("numbers", "non_positive_quantity_cnt", "count(*) FILTER (quantity <= 0)"), ("numbers", "non_positive_price_cnt", "count(*) FILTER (price <= 0)"),
            ("numbers", "non_positive_amount_cnt", "count(*) FILTER (quantity * price <= 0)"), ("returns", "return_order_row_cnt", "count(*) FILTER (upper(trim(invoice)) LIKE 'C%')"), ("returns", "return_invoice_cnt", "count(DISTINCT CASE WHEN upper(trim(invoice)) LIKE 'C%' THEN invoice END)")]
V["ods_content_profile"] = " UNION ALL ".join(f"SELECT '{r}' AS report, '{n}' AS item, {x} AS cnt FROM ods_typed" for r, n, x in _PROFILE) + " UNION ALL SELECT 'reject', 'reject_row_cnt', count(*) FROM ods_reject UNION ALL SELECT 'reject_code', reject_code, count(*) FROM ods_reject GROUP BY reject_code"
_SANITY = [("dwd_invalid_quantity_cnt", "dwd_clean", "quantity <= 0"), ("dwd_invalid_price_cnt", "dwd_clean", "price <= 0"), ("dwd_null_or_blank_customerid_cnt", "dwd_clean", "coalesce(trim(customerid), '') = ''"), ("dwd_cancel_invoice_cnt", "dwd_clean", "upper(trim(invoice)) LIKE 'C%'"), ("dwd_invalid_amount_cnt", "dwd_clean", "amount IS NULL OR amount <= 0"),
           ("dws_null_customer_level_cnt", "dws_customer_value", "customer_level IS NULL"), ("dws_invalid_customer_level_cnt", "dws_customer_value", "customer_level NOT IN ('High Value', 'Medium Value', 'Low Value')"), ("dws_high_value_boundary_error_cnt", "dws_customer_value", "customer_level = 'High Value' AND total_spent < 5000"),
           ("dws_medium_value_boundary_error_cnt", "dws_customer_value", "customer_level = 'Medium Value' AND (total_spent < 1000 OR total_spent >= 5000)"), ("dws_low_value_boundary_error_cnt", "dws_customer_value", "customer_level = 'Low Value' AND total_spent >= 1000"),
           ("ads_high_value_sales_contribution_pct_error_cnt", "ads_high_value_contribution", "sales_contribution_pct IS NULL OR sales_contribution_pct NOT BETWEEN 0 AND 100"),
           ("ads_customer_level_customer_pct_sum_error_cnt", "pct_sums", "abs(a - 100) > 0.05"), ("ads_customer_level_sales_pct_sum_error_cnt", "pct_sums", "abs(b - 100) > 0.05"),
           ("ads_country_sales_rank_null_rank_cnt", "ads_country_rank", "sales_rank IS NULL"), ("ads_country_sales_rank_invalid_sales_cnt", "ads_country_rank", "total_sales IS NULL OR total_sales <= 0"),
           ("ads_high_value_customer_preference_null_rank_cnt", "ads_high_value_preference", "sales_rank IS NULL"), ("ads_high_value_customer_preference_invalid_sales_cnt", "ads_high_value_preference", "total_sales IS NULL OR total_sales <= 0"), ("ads_high_value_customer_preference_invalid_quantity_cnt", "ads_high_value_preference", "total_quantity IS NULL OR total_quantity <= 0")]
V["pct_sums"] = "SELECT dt, sum(customer_cnt_pct) a, sum(sales_pct) b FROM ads_level_distribution GROUP BY dt"
V["result_sanity_checks"] = " UNION ALL ".join(f"SELECT '{n}' AS check_item, count(*) FILTER ({w}) AS abnormal_cnt FROM {t}" for n, t, w in _SANITY)
V["alltime_quality_rules"] = " UNION ALL ".join(
    [f"SELECT {i} AS check_order, '{n}' AS check_name, count(*) FILTER ({w}) AS actual_value, '= 0' AS expected_rule, count(*) FILTER ({w}) = 0 AS is_pass FROM {t}" for i, (n, t, w) in enumerate([
        ("dwd_abnormal_quantity", "clean_simple", "quantity <= 0"), ("dwd_abnormal_price", "clean_simple", "price <= 0"), ("dwd_null_customer", "clean_simple", "customerid IS NULL"), ("dwd_return_order", "clean_simple", "upper(trim(invoice)) LIKE 'C%'"), ("dws_null_customer_level", "customer_value_alltime", "customer_level IS NULL")], 1)]
    + [f"SELECT {i}, 'ads_{n}_{'row_count' if n == 'top10_products' else 'nonempty'}', count(*), '{'= 10' if n == 'top10_products' else '> 0'}', count(*) {'= 10' if n == 'top10_products' else '> 0'} FROM {n}" for i, n in enumerate(ALLTIME_RESULTS, 6)])


#: CRC-32 by its table of 256 entries, made from the reversed polynomial; for texts of one byte a character.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda z: 0::BIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _print(columns: dict[str, str], name: str, view: str, crc: bool = False) -> str:
    row = "concat_ws('#|#', " + ", ".join(f"coalesce({x}::VARCHAR, '<NULL>')" for x in sorted(columns)) + ")"
    h = f"CAST(coalesce(sum({_CRC if crc else "('0x' || substr(md5({}), 1, 8))::UBIGINT"}), 0) AS DECIMAL(38,0))".format
    return f"SELECT '{name}' AS table_name, count(*) AS row_cnt, {h('s')} AS hash_sum, {h('reverse(s)')} AS reverse_hash_sum FROM (SELECT {row} AS s FROM {view}){f', {_CRC_TABLE}' if crc else ''}"


_ODS = dict.fromkeys((*_TEXTS, "dt"), "")
V["table_fingerprint"] = " UNION ALL ".join([_print(_ODS, "ods_retail", "ods_typed"), _print(_ODS | {"amount": ""}, "dwd_retail_clean", "dwd_clean"), _print(dict.fromkeys(("country", "total_orders", "total_customers", "total_sales", "avg_order_value", "dt"), ""), "dws_sales_summary", "dws_sales_summary")])


def _gate(rules: list[tuple], figures: str) -> str:
    """Rules (code, table, item, level, abnormal, actual, threshold, detail) over one row of figures."""
    rows = " UNION ALL ".join(f"SELECT '{code}' AS rule_code, '{t}' AS table_name, '{item}' AS check_item, '{lvl}' AS check_level, CAST({bad} AS BIGINT) AS abnormal_cnt, CAST({val} AS DECIMAL(38,6)) AS actual_value, CAST({limit} AS DECIMAL(38,6)) AS threshold_value, '{detail}' AS check_detail FROM {figures}" for code, t, item, lvl, bad, val, limit, detail in rules)
    return f"SELECT *, CASE WHEN abnormal_cnt = 0 THEN 'PASS' ELSE 'FAIL' END AS check_status FROM ({rows})"


def _some(code, table, x, lvl="BLOCK"):
    return (code, table, "non_empty", lvl, f"CASE WHEN {x} > 0 THEN 0 ELSE 1 END", x, 1, "row count >= 1")


def _none(code, table, item, x, detail):
    return (code, table, item, "BLOCK", x, x, 0, detail)


def _close(code, table, item, a, b, limit, detail):
    d = f"abs(coalesce({a}, 0) - coalesce({b}, 0))"
    return (code, table, item, "BLOCK", f"CASE WHEN {d} <= {limit} THEN 0 ELSE 1 END", d, limit, detail)


V["dwd_figures"] = f"SELECT * FROM (SELECT count(*) n, count(*) FILTER (quantity <= 0) q, count(*) FILTER (price <= 0) p, count(*) FILTER (coalesce(trim(customerid), '') = '') cu, count(*) FILTER ({_TS} IS NULL) t FROM dwd_clean), (SELECT count(*) FILTER ({_OK}) e FROM ods_typed)"
V["dwd_quality_rules"] = _gate([
    _none("DWD_001", "dwd_retail_clean", "quantity_positive", "q", "lines with quantity <= 0"), _none("DWD_002", "dwd_retail_clean", "price_positive", "p", "lines with price <= 0"), _none("DWD_003", "dwd_retail_clean", "customer_present", "cu", "lines without a customer"),
    _some("DWD_004", "dwd_retail_clean", "n"), _close("DWD_005", "dwd_retail_clean", "rows_match_ods", "n", "e", 0, "lines expected from the typed layer"), _none("DWD_006", "dwd_retail_clean", "time_parseable", "t", "lines whose time text doesn''t parse")], "dwd_figures")
V["assert_gate"] = "SELECT * FROM dwd_quality_rules"
V["result_figures"] = """SELECT * FROM (SELECT sum(amount) s0 FROM dwd_clean), (SELECT count(*) n1, sum(total_spent) s1 FROM dws_customer_value), (SELECT count(*) n2, sum(total_sales) s2 FROM dws_sales_summary), (SELECT count(*) n5, count(*) FILTER (sales_contribution_pct NOT BETWEEN 0 AND 100) bad FROM ads_high_value_contribution),
  (SELECT count(*) n6 FROM ads_level_distribution), (SELECT count(*) n7 FROM ads_country_rank), (SELECT count(*) n8 FROM ads_high_value_preference), (SELECT count(*) FILTER (abs(a - 100) > 0.05) a, count(*) FILTER (abs(b - 100) > 0.05) b FROM pct_sums)"""
V["result_quality_rules"] = _gate([
    _some("RESULT_001", "dws_customer_value", "n1"), _some("RESULT_002", "dws_sales_summary", "n2"), _close("RESULT_003", "dws_customer_value", "sales_match_dwd", "s1", "s0", 0.01, "sales of lines and of the mart"), _close("RESULT_004", "dws_sales_summary", "sales_match_dwd", "s2", "s0", 0.01, "sales of lines and of the mart"),
    _some("RESULT_005", "ads_high_value_contribution", "n5"), _some("RESULT_006", "ads_level_distribution", "n6"), _some("RESULT_007", "ads_country_rank", "n7"), _some("RESULT_008", "ads_high_value_preference", "n8", "WARN"),
    _none("RESULT_009", "ads_level_distribution", "customer_pct_sum", "a", "dates whose shares don''t add to 100 within 0.05"), _none("RESULT_010", "ads_level_distribution", "sales_pct_sum", "b", "dates whose shares don''t add to 100 within 0.05"), _none("RESULT_011", "ads_high_value_contribution", "pct_in_range", "bad", "rows whose share is outside 0 to 100")], "result_figures")
_D = "(SELECT count(*) FROM (SELECT 1 FROM {} GROUP BY {} HAVING count(*) > 1))".format
V["star_figures"] = f"""SELECT * FROM (SELECT count(*) nu, count(*) FILTER (start_date > end_date) br, count(*) FILTER (is_current AND end_date <> DATE '9999-12-31') be FROM scd2_history), (SELECT count(*) FILTER (n <> 1) no FROM (SELECT customerid, count(*) FILTER (is_current) n FROM scd2_history GROUP BY 1)),
  (SELECT count(*) FILTER (e >= start_date) ov FROM (SELECT start_date, max(end_date) OVER (PARTITION BY customerid ORDER BY start_date, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) e FROM scd2_history)),
  (SELECT count(*) nf, sum(amount) sf, count(*) FILTER (user_id IS NULL OR product_id IS NULL OR date_id IS NULL OR geo_id IS NULL) nk, count(*) FILTER (date_id::VARCHAR <> dt) bd FROM fact_order), (SELECT count(*) nd, sum(amount) sd FROM dwd_clean), (SELECT sum(total_amount) ss FROM dws_customer_value_star),
  (SELECT {_D('dim_product', 'dt, product_id')} dp, {_D('dim_geo', 'dt, geo_id')} dg, {_D('dim_date', 'dt, date_id')} dd, {_D('fact_order', 'order_line_id')} dl, {_D('scd2_history', 'user_id')} du),
  (SELECT (SELECT count(*) FROM fact_order WHERE user_id NOT IN (SELECT user_id FROM scd2_history)) + (SELECT count(*) FROM fact_order f ANTI JOIN dim_product USING (dt, product_id)) + (SELECT count(*) FROM fact_order f ANTI JOIN dim_geo USING (dt, geo_id)) + (SELECT count(*) FROM fact_order f ANTI JOIN dim_date USING (dt, date_id)) AS orp),
  (SELECT coalesce(sum(w) FILTER (m <> 1), 0) um FROM (SELECT d.customerid, d.dt, any_value(w) w, count(h.user_id) m FROM (SELECT customerid, dt, count(*) w FROM dwd_clean GROUP BY ALL) d LEFT JOIN scd2_history h ON d.customerid = h.customerid AND CAST(d.dt AS DATE) BETWEEN h.start_date AND h.end_date GROUP BY 1, 2))"""
V["star_quality_rules"] = _gate([
    _some("STAR_001", "dim_user", "nu"), _none("STAR_002", "dim_user", "one_current", "no", "customers without exactly one current version"), _none("STAR_003", "dim_user", "valid_range", "br", "versions that end before they start"), _none("STAR_004", "dim_user", "current_open", "be", "current versions that aren''t open"),
    _none("STAR_005", "dim_product", "key_unique", "dp", "repeated keys"), _none("STAR_006", "dim_geo", "key_unique", "dg", "repeated keys"), _none("STAR_007", "dim_date", "key_unique", "dd", "repeated keys"), _some("STAR_008", "fact_order", "nf"),
    _close("STAR_009", "fact_order", "rows_match_dwd", "nf", "nd", 0, "rows of lines and facts"), _close("STAR_010", "fact_order", "amount_match_dwd", "sf", "sd", 0.01, "amounts of lines and facts"), _none("STAR_011", "fact_order", "line_unique", "dl", "repeated line ids"),
    _close("STAR_012", "dws_customer_value_star", "amount_match_fact", "ss", "sf", 0.01, "amounts of facts and the mart"), _none("STAR_013", "dim_user", "key_unique", "du", "repeated keys"), _none("STAR_014", "fact_order", "keys_present", "nk", "facts with a missing key"),
    _none("STAR_015", "fact_order", "no_orphans", "orp", "facts whose key no dimension has"), _none("STAR_016", "fact_order", "one_version", "um", "lines without exactly one customer version"), _none("STAR_017", "fact_order", "date_matches", "bd", "facts whose date key differs from their date"), _none("STAR_018", "dim_user", "no_overlap", "ov", "versions that overlap an earlier one")], "star_figures")


def _needs(sql: str) -> list[str]:
    return [n for n in V if re.search(rf"(?:FROM|JOIN|,)\s*\(?{n}\b", sql)]


def _rerun(faulty: bool) -> str:
    """Fingerprints of the lines and the overview, and of what the rerun of two days makes of them."""
    days = f"('{DAY_BEFORE}', '{DAY}')"
    quantity = f"CASE WHEN dt IN {days} AND invoice LIKE '%1' THEN quantity + 1 ELSE quantity END" if faulty else "quantity"
    overview = ", ".join(("total_sales", "total_orders", "total_customers", f"total_quantity + {f'coalesce((SELECT count(*) FROM dwd_clean d WHERE d.dt = o.dt AND d.dt IN {days} AND d.invoice LIKE {chr(39)}%1{chr(39)}), 0)' if faulty else '0'} AS total_quantity", "avg_order_value", "dt"))
    parts = []
    for name, columns, before, after in (
        ("dwd_retail_clean", _ODS | {"amount": ""}, "dwd_clean", f"(SELECT * REPLACE ({quantity} AS quantity) FROM dwd_clean)"),
        ("ads_sales_overview", dict.fromkeys(("total_sales", "total_orders", "total_customers", "total_quantity", "avg_order_value", "dt"), ""), "ads_sales_overview", f"(SELECT {overview} FROM ads_sales_overview o)"),
    ):
        b, n = _print(columns, name, before), _print(columns, name, after)
        parts.append(f"""SELECT b.table_name, b.row_cnt AS row_cnt_before, b.hash_sum AS hash_sum_before, b.reverse_hash_sum AS reverse_hash_sum_before, n.row_cnt AS row_cnt_after, n.hash_sum AS hash_sum_after, n.reverse_hash_sum AS reverse_hash_sum_after,
          (SELECT count(DISTINCT dt) FROM dwd_clean WHERE dt IN {days}) AS rewritten_cnt, {f"(SELECT count(DISTINCT dt) FROM dwd_clean WHERE dt IN {days} AND invoice LIKE '%1')" if faulty else "0::BIGINT"} AS changed_cnt FROM ({b}) b, ({n}) n""")
    return f"SELECT *, CASE WHEN changed_cnt = 0 THEN 'PASS' ELSE 'FAIL' END AS check_result FROM ({' UNION ALL '.join(parts)})"


V["table_fingerprint_crc32"] = " UNION ALL ".join([_print(_ODS, "ods_retail", "ods_typed", True), _print(_ODS | {"amount": ""}, "dwd_retail_clean", "dwd_clean", True)])
V["idempotency_check"], V["idempotency_check_changed"] = _rerun(False), _rerun(True)
V["failed_rules"] = "SELECT * REPLACE (CASE WHEN rule_code = 'DWD_002' THEN 3 ELSE abnormal_cnt END AS abnormal_cnt, CASE WHEN rule_code = 'DWD_002' THEN 'FAIL' ELSE check_status END AS check_status) FROM dwd_quality_rules"
V["gate_log"] = " UNION ALL ".join(f"SELECT *, '{d}' AS dt, 'dwd' AS gate, {run} AS run FROM {of}" for d, run, of in (
    (GATE_DAYS[0], 1, "dwd_quality_rules"), (GATE_DAYS[1], 2, "dwd_quality_rules"), (GATE_DAYS[2], 2, "failed_rules"), (GATE_DAYS[3], 1, "(SELECT * FROM dwd_quality_rules WHERE rule_code <> 'DWD_006')")))
V["gate_states"] = f"""SELECT x.dt, 'dwd' AS gate, any_value(run) AS run, count(rule_code) AS rule_cnt, count(DISTINCT rule_code) AS distinct_rule_cnt, count(*) FILTER (check_level = 'BLOCK' AND check_status = 'PASS') AS block_pass_cnt, count(*) FILTER (check_level = 'BLOCK' AND check_status = 'FAIL') AS block_fail_cnt,
  count(*) FILTER (check_level = 'WARN' AND check_status = 'FAIL') AS warn_cnt, CASE WHEN count(rule_code) = 0 THEN 'MISSING' WHEN count(rule_code) <> 6 OR count(DISTINCT rule_code) <> 6 THEN 'INCOMPLETE' WHEN count(*) FILTER (check_level = 'BLOCK' AND check_status <> 'PASS') > 0 THEN 'FAILED' ELSE 'PASS' END AS gate_state
  FROM (SELECT unnest([{', '.join(repr(d) for d in GATE_DAYS)}]) AS dt) x LEFT JOIN gate_log g ON g.dt = x.dt GROUP BY x.dt"""
#: The load state by case: empty tables, least and greatest date, gate state, state.
_CASES = {
    "append": ("0", DAY, DAY, "'PASS'", "'APPEND'"), "append_gate_passed": ("0", GATE_DAYS[0], GATE_DAYS[0], None, "'APPEND'"), "append_gate_rerun": ("0", GATE_DAYS[1], GATE_DAYS[1], None, "'APPEND'"),
    "gate_failed": ("0", GATE_DAYS[2], GATE_DAYS[2], None, "'BLOCK_QUALITY_FAILED'"), "gate_incomplete": ("0", GATE_DAYS[3], GATE_DAYS[3], None, "'BLOCK_QUALITY_INCOMPLETE'"), "gate_missing": ("0", GATE_DAYS[4], GATE_DAYS[4], None, "'BLOCK_QUALITY_MISSING'"),
    "behind": ("0", START, DAY, "'PASS'", "'BLOCK_PARTITION_MISMATCH'"), "partial": ("1", DAY, DAY, "NULL", "'BLOCK_PARTIAL_DATE'"), "initial": ("7", None, None, "NULL", "'INITIAL'"), "initial_late": ("7", None, None, "NULL", "'BLOCK_INITIAL_START'"),
}
V["star_load_states"] = " UNION ALL ".join(
    f"""SELECT '{case}' AS "case", {n}::BIGINT AS empty_tables, {f"'{low}'" if low else 'NULL::VARCHAR'} AS min_dt, {f"'{high}'" if high else 'NULL::VARCHAR'} AS max_dt, (SELECT min(dt) FROM dwd_clean) AS first_dwd_dt, {gate or f"(SELECT gate_state FROM gate_states WHERE dt = '{high}')"}::VARCHAR AS gate_state, {state} AS state"""
    for case, (n, low, high, gate, state) in _CASES.items())


def statements() -> dict[str, str]:
    """Each query with the views it stands on, as one statement."""
    def chain(name: str, seen: list[str]) -> list[str]:
        for n in _needs(V[name]):
            if n not in seen and n != name:
                chain(n, seen)
                seen.append(n)
        return seen

    out = {}
    for name, sql in V.items():
        views = chain(name, [])
        out[name] = ("WITH " + ",\n".join(f"{n} AS ({V[n]})" for n in views) + "\n" if views else "") + sql
    return out
