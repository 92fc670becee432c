"""Landing, typing, rejecting and cleaning of retail records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.parsing import blank, normal_customer, once, parse_invoice_ts, parse_price, parse_quantity
from ..sources.retail import COLUMNS

# Reject codes in order of priority, and their reasons.
REJECTS = (
    ("EMPTY_INVOICE_DATE", "invoice date is empty"),
    ("DATE_PARSE_FAILED", "invoice date fits none of the four formats"),
    ("EMPTY_QUANTITY", "quantity is empty"),
    ("QUANTITY_PARSE_FAILED", "quantity is not a whole number"),
    ("EMPTY_PRICE", "price is empty"),
    ("PRICE_PARSE_FAILED", "price is not a decimal(10,2)"),
)


def ods_raw(retail: DataFrame, batch_dt: str) -> DataFrame:
    """All records as text under a batch date."""
    return retail.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS], F.lit(batch_dt).alias("batch_dt"))


def _typed(raw: DataFrame) -> DataFrame:
    return once(raw, parse_invoice_ts("invoicedate").alias("_ts"), parse_quantity("quantity").alias("_q"), parse_price("price").alias("_p"))


def ods_typed(raw: DataFrame, start_dt: str | None = None, end_dt: str | None = None) -> DataFrame:
    """Records whose date, quantity and price parse, with dt; business faults stay."""
    t = _typed(raw).where("_ts is not null and _q is not null and _p is not null")
    out = t.select("invoice", "stockcode", "description", F.col("_q").alias("quantity"), "invoicedate", F.col("_p").alias("price"), "customerid", "country", F.date_format("_ts", "yyyy-MM-dd").alias("dt"))
    return in_range(out, start_dt, end_dt)


def in_range(df: DataFrame, start_dt: str | None = None, end_dt: str | None = None) -> DataFrame:
    """Rows whose dt lies within the given ends, both included."""
    if start_dt is not None:
        df = df.where(F.col("dt") >= start_dt)
    return df if end_dt is None else df.where(F.col("dt") <= end_dt)


def ods_reject(raw: DataFrame, batch_dt: str) -> DataFrame:
    """The records that ods_typed doesn't admit, each with its first reject code."""
    faults = (blank("invoicedate"), F.col("_ts").isNull(), blank("quantity"), F.col("_q").isNull(), blank("price"), F.col("_p").isNull())
    code, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (c, r), fault in reversed(list(zip(REJECTS, faults))):
        code, reason = F.when(fault, c).otherwise(code), F.when(fault, r).otherwise(reason)
    t = _typed(raw).withColumn("reject_code", code).withColumn("reject_reason", reason).where("reject_code is not null")
    return t.select(*COLUMNS, F.date_format("_ts", "yyyy-MM-dd").alias("parsed_bizdate"), "reject_code", "reject_reason", F.lit(batch_dt).alias("batch_dt"))


def dwd_clean(ods: DataFrame, start_dt: str | None = None, end_dt: str | None = None) -> DataFrame:
    """Sale lines with trimmed and normalised text and their amount."""
    ok = in_range(ods, start_dt, end_dt).where((F.col("quantity") > 0) & (F.col("price") > 0))
    for c in ("customerid", "invoice", "stockcode", "country", "invoicedate"):
        ok = ok.where(~blank(c))
    ok = ok.where(~F.upper(F.trim("invoice")).startswith("C"))
    return ok.select(
        F.trim("invoice").alias("invoice"), F.upper(F.trim("stockcode")).alias("stockcode"), F.trim("description").alias("description"), "quantity",
        F.date_format(parse_invoice_ts("invoicedate"), "yyyy-MM-dd HH:mm:ss").alias("invoicedate"), "price",
        normal_customer("customerid").alias("customerid"), F.trim("country").alias("country"),
        F.round(F.col("quantity").cast("decimal(18,0)") * F.col("price"), 2).cast("decimal(12,2)").alias("amount"), "dt",
    )


def clean_simple(ods: DataFrame) -> DataFrame:
    """First-generation cleaning: positive quantity and price, a customer, no cancelled invoice."""
    ok = ods.where((F.col("quantity") > 0) & (F.col("price") > 0) & F.col("customerid").isNotNull() & ~F.upper(F.trim("invoice")).startswith("C"))
    return ok.withColumn("invoicedate", F.date_format(parse_invoice_ts("invoicedate"), "yyyy-MM-dd HH:mm:ss")).withColumn(
        "amount", F.round(F.col("quantity").cast("decimal(18,0)") * F.col("price"), 2).cast("decimal(12,2)"))


def business_dates(df: DataFrame, start_dt: str | None = None, end_dt: str | None = None) -> DataFrame:
    """Distinct dates that have rows, ascending; not calendar days."""
    return in_range(df.select("dt"), start_dt, end_dt).distinct().orderBy("dt")


def t1_window(df: DataFrame, bizdate: str) -> DataFrame:
    """Of a business date and the day before it, those that have rows: what a late correction rebuilds."""
    day = F.to_date(F.lit(bizdate))
    ends = F.date_format(F.date_sub(day, 1), "yyyy-MM-dd"), F.lit(bizdate)
    return df.select("dt").where(F.col("dt").isin(*ends)).distinct().orderBy("dt")
