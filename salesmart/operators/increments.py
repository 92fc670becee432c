"""Upkeep of stored tables: one more day of customer versions, and the refresh that late lines make necessary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources import sinks
from ..sources.sinks import partition_dates, stored
from . import marts, star
from .star import OPEN_END

SNAPSHOT = "user_id string, customerid string, country string, start_date date, end_date date, is_current boolean, dt string"


def scd2_changes(snapshot: DataFrame, today: DataFrame, bizdate: str) -> DataFrame:
    """The snapshot of ``bizdate`` from the last one and the day's countries, with each row's ``change``.

    closed: ended before and stays as it is. unchanged: the customer has no line today, or the same country.
    closing: ended yesterday, since the country differs today. new: opened today. Open versions and the day's
    customers meet in one full join; closed versions aren't moved.
    """
    day = F.to_date(F.lit(bizdate))
    row = lambda uid, country, start, end, current, change: F.struct(
        uid.alias("user_id"), country.alias("country"), start.alias("start_date"), end.alias("end_date"), F.lit(current).alias("is_current"), F.lit(change).alias("change"))
    old, new = F.col("old"), F.col("new")
    was = lambda end, current, change: row(old["user_id"], old["country"], old["start_date"], end, current, change)
    opened = row(star.version_key(F.col("customerid"), new, F.lit(bizdate)), new, day, F.to_date(F.lit(OPEN_END)), True, "new")
    rows = (
        F.when(old.isNull(), F.array(opened)).when(new.isNull() | old["country"].eqNullSafe(new), F.array(was(old["end_date"], True, "unchanged")))
        .otherwise(F.array(was(F.date_sub(day, 1), False, "closing"), opened))
    )
    live = snapshot.where("is_current").select("customerid", F.struct("user_id", "country", "start_date", "end_date").alias("old"))
    met = live.join(today.select("customerid", F.col("country").alias("new")), "customerid", "full_outer")
    columns = ["user_id", "customerid", "country", "start_date", "end_date", "is_current", "change"]
    moved = met.select("customerid", F.inline(rows)).select(columns)
    return snapshot.where("not is_current").withColumn("change", F.lit("closed")).select(columns).unionByName(moved).withColumn("dt", F.lit(bizdate))


def scd2_append(snapshot: DataFrame, today: DataFrame, bizdate: str) -> DataFrame:
    """The snapshot of ``bizdate``, in the form of ``scd2_snapshot``."""
    return scd2_changes(snapshot, today, bizdate).drop("change")


def append_snapshot(spark: SparkSession, lines_path: str, snapshots_path: str, bizdate: str) -> str:
    """Append one day to the stored snapshots; returns the guard's status, which is ALLOW or INITIAL_LOAD.

    Both tables are partitioned by dt, so what the guard asks is in the folders' names, and only the last snapshot
    and the day's lines are read. Any other status is a ValueError, and nothing is written.
    """
    have, days = partition_dates(spark, snapshots_path), partition_dates(spark, lines_path)
    frame = lambda dates: spark.createDataFrame([(d,) for d in dates], "dt string")  # noqa: E731  # one row a date
    status = star.scd2_append_guard(frame(have), frame(days), bizdate).first()["guard_status"]
    if status not in ("ALLOW", "INITIAL_LOAD") or bizdate not in days:
        raise ValueError(f"{bizdate}: {status if bizdate in days else 'BLOCK_NO_LINES'}")
    last = spark.read.parquet(f"{snapshots_path}/dt={have[-1]}") if have else spark.createDataFrame([], SNAPSHOT)
    lines = spark.read.parquet(f"{lines_path}/dt={bizdate}").withColumn("dt", F.lit(bizdate))
    sinks.overwrite_partition(scd2_append(last, star.daily_customer_country(lines), bizdate), snapshots_path, bizdate)
    return status


def changed_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions whose key one history has and the other hasn't: customerid, start_date, end_date.

    They cover every day on which a customer's key differs. A version that only ends on another day keeps its
    key, and the days between are covered by the version that opens there, whose key has its first day in it.
    """
    columns = ["customerid", "user_id", "start_date", "end_date"]
    both = before.select(columns).unionByName(after.select(columns))
    g = both.groupBy("customerid", "user_id").agg(F.count(F.lit(1)).alias("_n"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    return g.where("_n = 1").select("customerid", "start_date", "end_date")


def refresh_scope(dwd: DataFrame, delta: DataFrame, before: DataFrame, after: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Partitions that a delta of late lines changes: rule, dt.

    ``delta`` holds the lines that came or went, ``dwd`` the lines as they are now, ``before`` and ``after`` the
    customers' histories without and with it. same_day: the delta's dates. next_day: also the first date with
    lines after each of them, which is compared with the day before it. versions: also the dates on which a
    customer whose version changed, however long ago it opened, has lines. ``before`` and ``after`` may leave out
    customers who are the same in both; ``lines`` are those of the others, where they are known.
    """
    changed = delta.select("dt").distinct()
    days = dwd.select("dt").distinct().withColumn("has", F.lit(True)).unionByName(changed.withColumn("has", F.lit(False)))
    days = days.groupBy("dt").agg(F.bool_or("has").alias("has"), F.bool_or(~F.col("has")).alias("changed"))
    # one row a date
    after_it = F.min(F.when(F.col("has"), F.col("dt"))).over(Window.orderBy("dt").rowsBetween(1, Window.unboundedFollowing))
    following = days.withColumn("next", after_it).where("changed and next is not null").select(F.col("next").alias("dt"))
    versions = changed_versions(before, after)
    seen = (dwd if lines is None else lines).select("customerid", "dt").distinct().join(versions, "customerid").where(F.to_date("dt").between(F.col("start_date"), F.col("end_date"))).select("dt")
    rule = lambda name, df: df.distinct().select(F.lit(name).alias("rule"), "dt")
    return rule("same_day", changed).unionByName(rule("next_day", changed.unionByName(following))).unionByName(rule("versions", changed.unionByName(seen)))


def refresh_late(dwd: DataFrame, delta: DataFrame, history: DataFrame, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rebuild exactly the stored partitions that late lines change; returns the scope and the new history.

    ``paths`` has some of the tables overview, anomaly (with overview) and fact, each partitioned by dt; ``dwd`` has
    the delta in it, ``history`` is from before. Other partitions keep their files. The delta's customers are stored
    first, so that by their size they come to lines and versions, or these to them; what is theirs is made anew.
    """
    spark = dwd.sparkSession
    touched = stored(delta.select("customerid").distinct())
    lines = stored(dwd.select("dt", "customerid", "country", "invoicedate").join(touched, "customerid", "left_semi"))
    new = stored(star.scd2_history(star.daily_customer_country(lines)))
    scope = stored(refresh_scope(dwd, delta, history.join(touched, "customerid", "left_semi"), new, lines))
    renewed = stored(history.join(touched, "customerid", "left_anti").unionByName(new))
    dates = {r["rule"]: r["dates"] for r in scope.groupBy("rule").agg(F.collect_list("dt").alias("dates")).collect()}  # one entry a date
    of = lambda rule: dwd.join(F.broadcast(scope.where(F.col("rule") == rule).select("dt")), "dt", "left_semi")
    if "overview" in paths:
        sinks.overwrite_dates(marts.ads_sales_overview(of("same_day")), paths["overview"], dates.get("same_day", []))
    if "anomaly" in paths:
        overview = spark.read.parquet(paths["overview"]).withColumn("dt", F.col("dt").cast("string"))
        late = marts.ads_sales_anomaly(overview).where(F.col("dt").isin(dates.get("next_day", [])))
        sinks.overwrite_dates(late, paths["anomaly"], dates.get("next_day", []))
    if "fact" in paths:
        sinks.replace_dates(star.dated_facts(of("versions"), renewed), paths["fact"], dates.get("versions", []))
    return scope, renewed
