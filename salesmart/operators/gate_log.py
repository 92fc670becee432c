"""Gate results kept by date, table and run; the latest run counts, and a result that isn't there fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import filesystem, partition_dates
from .quality import BLOCK

COLUMNS = ("table_name", "rule_code", "check_item", "check_level", "abnormal_cnt", "actual_value", "threshold_value", "check_detail", "check_status")


def write_gate(result: DataFrame, path: str, dt: str, gate: str, run: int) -> None:
    """Keep a gate's result for a date and a run. The run's earlier result goes; other runs and gates stay.

    A folder each for date, gate and run: a rerun replaces its own folder and reads nothing.
    """
    result.select(*COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/dt={dt}/gate={gate}/run={run}")  # one row a rule


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All kept results: dt, gate, run, and the gate's columns."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("dt").cast("string").alias("dt"), "gate", F.col("run").cast("int").alias("run"), *COLUMNS)


def latest(log: DataFrame) -> DataFrame:
    """Of every date and gate the results of its latest run."""
    top = log.groupBy("dt", "gate").agg(F.max("run").alias("run"))
    return log.join(F.broadcast(top), ["dt", "gate", "run"])  # one row a date and gate


def gate_states(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each expected (dt, gate, rules) holds: by its latest run.

    Returns dt, gate, run, rule_cnt, distinct_rule_cnt, block_pass_cnt, block_fail_cnt, warn_cnt and gate_state:
    MISSING without any result, INCOMPLETE where there aren't as many different rules as expected, FAILED where a
    blocking rule isn't passed, else PASS.
    """
    hit = lambda lvl, ok: F.count_if((F.col("check_level") == lvl) & ((F.col("check_status") == "PASS") == ok))
    g = latest(log).groupBy("dt", "gate", "run").agg(
        F.count(F.lit(1)).alias("rule_cnt"), F.count_distinct("rule_code").alias("distinct_rule_cnt"), hit(BLOCK, True).alias("block_pass_cnt"), hit(BLOCK, False).alias("block_fail_cnt"), hit("WARN", False).alias("warn_cnt"))
    j = expected.join(g, ["dt", "gate"], "left")
    state = (
        F.when(F.col("run").isNull(), "MISSING").when((F.col("rule_cnt") != F.col("rules")) | (F.col("distinct_rule_cnt") != F.col("rules")), "INCOMPLETE")
        .when(F.col("block_fail_cnt") > 0, "FAILED").otherwise("PASS")
    )
    counts = ["rule_cnt", "distinct_rule_cnt", "block_pass_cnt", "block_fail_cnt", "warn_cnt"]
    return j.select("dt", "gate", "run", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], state.alias("gate_state"))


def require(log: DataFrame, expected: DataFrame) -> None:
    """RuntimeError unless all expected gates passed; a gate without a result is not passed."""
    bad = sorted(f"{r['dt']} {r['gate']}: {r['gate_state']}" for r in gate_states(log, expected).where("gate_state <> 'PASS'").collect())  # one row a date and gate
    if bad:
        raise RuntimeError(f"gates not passed: {', '.join(bad)}")


def table_partitions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Stored partitions of tables from their folders: table_name, dt, files, bytes; a table without any has one row of nulls.

    Nothing is opened: names and sizes come from the file system's listing.
    """
    rows = []
    for name, path in sorted(paths.items()):
        dates = partition_dates(spark, path)
        for dt in dates:
            fs, p = filesystem(spark, f"{path}/dt={dt}")
            files = fs.listFiles(p, True)
            n = size = 0
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    n, size = n + 1, size + f.getLen()
            rows.append((name, dt, n, size))
        if not dates:
            rows.append((name, None, None, None))
    return spark.createDataFrame(rows, "table_name string, dt string, files long, bytes long")  # one row a table and date


def load_state(tops: DataFrame, tables: int, first_dwd_dt: str | None, start_dt: str, baseline: DataFrame | None = None) -> DataFrame:
    """One row: may a range load of the star tables start at ``start_dt``?

    ``tops`` has table_name and max_dt of every table, null where it is empty; ``baseline`` the gate states of the
    dates that may be the last. All tables empty: INITIAL, if the first date with lines is the start. All at one
    date: APPEND, if that date's gate is passed, else BLOCK_QUALITY_ and the gate's state. Otherwise
    BLOCK_PARTIAL_DATE (some empty) or BLOCK_PARTITION_MISMATCH.
    """
    f = tops.agg(F.count_if(F.col("max_dt").isNull()).alias("empty_tables"), F.min("max_dt").alias("min_dt"), F.max("max_dt").alias("max_dt"))
    if baseline is not None:
        f = f.join(F.broadcast(baseline.select(F.col("dt").alias("max_dt"), "gate_state")), "max_dt", "left")  # one row a date
    else:
        f = f.withColumn("gate_state", F.lit("PASS"))
    first = F.lit(first_dwd_dt).cast("string")
    state = (
        F.when((F.col("empty_tables") == tables) & (first == start_dt), "INITIAL").when(F.col("empty_tables") == tables, "BLOCK_INITIAL_START")
        .when(F.col("empty_tables") > 0, "BLOCK_PARTIAL_DATE").when(F.col("min_dt") != F.col("max_dt"), "BLOCK_PARTITION_MISMATCH")
        .when(F.col("gate_state") == "PASS", "APPEND").otherwise(F.concat(F.lit("BLOCK_QUALITY_"), F.coalesce("gate_state", F.lit("MISSING"))))
    )
    return f.select("empty_tables", "min_dt", "max_dt", first.alias("first_dwd_dt"), F.when(F.col("empty_tables") == 0, F.col("gate_state")).alias("gate_state"), state.alias("state"))
