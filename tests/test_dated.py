"""Lines dealt by date once: facts, versions and gates over them move no line again."""

from pyspark.sql import functions as F

from salesmart.functions.parsing import packed, unpacked
from salesmart.operators import quality as Q, star as S
from salesmart.plans import catalogue as C
from salesmart.sources import retail as R, sinks

SF = "/root/testdata/sf0.001"


def differ(a, b):
    return a.select(b.columns).exceptAll(b).count() + b.exceptAll(a.select(b.columns)).count()


def fresh(test):
    def run(spark):
        old = dict(C._STORED)
        C._STORED.clear()
        try:
            test(spark)
        finally:
            C._STORED.clear()
            C._STORED.update(old)

    run.__name__ = test.__name__
    return run


def no_broadcast(spark, plan):
    """The physical plan's lines where nothing is broadcast and adaptive execution is off."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        return plan()._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


@fresh
def test_dated_lines_are_the_clean_lines(spark):
    t = C.Context(spark, SF)
    lines = t.dated
    assert {k[-1] for k in C._STORED} == {"dated"}  # and no layer below
    assert differ(lines, t.dwd.select(*S.LINE)) == 0 and lines.count() > 0


def test_parts_that_are_not_there_once(spark):
    lines = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, 13), (6, None)], "k long, pk long")
    parts = spark.createDataFrame([(10,), (12,), (12,), (12,), (14,), (None,)], "pk long")
    assert differ(R._with_parts(lines, parts), lines.join(parts, "pk")) == 0
    assert R._with_parts(lines, parts).count() == 5


def test_packed_keys_come_back(spark):
    texts = spark.createDataFrame([("0123456789abcdef" * 2,), ("0123456789ABCDEF" * 2,), ("",), ("x" * 16,), ("é",), ("a-",), (None,)], "k string")
    got = texts.withColumn("p", packed("k")).withColumn("u", unpacked("p"))
    assert got.where(F.col("k").eqNullSafe(F.col("u"))).count() == 7 and got.select("p").distinct().count() == 7


@fresh
def test_dated_facts_are_the_facts_and_move_no_line(spark):
    t = C.Context(spark, SF)
    odd = t.dwd.where("customerid like '%1'").select(*S.LINE)
    lines = t.dated.unionByName(odd).unionByName(odd.withColumn("country", F.lit(" "))).unionByName(odd.withColumn("customerid", F.lit(None).cast("string")))
    described = lines.withColumn("description", F.lit("x"))
    plain = S.fact_order(lines, t.history, S.dim_product(described), S.dim_date(lines), S.dim_geo(lines))
    assert differ(S.dated_facts(lines, t.history), plain) == 0 and plain.count() > t.dwd.count()
    plan = no_broadcast(spark, lambda: S.dated_facts(t.dated, t.history))
    # the days of customers to their versions, the versions, and the days back to their date
    assert sum("Exchange hashpartitioning" in line for line in plan) == 3


@fresh
def test_versions_of_dated_lines_move_by_customer_alone(spark):
    t = C.Context(spark, SF)
    history = S.scd2_history(S.daily_customer_country(t.dated))
    plan = no_broadcast(spark, lambda: S.scd2_history(S.daily_customer_country(t.dated)))
    assert sum("Exchange hashpartitioning" in line for line in plan) == 1
    assert differ(history, S.scd2_history(S.daily_customer_country(t.dwd))) == 0


def test_replaced_dates_without_rows_go(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(d, i) for d in ("2020-01-01", "2020-01-02", "2020-01-03") for i in range(3)], "dt string, n long")
    sinks.overwrite_dynamic(rows, path)
    kept = sinks._files(spark, path, "2020-01-01")
    new = rows.where("dt = '2020-01-02' and n = 1").unionByName(spark.createDataFrame([("2020-01-04", 9), ("2020-01-01", 8)], "dt string, n long"))
    sinks.replace_dates(new, path, ["2020-01-02", "2020-01-03", "2020-01-04"])
    assert sinks._files(spark, path, "2020-01-01") == kept
    got = spark.read.parquet(path).select(F.col("dt").cast("string"), "n").where("dt > '2020-01-01'")
    assert sorted(tuple(r) for r in got.collect()) == [("2020-01-02", 1), ("2020-01-04", 9)]


@fresh
def test_late_facts_store_no_clean_lines_beside_the_dated(spark):
    assert C.queries()["late_refresh_facts"](spark, SF).count() > 0
    assert {k[-1] for k in C._STORED} == {"dated", "early_history", "refreshed_fact"}


@fresh
def test_star_gate_over_dated_tables_moves_nothing_by_date(spark):
    t = C.Context(spark, SF)
    rules = t.star_rules
    assert {k[-1] for k in C._STORED} == {"dated", "history", "dated_fact"}
    assert {r["check_status"] for r in rules.collect()} == {"PASS"} and rules.count() == 18
    plan = no_broadcast(spark, lambda: t.star_rules)
    moved = [line for line in plan if "Exchange hashpartitioning" in line]
    assert moved and not any("hashpartitioning(dt" in line for line in moved)


def test_line_ids_meet_their_repeats_by_size(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,), ("c",)], "k string")
    got = Q.repeated(df, "k")
    assert sorted(r["k"] or "" for r in got.collect()) == ["", "b"]
    assert not any("_h" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)


@fresh
def test_facts_by_asof_merge_days_and_no_lines(spark):
    t = C.Context(spark, SF)
    want = S.dated_facts(t.dated, t.dated_history)
    got = C.queries()["fact_order_asof"](spark, SF)
    assert {k[-1] for k in C._STORED} == {"dated", "history"}
    assert differ(got, want) == 0 and want.count() > 0
    # a hundred copies of the lines have no more days
    days, sizes = [], []
    merge = S.asof_merge
    try:
        S.asof_merge = lambda rows, *rest: days.append(rows.count()) or merge(rows, *rest)
        for lines in (t.dated, t.dated.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100))))):
            sizes.append(S.dated_facts(lines, t.dated_history, asof=True).count())
        dims = S.dim_product(t.dwd), S.dim_date(t.dwd), S.dim_geo(t.dwd)
        assert differ(S.fact_order(t.dwd, t.history, *dims, asof=True), want) == 0
    finally:
        S.asof_merge = merge
    assert days[0] == days[1] == days[2] < sizes[0] and sizes[1] == 100 * sizes[0]


@fresh
def test_load_states_store_one_date_of_the_star_tables(spark):
    t = C.Context(spark, SF)
    written, write = {}, sinks.overwrite_partition
    try:
        sinks.overwrite_partition = lambda df, path, dt: written.update({tuple(df.columns): df.localCheckpoint()}) or write(df, path, dt)
        assert C.queries()["star_load_states"](spark, SF).count() == 10
    finally:
        sinks.overwrite_partition = write
    assert {k[-1] for k in C._STORED} == {"ods", "dwd", "history", "gate_log"}  # and no whole product, date, geo or fact table
    day = F.col("dt") == C.DAY
    for want in (S.scd2_snapshot(t.history, C.DAY), t.product.where(day), t.date.where(day), t.geo.where(day), t.fact.where(day), t.star.where(day)):
        assert differ(written[tuple(want.columns)], want) == 0 and want.count() > 0
