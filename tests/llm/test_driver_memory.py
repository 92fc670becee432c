"""The near-copy search's many short joins leave no tables in the driver."""

import random

from salesmart.llm import common, near_copies

from .test_exact import brute_components


def test_components_send_no_side_to_every_task(spark, monkeypatch):
    plans, plain = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components(range(60), pairs)
    assert got == {n: want[n] for pair in pairs for n in pair if pair[0] != pair[1] or n in got}
    assert len(plans) > 1 and not any("BroadcastExchange" in p for p in plans)


def test_groups_are_merged_by_later_links(spark):
    """Later links join groups, single nodes and both; without any the groups stay as they are."""
    rng = random.Random(9)
    first, later = ([(rng.randrange(a, 90), rng.randrange(a, 90)) for _ in range(30)] for a in (20, 0))
    first, later = ([p for p in pairs if p[0] != p[1]] for pairs in (first, later))
    named = common.components(spark.createDataFrame(first, "a long, b long"))
    for rest in ([], later):
        rows = near_copies._merged(named, spark.createDataFrame(rest, "a long, b long")).collect()
        want = brute_components(range(90), first + rest)
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == {n: want[n] for pair in first + rest for n in pair}
