"""Physical-plan properties: pushdown, pruning, bounded broadcasts."""

import re

from churnkit.plans.context import Chain, Fixture
from churnkit.sources import fixtures
from conftest import SF_SMALL


def plan_of(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


def test_adapter_pushes_the_date_filter_and_prunes_columns(spark, capsys):
    plan = plan_of(fixtures.subscriber(spark, SF_SMALL), capsys)
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), LessThan\(o_orderdate,2001-01-06", plan)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_quantity" in s]
    assert li and all("l_extendedprice" not in s and "l_shipdate" not in s for s in li)


def test_area_lookup_is_a_broadcast_join(spark, capsys):
    plan = plan_of(Fixture(spark, SF_SMALL).treated, capsys)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_recommendation_broadcasts_only_the_policy(spark, capsys):
    c = Chain(spark, SF_SMALL)
    plan = plan_of(c.reco, capsys)
    assert "BroadcastExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
