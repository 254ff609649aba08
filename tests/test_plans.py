"""Physical-plan properties the scale design relies on."""

import os

import pytest

from souk.operators import features as FE
from souk.operators import summary as SU
from souk.sources.star import orders_fact, shared_fact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    df = FE.engineer(shared_fact(spark, SF, ["order_date", "revenue"]))
    plan = _plan(SU.monthly_revenue(df))
    read = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert read, plan
    schema = read[0].split("ReadSchema:")[1]
    assert "order_date" in schema and "revenue" in schema
    for col in ("state", "category", "base_price", "customer_id"):
        assert col not in schema


def test_fixed_dimensions_are_broadcast(spark):
    plan = _plan(orders_fact(spark, SF, ["zone", "revenue"]))
    assert plan.count("BroadcastExchange") >= 2       # nation and region at least
    assert "CartesianProduct" not in plan


def test_grouping_sets_single_pass(spark):
    df = shared_fact(spark, SF, ["category", "zone", "brand_type", "sales_event", "competition_intensity",
                                 "inventory_pressure", "revenue", "final_price", "units_sold",
                                 "discount_percent"])
    plan = _plan(SU.dimension_means(df))
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan


def test_drift_window_reaches_the_scan(spark):
    from souk.operators.drift import tag_windows
    plan = _plan(tag_windows(shared_fact(spark, SF, ["order_date", "revenue"])))
    pushed = plan.split("PushedFilters:")[1].split("\n")[0]
    assert "GreaterThanOrEqual(order_date" in pushed and "NestedLoop" not in plan
