import os

import pytest

from souk.sources.star import FACT_COLUMNS, orders_fact, shared_fact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shared_fact_equals_direct_join(spark):
    a = shared_fact(spark, SF)
    b = orders_fact(spark, SF)
    assert a.columns == FACT_COLUMNS
    assert _rows(a) == _rows(b)
    # a second call reuses the stored fact (same path, same rows)
    assert _rows(shared_fact(spark, SF, ["order_id", "revenue"])) == _rows(b.select("order_id", "revenue"))


def test_pruned_joins_keep_every_row(spark):
    full = orders_fact(spark, SF)
    for cols in (["order_id", "revenue"], ["category", "revenue"], ["zone", "units_sold"],
                 ["customer_id", "order_date"]):
        assert _rows(orders_fact(spark, SF, cols)) == _rows(full.select(*cols))


def test_unknown_column_rejected(spark):
    with pytest.raises(ValueError):
        orders_fact(spark, SF, ["nope"])


def test_partitions_of_the_joins_follow_the_rows(spark, tmp_path, monkeypatch):
    from souk.sources import star

    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": ([(0, "JAPAN", 0), (1, "FRANCE", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, i % 2) for i in range(20)], "c_custkey long, c_nationkey long"),
        "part": ([(i, f"T{i % 3}", f"Brand#{i}") for i in range(30)], "p_partkey long, p_type string, p_brand string"),
        "orders": ([(i, i % 20, f"2024-{1 + i % 12:02d}-01", "1-URGENT") for i in range(300)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(i % 300, i % 30, 1.0 + i % 5, 100.0 + i, 0.05, "O") for i in range(900)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", df["o_orderdate"].cast("timestamp_ntz"))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before = {k: spark.conf.get(k, None) for k in kept}
    monkeypatch.setattr(star, "JOIN_ROWS", 50)
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        out = shared_fact(spark, str(tmp_path))
        files = len(out.inputFiles())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
    assert files > 4            # more than the session's own number
    assert _rows(out) == _rows(orders_fact(spark, str(tmp_path))) and out.count() == 900


def test_partitions_of_the_joins_are_not_merged(spark, tmp_path, monkeypatch):
    from souk.sources import star

    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "JAPAN", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, 0) for i in range(20)], "c_custkey long, c_nationkey long"),
        "part": ([(i, f"T{i % 3}", f"Brand#{i}") for i in range(30)], "p_partkey long, p_type string, p_brand string"),
        "orders": ([(i, i % 20, f"2024-{1 + i % 12:02d}-01", "1-URGENT") for i in range(300)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(i % 300, i % 30, 1.0 + i % 5, 100.0 + i, 0.05, "O") for i in range(900)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", df["o_orderdate"].cast("timestamp_ntz"))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    watched = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before, session = {k: spark.conf.get(k, None) for k in kept}, [spark.conf.get(k) for k in watched]
    monkeypatch.setattr(star, "JOIN_ROWS", 50)
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        out = shared_fact(spark, str(tmp_path))
        files = len(out.inputFiles())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [spark.conf.get(k) for k in watched] == session
    assert files > 14           # 18 partitions of some 50 rows; AQE would merge them by bytes
    assert _rows(out) == _rows(orders_fact(spark, str(tmp_path))) and out.count() == 900
