import json
import os

import pytest
from pyspark.sql import functions as F

from souk.operators import features as FE
from souk.sources.orders import load_orders, row_count

HEADER = ("order_id,order_date,state,zone,category,brand_type,customer_gender,customer_age,base_price,"
          "discount_percent,sales_event,competition_intensity,inventory_pressure,units_sold,final_price,revenue")
ROWS = [
    "ORD00000,2022-01-01,Delhi,North,Electronics,Mass,Male,30,1000.0,10,Normal,Low,Low,2,900.0,1800.0",
    "ORD00001,not-a-date,\tDelhi ,North,Fashion,Premium,Female,40,500.0,-5,Festival,High,High,1,525.0,525.0",
    "ORD00002,2022-01-08,Karnataka,South,Grocery Essentials,Mass,Male,22,0.0,120,Normal,Medium,High,3,0.0,0.0",
    "ORD00003,2022-04-02,Tamil Nadu,South,Fashion,Mass,Female,59,200.0,,Normal,Low,Low,5,180.0,900.0",
]


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("orders")
    (d / "orders.csv").write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    (d / "orders.tsv").write_text("\n".join(x.replace(",", "\t") for x in [HEADER, *ROWS]) + "\n")
    cols = HEADER.split(",")
    recs = [dict(zip(cols, r.split(","))) for r in ROWS]
    for r in recs:
        for c in ("customer_age", "units_sold"):
            r[c] = int(r[c])
        for c in ("base_price", "discount_percent", "final_price", "revenue"):
            r[c] = float(r[c]) if r[c] != "" else None
    (d / "orders.json").write_text(json.dumps(recs))
    return d


def test_readers_by_suffix(spark, csv_dir, tmp_path):
    c = load_orders(spark, str(csv_dir / "orders.csv"))
    t = load_orders(spark, str(csv_dir / "orders.tsv"))
    j = load_orders(spark, str(csv_dir / "orders.json"))
    assert c.count() == t.count() == j.count() == 4
    pq = str(tmp_path / "orders.parquet")
    c.write.parquet(pq)
    assert load_orders(spark, pq).count() == 4
    assert row_count(c).first()["rows"] == 4
    with pytest.raises(ValueError):
        load_orders(spark, str(csv_dir / "orders.xml"))


def test_clean_and_engineer(spark, csv_dir):
    df = FE.prepare(load_orders(spark, str(csv_dir / "orders.csv")))
    rows = {r["order_id"]: r for r in df.collect()}
    assert rows["ORD00001"]["order_date"] is None          # bad date -> NULL
    assert rows["ORD00001"]["year_month"] is None
    assert rows["ORD00001"]["state"] == "Delhi"             # tab and blank stripped
    assert rows["ORD00001"]["discount_percent"] == 0.0      # clipped
    assert rows["ORD00002"]["discount_percent"] == 100.0
    assert rows["ORD00003"]["discount_percent"] is None     # NULL kept
    assert rows["ORD00002"]["discount_ratio"] is None       # zero base -> NULL
    r0 = rows["ORD00000"]
    assert (r0["year"], r0["month"], r0["month_name"], r0["weekday"], r0["is_weekend"]) == \
        (2022, 1, "January", 5, True)
    assert r0["fiscal_quarter"] == 4 and rows["ORD00003"]["fiscal_quarter"] == 1
    assert r0["year_month"] == "2022-01"
    assert abs(r0["discount_amount"] - 100.0) < 1e-9


def test_reference_loader_properties(spark, csv_dir):
    df = FE.prepare(load_orders(spark, str(csv_dir / "orders.csv")))
    for col in ["year", "month", "discount_amount", "log_revenue", "log_final_price"]:
        assert col in df.columns
    disc = [r[0] for r in df.select("discount_percent").collect() if r[0] is not None]
    assert all(0 <= v <= 100 for v in disc)
    assert df.where((F.col("log_revenue") < 0) | (F.col("log_final_price") < 0)).count() == 0


def test_segment_filter_and_options(spark, csv_dir):
    df = FE.prepare(load_orders(spark, str(csv_dir / "orders.csv")))
    assert FE.filter_segments(df, zone=["South"], category=None).count() == 2
    assert [r[0] for r in FE.distinct_values(df, "zone").collect()] == ["North", "South"]
    assert FE.keep_available(df, ["zone", "nope", "state"]).columns == ["zone", "state"]


def test_scatter_rows_projection(spark, csv_dir):
    df = FE.prepare(load_orders(spark, str(csv_dir / "orders.csv")))
    s = FE.scatter_rows(df, "discount_percent", "log_final_price", "category", ("zone", "missing"))
    assert s.columns == ["discount_percent", "log_final_price", "category", "zone"]
    assert s.count() == 3          # the NULL discount row is dropped
