from souk.streaming.ingest import append_orders, monthly_revenue_updates, order_stream

HEADER = ("order_id,order_date,state,zone,category,brand_type,customer_gender,customer_age,base_price,"
          "discount_percent,sales_event,competition_intensity,inventory_pressure,units_sold,final_price,revenue")


def test_stream_appends_each_file_once(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    (land / "a.csv").write_text(HEADER + "\nO1,2022-01-05,Delhi,North,Fashion,Mass,Male,30,100,10,Normal,Low,Low,1,90,90\n")
    table, ck = str(tmp_path / "orders"), str(tmp_path / "ck")
    q = append_orders(order_stream(spark, str(land)), table, ck)
    q.awaitTermination()
    (land / "b.csv").write_text(HEADER + "\nO2,2022-02-05,Delhi,North,Fashion,Mass,Male,30,100,10,Normal,Low,Low,2,90,180\n")
    q = append_orders(order_stream(spark, str(land)), table, ck)
    q.awaitTermination()
    out = spark.read.parquet(table)
    assert sorted(r.order_id for r in out.collect()) == ["O1", "O2"]
    q2 = monthly_revenue_updates(order_stream(spark, str(land)), str(tmp_path / "ck2"), str(tmp_path / "monthly"))
    q2.awaitTermination()
    m = {r.year_month: r.revenue_sum for r in spark.read.parquet(str(tmp_path / "monthly")).collect()}
    assert m == {"2022-01": 90.0, "2022-02": 180.0}
