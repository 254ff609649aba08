"""Hand-made order rows shared by the tests.

Not in conftest.py: tests/llm has one of its own, and only one can be imported by that name."""
import datetime as dt

ORDER_COLS = ("order_id order_date state zone category brand_type customer_gender customer_age "
              "base_price discount_percent sales_event competition_intensity inventory_pressure "
              "units_sold final_price revenue").split()


def order(i, date, category="Electronics", zone="North", units=10, base=100.0, disc=10.0,
          state="Delhi", gender="Male", age=30, brand="Mass", event="Normal", comp="Low",
          pressure="Low", customer_id=None):
    final = round(base * (1 - disc / 100), 2) if base is not None and disc is not None else None
    rev = round(final * units, 2) if final is not None and units is not None else None
    row = dict(order_id=f"ORD{i:05d}", order_date=date, state=state, zone=zone, category=category,
               brand_type=brand, customer_gender=gender, customer_age=age, base_price=base,
               discount_percent=disc, sales_event=event, competition_intensity=comp,
               inventory_pressure=pressure, units_sold=units, final_price=final, revenue=rev)
    if customer_id is not None:
        row["customer_id"] = customer_id
    return row


def orders_df(spark, rows):
    """Prepared order table from dict rows (order_date as datetime)."""
    from souk.operators.features import engineer
    cols = list(rows[0].keys())
    schema = ", ".join(f"{c} {_type(c)}" for c in cols)
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)
    return engineer(df)


def _type(c):
    if c == "order_date":
        return "timestamp_ntz"
    if c in ("customer_age", "units_sold"):
        return "int"
    if c in ("base_price", "discount_percent", "final_price", "revenue"):
        return "double"
    return "string"


def d(y, m, day=1):
    return dt.datetime(y, m, day)
