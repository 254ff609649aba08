from pyspark.sql import functions as F

from souk.functions import (clip, customer_key, fiscal_quarter, np_round, safe_corr, safe_div,
                            strip_all)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (120.0,), (50.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 0.0, 100.0)).collect()]
    assert got == [None, 0.0, 100.0, 50.0]


def test_safe_div_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 0.5]


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(safe_corr("a", "b")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "a double, b double")
    assert abs(df2.agg(safe_corr("a", "b")).first()[0] - 0.9986) < 1e-3


def test_strip_all_removes_tabs(spark):
    df = spark.createDataFrame([("\t Delhi \n",)], "s string")
    assert df.select(strip_all("s")).first()[0] == "Delhi"


def test_fiscal_quarter_april_start(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = [r[0] for r in df.select(fiscal_quarter("m")).collect()]
    assert got == [4, 4, 4, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_customer_key_nan_literal(spark):
    df = spark.createDataFrame([("Delhi", None, 30)], "s string, g string, a int")
    assert df.select(customer_key("s", "g", "a")).first()[0] == "Delhi_nan_30"
    assert df.select(customer_key("s", "g", "a", null_literal=False)).first()[0] is None


def test_np_round_is_numpy_round(spark):
    import numpy as np
    vals = [2.5, 3.5, 25.15, 0.125, -2.5, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got1 = [r[0] for r in df.select(np_round("x", 1)).collect()]
    got0 = [r[0] for r in df.select(np_round("x", 0)).collect()]
    assert got1 == [float(np.round(v, 1)) for v in vals]
    assert got0 == [float(np.round(v, 0)) for v in vals]
