import numpy as np
from pyspark.sql import functions as F

from order_rows import d, order, orders_df
from souk.functions.stats import t_two_sided_p
from souk.operators import inventory as IV
from souk.operators import pricing as PR


def test_t_pvalue_known_values():
    assert abs(t_two_sided_p(2.0, 10) - 0.07338803) < 1e-6
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12
    assert abs(t_two_sided_p(-3.5, 30) - 0.00146) < 1e-4


def _planted(spark, e_by_cat, n=80, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for cat, e in e_by_cat.items():
        for _ in range(n):
            p = float(rng.uniform(100, 1000))
            q = max(1, int(round(1e8 * p ** e * float(np.exp(rng.normal(0, 0.01)))))) if e != 0 else 10
            rows.append(order(i, d(2022, 1, 1), category=cat, base=p, disc=0.0, units=q)); i += 1
    return orders_df(spark, rows)


def test_planted_elasticity_recovered(spark):
    df = _planted(spark, {"A": -2.0, "B": -1.0, "C": -0.5})
    el = {r.category: r for r in PR.elasticity(df, ["category"], min_obs=50, with_pvalue=True).collect()}
    for cat, e in {"A": -2.0, "B": -1.0, "C": -0.5}.items():
        assert abs(el[cat].elasticity - e) < 0.05
        assert el[cat].p_value < 1e-6 and el[cat].r2 > 0.9


def test_constant_price_group_dropped(spark):
    rows = [order(i, d(2022, 1, 1), category="K", base=100.0, disc=0.0, units=1 + i % 5) for i in range(60)]
    assert PR.elasticity(orders_df(spark, rows), ["category"], min_obs=50).count() == 0


def test_optimal_discount_branches(spark):
    df = spark.createDataFrame([(-2.0, 20.0), (-0.5, 20.0), (0.3, 20.0), (-1.2, 0.0)], "e double, d double")
    o = PR.optimal_discount("e", "d")
    got = df.select(o["optimal_discount"], o["direction"], o["revenue_impact_pct"]).collect()
    # |e| = 2: min(20 * 2 / 1.5, 60) = 26.7, increase, impact (2-1) * 6.67 = 6.7
    assert tuple(got[0]) == (26.7, "increase", 6.7)
    # inelastic: 0.8 * 20 = 16, decrease, impact 0.5 * 4 = 2.0
    assert tuple(got[1]) == (16.0, "decrease", 2.0)
    assert tuple(got[2]) == (20.0, "hold", 0.0)
    assert tuple(got[3]) == (0.0, "hold", 0.0)


def test_price_recommendations_default_discount(spark):
    df = _planted(spark, {"A": -2.0})
    r = PR.price_recommendations(df, min_obs=30).first()
    assert r.direction == "hold" and r.current_discount == 0.0   # 0 * anything stays 0


def test_inventory_alert_levels(spark):
    # category x zone grid reaching all five levels
    spec = {  # (units, discount, share of High pressure)
        ("A", "N"): (90, 10, 1.0),    # CRITICAL
        ("A", "S"): (85, 10, 0.4),    # HIGH
        ("B", "N"): (40, 50, 0.6),    # CLEARANCE
        ("B", "S"): (2, 10, 0.0),     # SLOW_MOVER
        ("C", "N"): (40, 10, 0.0),    # HEALTHY
        ("C", "S"): (41, 10, 0.0),    # HEALTHY
        ("D", "N"): (42, 10, 0.0),    # HEALTHY
        ("D", "S"): (43, 10, 0.0),    # HEALTHY
        ("E", "N"): (44, 10, 0.0),    # HEALTHY
        ("E", "S"): (45, 10, 0.0),    # HEALTHY
    }
    rows, i = [], 0
    for (c, z), (u, disc, hp) in spec.items():
        for k in range(10):
            rows.append(order(i, d(2022, 1, 1), category=c, zone=z, units=u, disc=float(disc),
                              pressure="High" if k < hp * 10 else "Low")); i += 1
    al = {(r.category, r.zone): r for r in IV.alerts(orders_df(spark, rows)).collect()}
    assert al[("A", "N")].alert_level == "CRITICAL"
    assert al[("A", "S")].alert_level == "HIGH"
    assert al[("B", "N")].alert_level == "CLEARANCE"
    assert al[("B", "S")].alert_level == "SLOW_MOVER"
    assert al[("C", "N")].alert_level == "HEALTHY"
    assert al[("A", "N")].velocity_score == 100.0
    assert al[("A", "N")].recommendation == "Reorder A in N immediately"
    urgent = IV.urgent_groups(IV.alerts(orders_df(spark, rows))).collect()
    assert [u.group for u in urgent] == ["A / N", "A / S"]
