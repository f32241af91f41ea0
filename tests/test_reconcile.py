import pytest

from tallyloom.operators import reconcile

TEN, NONE, HUNDRED = [10.0] * 12, [0.0] * 12, [100.0] * 12


def at(i, x, base=NONE):
    out = list(base)
    out[i] = x
    return out


# FIXTURES.md section 3 (monthly amounts and the flags they raise).
NOISE = [90.0, 95.0, 100.0, 105.0, 110.0, 100.0, 90.0, 95.0, 105.0, 110.0, 95.0, 105.0]
CASES = {
    "healthy": (TEN, TEN, HUNDRED, []),
    "bulk": (TEN, at(0, 120.0), at(0, 1200.0), []),
    "zero use": (NONE, TEN, HUNDRED, [("zero-use-full-purchase", None, None)]),
    "no purchase": (at(0, 50.0), NONE, NONE, [("dispensed-without-purchase", None, None), ("year-end-stock-gap", None, "overuse")]),
    "spike": (TEN, TEN, at(5, 400.0, HUNDRED), [("unit-price-spike", 5, None)]),
    "noise": (TEN, TEN, NOISE, []),
    "single buy": (TEN, at(0, 120.0), at(0, 2400.0), []),
    "overstock": (TEN, at(0, 200.0), at(0, 2000.0), [("year-end-stock-gap", None, "overstock")]),
    "overuse": (TEN, at(0, 50.0), at(0, 500.0), [("year-end-stock-gap", None, "overuse")]),
    "small residue": (TEN, at(0, 130.0), at(0, 1300.0), []),
    "residue at the limit": (TEN, at(0, 150.0), at(0, 1500.0), []),
    "all zero": (NONE, NONE, NONE, []),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(k, *v[:3]) for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "case string, dispensed_qty array<double>, purchased_qty array<double>, purchased_value array<double>")
    return {r.case: r for r in reconcile.reconcile(df).collect()}


@pytest.mark.parametrize("case", CASES)
def test_flags(results, case):
    assert [(f.kind, f.month, f.gap) for f in results[case].flags] == CASES[case][3]


def test_figures(results):
    r = results["healthy"]
    assert (r.unit_price_year, r.coverage_ratio, r.cv_dispensed_qty) == (10.0, 1.0, 0.0)
    assert r.monthly_deltas == r.cumulative_deltas == NONE
    r = results["bulk"]
    assert (r.coverage_ratio, r.cumulative_deltas[0], r.cumulative_deltas[11], r.purchase_price_month[:2]) == (1.0, 110.0, 0.0, [10.0, None])
    assert results["single buy"].unit_price_year == 20.0
    assert (results["overstock"].cumulative_deltas[11], results["overuse"].cumulative_deltas[11]) == (80.0, -70.0)
    r = results["all zero"]
    assert (r.unit_price_year, r.coverage_ratio, r.cv_dispensed_qty, r.cv_purchased_value, r.median_price) == (None,) * 5
    assert results["zero use"].unit_price_year is None
    assert [f.purchased_value for f in results["spike"].flags] == [400.0]


def test_median_zero_makes_any_price_a_spike(spark):
    df = spark.createDataFrame([(TEN, TEN, at(3, 5.0))], "dispensed_qty array<double>, purchased_qty array<double>, purchased_value array<double>")
    flags = reconcile.reconcile(df, reconcile.Thresholds(min_value=-1.0)).first().flags
    assert ("unit-price-spike", 3) in [(f.kind, f.month) for f in flags]


def test_variation_of_two(spark):
    df = spark.createDataFrame([([10.0, 30.0],), ([5.0, 5.0, 5.0],), ([],), ([0.0, 0.0],)], "v array<double>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(reconcile._variation(F.col("v"))).collect()] == [0.5, 0.0, None, None]


def test_item_without_link(spark, sf_dir):
    from tallyloom.sources.tables import from_star

    with pytest.raises(LookupError):
        reconcile.reconcile_one(from_star(spark, sf_dir), 1998, "5")
