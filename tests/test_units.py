from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factloom.operators.units import convert, quantity, segment

CASES = [
    ("2亿3,456万元", None, "currency", "234560000"), ("每10股1.23元", None, "per_share", "0.123"), ("10股合计1.2元", None, "per_share", "0.12"), ("1.2元/10股", None, "per_share", "0.12"), ("每股9分", None, "per_share", "0.09"),
    ("9角/股", None, "per_share", "0.9"), ("CNY (2,345.96) million", "", "currency", "-2345960000"), ("百分之四十点五八", "", "percentage", "40.58"), ("一百二十五点七亿元", "", "currency", "12570000000"), ("1,234 bps", "", "percentage", "12.34"),
    ("RMB-9bn", "", "currency", "-9000000000"), ("0.34", "1", "percentage", "34"), ("5", " RMB'000 ", "currency", "5000"), ("亏损每股9元", "", "per_share", "-9"), ("1.5", "元/10股", "per_share", "0.15"), ("8.61 уuan/shаre", "", "per_share", "8.61"),
    ("（32.23）", "亿", "currency", "-3223000000"), ("690.63百万", "", "currency", "690630000"), ("10元", "", "per_share", "10"), ("5.0‰", "%", "percentage", "0.5"), ("0.2", "ratio", "percentage", "20"), ("约3億", "元", "currency", "300000000"),
]


@pytest.mark.parametrize(("raw", "unit", "dimension", "expected"), CASES)
def test_cases(raw, unit, dimension, expected):
    assert quantity(raw, unit, dimension)[0] == Decimal(expected)


@pytest.mark.parametrize(("raw", "unit", "dimension"), [(None, "元", "currency"), ("", "元", "currency"), ("abc", "元", "currency"), ("5", None, "currency"), ("5", "", "currency"), ("5", "%", "currency"), ("5元", "", "percentage"), ("5", "元", None), ("9股合计", "", "per_share"), ("5 zorkmids", "元", "currency")])
def test_nothing_to_read(raw, unit, dimension):
    assert quantity(raw, unit, dimension)[0] is None


@given(st.decimals(min_value=0, max_value=10**9, places=2), st.sampled_from([("亿元", 10**8), ("万元", 10**4), ("百万元", 10**6), ("千元", 1000), ("元", 1)]))
def test_round_trip(value, unit):
    name, factor = unit
    assert quantity(f"{value:,}{name}", None, "currency")[0] == value * factor
    assert quantity(f"-{value}", name, "currency")[0] == -value * factor


def test_segmentation_prefers_fitting_roots():
    assert [t[0] for t in segment("百分之#", "percentage")] == ["百分之", "#"]
    assert [t[0] for t in segment("#分/股", "per_share")] == ["#", "分", "/", "股"]


def test_frame_with_odd_rows(spark):
    metrics = spark.createDataFrame([("revenue", "currency"), ("revenue", "currency"), ("roe", "percentage")], "metric string, dimension string")
    rows = [("a", "revenue", "1亿", None), ("a", "revenue", "1亿", None), ("b", None, "1", "元"), ("c", "roe", None, None), ("d", "roe", "x" * 100_000, "%"), ("e", "nope", "1", "元")]
    df = spark.createDataFrame(rows, "fact_id string, metric string, raw_value string, unit string").selectExpr("*", "'mine' as dimension", "1 as quantity", "1 as _extra")
    out = convert(df, metrics)
    assert out.count() == 6
    assert [r.quantity for r in out.where("fact_id = 'a'").collect()] == [Decimal(10**8)] * 2
    assert out.where("fact_id <> 'a' and quantity is not null").count() == 0
    assert convert(df.limit(0), metrics).count() == 0


def test_ranges_exponents_and_han_scales():
    q = lambda raw, dimension="currency": quantity(raw, None, dimension)[0]
    assert q("10-12亿元") is None and q("10至12亿元") is None
    assert q("1.2e9元") == Decimal("1.2e9") and q("1.5E-2亿元") == 1_500_000
    assert q("一万二千元") == 12_000 and q("五亿三千万元") == 530_000_000
    assert q("5.2元股", "per_share") is None and q("5.2元/股", "per_share") == Decimal("5.2") and q("每10股-2.5元", "per_share") == Decimal("-0.25")
