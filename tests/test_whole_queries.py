"""Queries that keep every row they speak of, on small tables of their own."""

import datetime
from decimal import Decimal

import __spark_entry__ as entry
from factloom.operators import units


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_page_overlaps_of_every_strategy_and_granularity(spark, tmp_path):
    rows = [
        ("d", "w", "fixed_window", "child", 1, 3), ("d", "w", "fixed_window", "child", 1, 3), ("d", "t", "title_aware", "child", 2, 4), ("d", "p", "table_protected", "parent", 4, 4),
        ("d", "u", "title_aware", "parent", 1, 9), ("d", "x", "title_aware", "child", None, 4), ("d", "y", "fixed_window", "child", 5, 4), ("d", "n", None, "child", 1, 9), ("e", "z", "title_aware", "child", 1, 9),
    ]
    save(spark, tmp_path, "chunks", rows, "doc_id string, chunk_id string, strategy_name string, granularity string, page_start int, page_end int")
    got = {(r.a_id, r.b_id): (r.a_strategy, r.b_granularity, r.n_pages) for r in entry.queries()["page_overlap_all"](spark, str(tmp_path)).collect()}
    assert got == {
        ("w", "t"): ("fixed_window", "child", 2), ("w", "u"): ("fixed_window", "parent", 3), ("p", "t"): ("table_protected", "child", 1), ("p", "u"): ("table_protected", "parent", 1)
    }


def test_companies_are_ranked_whatever_the_unit(spark, tmp_path):
    def fact(i, company, metric, unit, raw, kind="FY", value_type="actual"):
        return (str(i), company, metric, (kind, 2023), value_type, Decimal(1), unit, raw, datetime.datetime(2024, 1, 1 + i))

    rows = [
        fact(1, "small", "revenue", "元", "900"), fact(2, "large", "revenue", "亿元", "3.5"), fact(3, "printed", "revenue", None, "2万元"), fact(4, "blank", "revenue", "元 ", "1,000"), fact(5, "rmb", "revenue", "RMB mn", "1"),
        fact(6, "none", "revenue", None, "7"), fact(7, "none", "revenue", "元", "5"), fact(8, "LARGE CO", "revenue", "元", "8"), fact(9, "small", "revenue", "亿元", "99"), fact(10, "q", "revenue", "亿元", "9", kind="Q1"),
        fact(11, "a", "roe", "ratio", "0.2"), fact(12, "b", "roe", "%", "19"), fact(13, "a", "eps", "元/股", "1"), fact(14, "b", "eps", None, "每10股20元"),
    ]
    save(spark, tmp_path, "facts", rows, "fact_id string, company string, metric string, period struct<kind string, year int>, value_type string, value decimal(38,6), unit string, raw_value string, loaded_at timestamp")
    save(spark, tmp_path, "metric_registry", [("revenue", "currency", "元"), ("roe", "percentage", "%"), ("eps", "per_share", "元/股")], "metric string, dimension string, common_unit string")
    save(spark, tmp_path, "companies", [("c1", "large", ["LARGE CO"]), ("c2", "small", None)], "company_id string, name string, aliases array<string>")
    out = entry.queries()["structured_compare_units"](spark, str(tmp_path)).collect()
    assert {r.unit for r in out} == {"元", "%", "元/股"}
    got = {m: [(r.company, r.value) for r in sorted(out, key=lambda r: r.rk) if r.metric == m] for m in ("revenue", "roe", "eps")}
    assert got["revenue"] == [("large", 3.5e8), ("rmb", 1e6), ("printed", 2e4), ("blank", 1000.0), ("small", 900.0)]
    assert got["roe"] == [("a", 20.0), ("b", 19.0)] and got["eps"] == [("b", 2.0), ("a", 1.0)]


def test_large_amounts_keep_their_quantity(spark, tmp_path):
    raw = {"a": "1,200万亿元", "b": "1234567890123456789012345.123456元", "c": "1200万亿元", "d": "9" * 26 + "亿元", "e": "9" * 90 + "元", "f": "1.2元"}
    stored = {"a": "1200", "b": "1234567890123456789012345.123457", "c": "1200000000000000", "d": "1", "e": "1", "f": "1.2"}
    rows = [(i, "revenue", Decimal(stored[i]), raw[i], None) for i in raw]
    save(spark, tmp_path, "facts", rows, "fact_id string, metric string, value decimal(38,6), raw_value string, unit string")
    save(spark, tmp_path, "metric_registry", [("revenue", "currency", "元")], "metric string, dimension string, common_unit string")
    q = units.convert(spark.read.parquet(f"{tmp_path}/facts.parquet"), spark.read.parquet(f"{tmp_path}/metric_registry.parquet"))
    got = {r.fact_id: r.quantity for r in q.collect()}
    assert got == {"a": Decimal("1.2E15"), "b": Decimal("1234567890123456789012345.123456"), "c": Decimal("1.2E15"), "d": None, "e": None, "f": Decimal("1.2")}
    assert {r.fact_id for r in entry.queries()["p4_found"](spark, str(tmp_path)).collect()} == {"a", "b"}
