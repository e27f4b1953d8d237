"""Percentiles and ordinals by counting, and search, against brute force on small tables."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import coordinates as co
from factloom.operators import measures as ms
from factloom.operators import search


def test_percentiles_are_exact(spark, monkeypatch):
    r = random.Random(4)
    values = {"a": [r.gauss(0, 1) for _ in range(700)], "b": [5.0] * 40, "c": [r.choice([1.0, 2.0, 1e9]) for _ in range(301)], "d": [7.5], "e": []}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for pieces in (4, 1024):
        monkeypatch.setattr(ms, "PIECES", pieces)
        got = {x.g: x for x in ms.percentiles(df, ["g"], "x", at).collect()}
        assert set(got) == set(values)
        for g, xs in values.items():
            for n, q in at.items():
                assert (got[g][n] is None) if not xs else got[g][n] == pytest.approx(np.quantile(xs, q), rel=1e-12)
    assert ms.percentiles(df.limit(0), ["g"], "x", at).count() == 0


def test_rows_at_ordinals(spark, monkeypatch):
    monkeypatch.setattr(ms, "PIECES", 7)
    r = random.Random(5)
    rows = [("a" if r.random() < 0.9 else "b", i * i) for i in range(300)]
    by = {g: sorted(x for h, x in rows if h == g) for g in "ab"}
    wanted = [(g, i) for g in "ab" for i in (0, 1, len(by[g]) // 2, len(by[g]) - 1, len(by[g]))]
    out = ms.ranked_at(spark.createDataFrame(rows, "g string, x bigint"), "g", "x", spark.createDataFrame(wanted, "g string, i bigint")).collect()
    assert {(x.g, x.i, x.x) for x in out} == {(g, i, by[g][i]) for g, i in wanted if i < len(by[g])}


def brute_bm25(docs, queries, k):
    words = {i: [w for w in t.lower().split()] for i, t in docs if t is not None}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = set()
    for q, t in queries:
        scores = {}
        for i, ws in words.items():
            hit = [w for w in t.split() if w in ws]
            if hit:
                scores[i] = round(sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit), 6)
        out |= {(q, i, rk + 1) for rk, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k])}
    return out


@pytest.mark.parametrize("seeds", [1, 10_000])
def test_bm25_skips_nothing_that_counts(spark, monkeypatch, seeds):
    monkeypatch.setattr(search, "SEED_DOCS", seeds)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for i in range(400)] + [(900, None), (901, ""), (902, "w1 w1")]
    queries = [(i, " ".join(r.choices(vocabulary, weights, k=6))) for i in range(25)] + [(70, "unknown"), (71, None)]
    index = search.index(spark.createDataFrame(docs, "d int, t string"), "d", F.col("t"))
    hits = search.bm25(spark.createDataFrame(queries, "q int, t string"), "q", F.col("t"), index, "d", 5)
    assert {(x.q, x.d, x.rk) for x in hits.collect()} == brute_bm25(docs, queries[:25], 5)
    empty = search.index(spark.createDataFrame([], "d int, t string"), "d", F.col("t"))
    assert search.bm25(spark.createDataFrame(queries, "q int, t string"), "q", F.col("t"), empty, "d", 5).count() == 0


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 11)
    g = np.random.default_rng(3)
    m = np.round(g.normal(size=(120, 8)), 1).astype(np.float32)
    m[50] = m[51]  # a tie
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, None)], "id bigint, v array<float>")
    out = search.dense(rows.where("id % 4 = 0").withColumnRenamed("id", "q"), "q", rows, "id", "v", 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.q, {})[r.rk] = r.doc
    scores = np.round(m.astype(np.float64) @ m.astype(np.float64).T, 6)
    for q in range(0, 120, 4):
        best = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[q, i], i))[:3]
        assert [got[q][k] for k in (1, 2, 3)] == best


STATEMENT = "id string, company string, metric string, kind string, year int, value_type string, dimension string, quantity decimal(38,6), scope string, revision string"


def test_verdicts_by_coordinates(spark):
    def row(i, q, scope=None, revision=None, company="A", value_type="actual"):
        return (i, company, "revenue", "FY", 2023, value_type, "currency", None if q is None else Decimal(q), scope, revision)

    records = spark.createDataFrame([row("r1", 5, "group", "final"), row("r2", 7, "group", "final"), row("r3", 5, "group", None), row("r4", 9, None, None, "B"), row("r5", 5, None, None, None), row("r6", 1, "own", "final", "C")], STATEMENT)
    asked = spark.createDataFrame([
        row("both", 5, "group", "final"), row("against", 6, "group", "final"), row("open", 6, "group"), row("same", 9, None, None, "B"), row("none", 3, None, None, "Z"), row("lacks", None), row("other", 5, None, None, "A", "forecast"),
        row("scope", 2, "group", "final", "C"),
    ], STATEMENT)
    got = {r.id: (r.status, r.reason) for r in co.verdicts(asked, records, "id").collect()}
    assert got == {
        "both": ("CONTRADICTED", "support_and_conflict"), "against": ("CONTRADICTED", "numeric_value_conflict"), "open": ("INSUFFICIENT", "numeric_conflict_dimensions_incomplete"), "same": ("ENTAILED", "all_numeric_constraints_match"),
        "none": ("INSUFFICIENT", "no_evidence_matches_all_numeric_constraints"), "lacks": ("INSUFFICIENT", "missing:quantity"), "other": ("INSUFFICIENT", "no_evidence_matches_all_numeric_constraints"),
        "scope": ("INSUFFICIENT", "no_evidence_matches_all_numeric_constraints"),
    }
    assert co.verdicts(asked, records.limit(0), "id").where("status <> 'INSUFFICIENT'").count() == 0


def test_extraction_gives_the_first_reason(spark):
    rows = [
        ("ok", "甲2023年营业收入为5亿元", "5亿元", None, True), ("metric", "甲2023年天气", "5", None, True), ("period", "甲营收为5亿元", "5亿元", None, True), ("basis", "甲2023Q2营收为5亿元", "5亿元", None, True), ("value", "甲2023年营收不明", "不明", None, True),
        ("span", "甲2023年营收为5亿元", "6亿元", None, True), ("company", "甲2023年营收为约 5亿元", "约 5亿元", None, None), ("empty", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, source_span string, raw_value string, period_basis string, company_known boolean")
    got = {r.id: r for r in co.extract(df, [("revenue", "营收"), ("revenue", "营业收入"), ("gross", "毛")]).collect()}
    assert {i: r.reject for i, r in got.items()} == {"ok": None, "metric": "metric", "period": "period", "basis": "basis", "value": "value", "span": "span", "company": "company", "empty": "metric"}
    assert got["ok"].x_metric == "revenue" and got["company"].x_raw == "5亿元" and got["ok"].x_period.year == 2023


def test_fact_keys(spark):
    df = spark.createDataFrame([("a", 1, None, None), ("a", 1, "x", None), ("a", 1, None, dt.date(2024, 1, 1))], "c string, n int, s string, d date")
    keys = [r[0] for r in df.select(co.fact_key([F.col("c"), F.col("n")], [F.col("s"), F.col("d")])).collect()]
    assert len(set(keys)) == 3 and all(k.startswith("F") and len(k) == 13 for k in keys)
