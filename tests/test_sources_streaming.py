import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import chunking
from factloom.plans import steps as ps
from factloom.sources import readers
from factloom.streaming import events as ev

S = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(10, 2))])


def test_tolerant_scan_keeps_every_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "name": "a"}\n\n{"id": 2\nnot json\n{"id": 3, "price": 1.5}\n')
    rows, issues = readers.read_jsonl_tolerant(spark, str(p), S)
    assert sorted(r.id for r in rows.collect()) == [1, 3]
    assert sorted(r.line for r in issues.collect()) == ["not json", '{"id": 2']
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILFAST|parse"):
        readers.read_jsonl(spark, str(p), S).collect()


def test_conform_adds_typed_nulls_and_wants_required(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, extra double")
    out = readers.conform(df, S)
    assert [t for _, t in out.dtypes] == ["bigint", "string", "decimal(10,2)"]
    with pytest.raises(ValueError, match="id"):
        readers.conform(df.drop("id"), S)


def test_formats_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], S)
    for kind in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / f"t.{kind}")
        (df.write.option("header", True).csv(path) if kind == "csv" else getattr(df.write, kind)(path))
        assert readers.read_any(spark, path, S).orderBy("id").collect()[0].id == 1
    folder = str(tmp_path / "snap")
    readers.write_snapshot(df, folder, "id")
    readers.write_snapshot(df.where("id = 1"), folder, "id")
    assert readers.read_snapshot(spark, folder).count() == 1
    with pytest.raises(ValueError, match="unique"):
        readers.write_snapshot(df.unionByName(df), folder, "id")
    assert readers.read_snapshot(spark, folder).count() == 1


def test_streams_agree_with_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i + (200 if i > 20 else 0)), i % 2, "a", 1.5, "{}") for i in range(40)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows + rows[:3], ev.EVENTS).coalesce(1).write.parquet(src)
    far = t0 + dt.timedelta(days=30)  # moves the watermark past everything else
    spark.createDataFrame([(99, far, 9, "z", 0.0, "{}")], ev.EVENTS).coalesce(1).write.mode("append").parquet(src)
    w = ev.run(ev.windows(ev.clean(ev.source(spark, src, files_per_batch=1))), str(tmp_path / "w"), str(tmp_path / "wc"))
    batch = spark.createDataFrame(rows, ev.EVENTS).groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.window_start, r.n) for r in w.where("event_type = 'a'").collect()} == {(r.window_start, r.n) for r in batch.collect()}
    s = ev.run(ev.sessions(ev.clean(ev.source(spark, src, files_per_batch=1))), str(tmp_path / "s"), str(tmp_path / "sc"))
    assert sorted((r.user_id, r.n) for r in s.where("user_id < 9").collect()) == [(0, 9), (0, 11), (1, 10), (1, 10)]
    assert os.listdir(tmp_path / "wc")


def test_budget_is_held_over_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    for k in range(3):  # one file a batch
        rows = [(10 * k + i, t0 + dt.timedelta(minutes=10 * k + i), i % 2, "a", None if i == 4 else 1.0, "{}") for i in range(6)]
        spark.createDataFrame(rows, ev.EVENTS).coalesce(1).write.mode("append").parquet(src)
    out = ev.run(ev.budget(ev.source(spark, src, files_per_batch=1), 4.0), str(tmp_path / "b"), str(tmp_path / "bc")).collect()
    assert len(out) == 18
    top = {u: max(r.cum for r in out if r.user_id == u) for u in (0, 1)}
    assert top == {0: 6.0, 1: 9.0} and all(r.exceeded == (r.cum > 4.0) for r in out)


def test_plan_levels_and_coverage(spark):
    steps = spark.createDataFrame([("p", "a", True, "SUCCESS"), ("p", "b", True, "SUCCESS"), ("p", "c", True, "FAILED"), ("p", "d", False, "SUCCESS"), ("q", "x", True, "SUCCESS"), ("q", "y", True, "SUCCESS")], "plan_id string, step_id string, required boolean, status string")
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "d", "c"), ("p", "d", "b"), ("q", "x", "y"), ("q", "y", "x"), ("p", "a", None)], "plan_id string, step_id string, needs string")
    assert {(r.step_id): r.level for r in ps.levels(steps, edges).collect()} == {"a": 0, "b": 1, "c": 0, "d": 2, "x": None, "y": None}
    got = {r.plan_id: (r.n_required, r.n_covered, r.decision) for r in ps.coverage(steps, edges).collect()}
    assert got == {"p": (3, 2, "partial"), "q": (2, 2, "answer")}
    assert {r.step_id for r in ps.failed_through(steps, edges).collect()} == {"c", "d"}


def test_packing_of_texts(spark):
    long = "\n".join("行" * n for n in (10, 900, 400, 30, 3000, 5))
    df = spark.createDataFrame([(1, long, 0), (2, None, 0), (3, " ", 0), (4, "短", 0)], "doc_id bigint, text string, t int")
    rows = chunking.parent_child(df).collect()
    assert {r.doc_id for r in rows} == {1, 4}
    assert max(len(r.text) for r in rows) <= 360 * 1.15 + 1
    assert chunking.windows("a" * 1000, 300, 50)[-1][-1] == "a" and sum(map(len, chunking.windows("a" * 1000, 300, 50))) >= 1000
    assert chunking.parent_child(df.limit(0)).count() == 0


def test_chunks_keep_to_their_titles(spark):
    text = "开头一行\n1.1 概况\n" + "\n".join(f"正文第{i}行，内容若干" for i in range(200)) + "\n二、风险\n末尾\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "只有正文"), (5, "一、只有标题")], "doc_id bigint, text string")
    rows = chunking.title_aware(df).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5}
    mine = [r for r in rows if r.doc_id == 1]
    assert {(r.section_idx, r.title) for r in mine} == {(0, None), (1, "1.1 概况"), (2, "二、风险")}
    assert all(len(r.text) <= chunking.TITLED + chunking.TITLED_OVERLAP + 1 for r in mine) and all("正文第" not in r.text for r in mine if r.section_idx != 1)
    assert all(any(f"正文第{i}行，" in r.text for r in mine) for i in range(200))
    assert chunking.title_aware(df.limit(0)).count() == 0
