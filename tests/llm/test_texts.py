from pyspark.sql import functions as F

from factloom.functions.form import to_form
from factloom.llm import lookalikes, site_lines
from factloom.session import materialize

S = "chunk_id string, doc_id string, source_type string, file_name string, text string, extra string"
def site():
    return F.struct(F.col("source_type"), site_lines.publisher(F.col("file_name")))


def test_find_and_kinds(spark):
    rows = [("1", "plain"), ("1", "plain"), ("2", "Ａ1"), ("2", "Ａ1"), ("3", None), ("4", ""), ("5", "Луна Ω"), ("6", "cοde"), ("7", "x" * 200_000 + "​")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("_v", F.lit("clash"))
    assert {r.src_key for r in lookalikes.find(df, "x", "id", "t").collect()} == {"2", "6", "7"}
    assert lookalikes.find(df, "x", "id", "t").count() == 3
    kinds = {(r.src_key, r.kind) for r in lookalikes.kinds(df, "id", "t").collect()}
    assert kinds == {("2", "width"), ("6", "script"), ("7", "invisible")}
    done = lookalikes.normalize(df, "t").collect()
    assert [r.t for r in done] == [to_form(t) for _, t in rows]
    assert lookalikes.find(df.limit(0), "x", "id", "t").count() == 0


def corpus(n=20, site="甲所"):
    rows = []
    for i in range(n):
        file = f"消费_2024-01-{i % 28 + 1:02d}_H{i}_{site}：题目.pdf"
        text = f"正文第{i}段 {'独' * (i + 1)}\n分享到： 好友 {i}" + ("\n罕见行" if i < 3 else "") + ("\n" if i == 0 else "")
        rows.append((f"{site}{i}", f"{site}d{i}", "report_pdf", file, text, "e"))
    return rows


def brute(rows):
    import re

    docs, holds, every = {}, {}, []
    for cid, doc, st, fn, text, _ in rows:
        if text is None:
            continue
        src = (st, fn.split("：")[0].split("_")[3])
        docs.setdefault(src, set()).add(doc)
        for i, line in enumerate(to_form(text).split("\n"), 1):
            k = (src, re.sub(r"[\s0-9]+", "", line))
            holds.setdefault(k, set()).add(doc)
            every.append((cid, i, k))
    return {(c, i) for c, i, k in every if len(holds[k]) >= 5 and len(holds[k]) * 10 >= len(docs[k[0]])}


def found(df):
    rows = site_lines.lines(df, site(), "doc_id", "text", keep=["chunk_id"])
    state = site_lines.build(rows, site_lines.source_docs(df, site(), "doc_id"))
    return {(r.chunk_id, r.line_no) for r in site_lines.mark(rows, state.excessive()).collect()}, state


def test_lines_against_brute_force(spark):
    rows = corpus() + corpus(3, "乙所") + [("n", "nd", "report_pdf", "消费_2024-01-01_H_甲所：x.pdf", None, "e")]
    df = spark.createDataFrame(rows + rows[:4], S)
    got, state = found(df)
    assert got == brute(rows) and got
    out = {r.chunk_id: r for r in site_lines.strip(df, site(), "text", state.excessive()).collect()}
    assert out["甲所5"].text == "正文第5段 " + "独" * 6 and out["甲所5"].lines_removed == 1
    assert out["乙所1"].lines_removed == 0 and out["n"].text is None and out["n"].extra == "e"
    assert site_lines.strip(df, site(), "text", state.excessive()).count() == df.count()


def test_merge_in_parts_equals_one_load(spark):
    rows = corpus(30)
    whole = spark.createDataFrame(rows, S)
    state, built = site_lines.LineState.empty(spark), None
    crossings = 0
    for a, b in ((0, 3), (3, 12), (10, 30)):  # the last part repeats two documents
        part, fresh, seen = (spark.createDataFrame(rows[i:b], S) for i in (a, max(a, 12 if a == 10 else a), 0))
        state, crossed = site_lines.merge(state, site_lines.lines(part, site(), "doc_id", "text"), site_lines.source_docs(part, site(), "doc_id"))
        crossed, state = materialize(crossed, "crossed"), state.save("merge")
        crossings += crossed.count()
        if a == 3:
            assert site_lines.affected(state, crossed).count() == 12
        built = materialize(site_lines.rebuild(built, seen, fresh, site_lines.affected(state, crossed), site(), "doc_id", "text", state), "built")
    _, once = found(whole)
    key = lambda s: {tuple(r) for r in s.counts.collect()}
    assert key(state) == key(once) and crossings >= 1
    assert {tuple(r) for r in built.collect()} == {tuple(r) for r in site_lines.strip(whole, site(), "text", once.excessive()).collect()}


def test_a_line_that_loses_its_standing(spark):
    """Documents without a line make it rarer: its documents are named and get it back."""
    rows = corpus(30)
    plain = [(f"p{i}", f"pd{i}", *rows[0][2:4], f"别的{'字' * i}", "e") for i in range(290)]
    state, _ = site_lines.merge(site_lines.LineState.empty(spark), *sides(spark, rows[:28]))
    state, crossed = site_lines.merge(state.save("a"), *sides(spark, plain))
    crossed = materialize(crossed, "crossed")
    assert [r.now for r in crossed.collect()] == [False] and site_lines.affected(state, crossed).count() == 28


def sides(spark, rows):
    df = spark.createDataFrame(rows, S)
    return site_lines.lines(df, site(), "doc_id", "text"), site_lines.source_docs(df, site(), "doc_id")


def test_empty(spark):
    assert found(spark.createDataFrame([], S))[0] == set()
