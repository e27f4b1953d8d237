"""p3's counts go by deltas, and give what one plain load gives."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.llm import queries, site_lines
from factloom.session import table

D = "/root/testdata/sf0.001"


def test_queries_go_through_merge(spark, monkeypatch):
    chunks, calls, merge = table(spark, D, "chunks"), [], site_lines.merge
    state = site_lines.build(site_lines.lines(chunks, queries._site(), "doc_id", "text"), site_lines.source_docs(chunks, queries._site(), "doc_id"))
    whole = site_lines.strip(chunks, queries._site(), "text", state.excessive()).select("chunk_id", "doc_id", "loaded_at", "deleted_at", "text", "lines_removed")
    monkeypatch.setattr(site_lines, "merge", lambda *a: calls.append(1) or merge(*a))
    out = entry.queries()["p3_stripped"](spark, D)
    assert out.count() == chunks.count() and out.agg(F.sum("lines_removed")).first()[0] > 0
    assert out.exceptAll(whole).count() == 0 and whole.exceptAll(out).count() == 0
    entry.queries()["p3_found"](spark, D)
    assert len(calls) == 2
