"""What searches leave on disk and move, against the size of their input, and their tokens against the regular expressions."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom import session
from factloom.functions import bags
from factloom.functions import text as tx

D = "/root/testdata/sf0.01"
SEARCHES = ["bm25_topk", "hybrid_topk", "evidence_pool", "diverse_docs", "evidence_select", "method_comparison", "retrieval_metrics", "shared_terms", "doc_candidates", "rerank_candidates", "retrieval_scores", "domain_priority", "retrieval_badcases"]


def shuffled(spark):
    """Bytes that the stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_moves_little_when_every_row_is_asked(spark, tmp_path, monkeypatch, name):
    """Every document is a query here, and 20 to 52 rows of each are the result; tokens, postings and scores of others stay unwritten."""
    docs = spark.read.parquet(f"{D}/documents.parquet").where("title is not null").withColumn("doc_id", F.col("doc_id") * 100)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(os.path.getsize(p) for p in tmp_path.rglob("*.parquet") if p.is_file())
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    spent = shuffled(spark)
    entry.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    kept = sum(os.path.getsize(p) for p in (tmp_path / "shared").rglob("*") if p.is_file())
    assert kept > 0 and kept + shuffled(spark) - spent < 8 * size


def test_batches_are_cut_like_columns(spark, monkeypatch):
    monkeypatch.setattr(bags, "PIECE", 12)
    texts = ["", "\n", "中", "中国", "中国人a1", "a中b", "中\n国 中国", "İx K9", "好了x𠀀中", "A-b c,d A", "鿿一 丁", "中", "　甲乙 丙"]
    want = [sorted(r[0]) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(tx.words(F.col("t"))).collect()]
    asked = ["中", "中国", "a1", "c", "zz", "丙"]
    everything, some = bags.Cutter(), bags.Cutter(asked)
    codes = bags.np.array(sorted(map(some.code, asked)))
    got, found = [], []
    for i, j in bags.pieces(texts):
        at, code, sizes = everything.cut(texts[i:j])
        got += [sorted(everything.token(c) for c in code[at == x].tolist()) for x in range(j - i)]
        assert sizes.tolist() == list(map(len, got[i:j]))
        at, code, n = bags.counted(*some.cut(texts[i:j], codes)[:2])
        found += [(i + x, some.token(c), m) for x, c, m in zip(at.tolist(), code.tolist(), n.tolist())]
    assert got == want
    assert sorted(found) == sorted({(i, w, ws.count(w)) for i, ws in enumerate(want) for w in ws if w in asked})
