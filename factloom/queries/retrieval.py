"""Retrieval queries.  Query set: every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import claims as cl
from factloom.operators import measures as ms
from factloom.operators import search
from factloom.session import materialize, table

K = 20


def _index(spark: SparkSession, d: str) -> search.Index:
    return search.saved_index(spark, table(spark, d, "documents"), "doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the query documents."""
    return table(spark, d, "documents").where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "title")


def _bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return search.bm25(_asked(spark, d), "query_id", F.col("title"), _index(spark, d), "doc_id", k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "doc_id", "score", "rk")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.dense(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "query_id", e, "vec_id", "embedding", 10).withColumnRenamed("doc", "vec_id")


def _title_hits(spark: SparkSession, d: str) -> DataFrame:
    """A second ranking beside BM25: share of the query's tokens that the title holds, over shared tokens only."""
    titles = table(spark, d, "documents").where("title is not null")
    return search.shares(_asked(spark, d), "query_id", F.col("title"), titles, "doc_id", F.col("title"), K)


def _fused(title: DataFrame, bm25: DataFrame) -> DataFrame:
    return search.best(search.fuse(title, bm25, "query_id", "doc_id"), K, "query_id", "doc_id")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _fused(_title_hits(spark, d), _bm25(spark, d))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "doc_id", F.round("title_score", 6).alias("title_score"), F.round("bm25_score", 6).alias("bm25_score"), "score", "rk")


def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 within the query's own source; the scope applies to the texts, before anything is scored."""
    docs = table(spark, d, "documents").withColumn("scope", F.lower(F.trim("source")))
    made = replace(_index(spark, d), texts=docs.where("scope is not null and text is not null").select("doc_id", "scope", F.col("text").alias("txt")))
    asked = docs.where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "title", "scope")
    return search.bm25(asked, "query_id", F.col("title"), made, "doc_id", 5, "scope").select("query_id", "doc_id", "score", "rk")


def domain_priority(spark: SparkSession, d: str) -> DataFrame:
    """Hits reordered stably: the query's language first, mixed or unknown next, others last."""
    lang = F.when(F.lower("lang").like("zh%") | (F.lower("lang") == "cn"), "zh").when(F.lower("lang").like("en%"), "en")
    docs = table(spark, d, "documents").select("doc_id", lang.alias("lang"))
    hits = _bm25(spark, d).join(docs, "doc_id").join(docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query_lang")), "query_id")
    bucket = F.when(F.col("lang") == F.col("query_lang"), 0).when(F.col("lang").isNull() | F.col("query_lang").isNull(), 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy("bucket", "rk")
    return hits.withColumn("bucket", bucket).withColumn("new_rk", F.row_number().over(w)).select("query_id", "doc_id", "bucket", "new_rk")


def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid hits rescored by token overlap with the title; near-empty texts leave if enough others stay."""
    docs = table(spark, d, "documents").select("doc_id", "title", (F.length(F.coalesce("text", F.lit(""))) < 100).alias("thin"))
    hits = _hybrid(spark, d).join(docs.select("doc_id", "thin"), "doc_id")
    enough = F.count_if(~F.col("thin")).over(Window.partitionBy("query_id")) >= 5
    hits = hits.withColumn("enough", enough).where("not (enough and thin)")
    hits = hits.join(_asked(spark, d).select("query_id", F.col("title").alias("asked")), "query_id").join(docs.select("doc_id", "title"), "doc_id")
    hits = hits.withColumn("rerank", F.round(tx.overlap(tx.words(F.col("asked")), tx.words(F.coalesce("title", F.lit("")))), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("score"), "doc_id")
    return hits.withColumn("rk", F.row_number().over(w)).where("rk <= 5").select("query_id", "doc_id", "rerank", "rk")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of three methods; gold: the document whose title was asked."""
    asked = _asked(spark, d)
    gold = asked.select("query_id", F.col("query_id").alias("doc_id"))
    out = None
    bm25, title = materialize(_bm25(spark, d), "bm25"), materialize(_title_hits(spark, d), "titles")
    for name, hits in (("bm25", bm25), ("title", title), ("hybrid", _fused(title, bm25))):
        one = search.metrics(hits, asked, "query_id", gold, "doc_id").withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def retrieval_badcases(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose own document is not among the ten best, per method."""
    asked = _asked(spark, d).select("query_id")
    out = None
    bm25 = materialize(_bm25(spark, d), "bm25")
    for name, hits in (("bm25", bm25), ("hybrid", _fused(_title_hits(spark, d), bm25))):
        good = hits.where("rk <= 10 and query_id = doc_id").select("query_id")
        one = asked.join(good, "query_id", "left_anti").withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def doc_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sources ranked per query: best hit, sum of the two best, number of hits."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"))
    hits = _bm25(spark, d).join(docs, "doc_id")
    w = Window.partitionBy("query_id", "source").orderBy("rk")
    hits = hits.withColumn("r", F.row_number().over(w))
    out = hits.groupBy("query_id", "source").agg(F.max("score").alias("best_score"), F.round(F.sum(F.when(F.col("r") <= 2, F.col("score"))), 6).alias("top2"), F.count("*").alias("n_hits"))
    return out.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("top2"), "source")))


def diverse_docs(spark: SparkSession, d: str) -> DataFrame:
    """Five hits per query: the best of each source before any second one."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"))
    hits = _bm25(spark, d).join(docs, "doc_id").withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rk")))
    w = Window.partitionBy("query_id").orderBy((F.col("nth") > 1).cast("int"), "rk")
    return hits.withColumn("new_rk", F.row_number().over(w)).where("new_rk <= 5").select("query_id", "doc_id", "source", "new_rk")


def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    """Numbered evidence of each query: up to five hits with any title overlap, best first."""
    hits = _hybrid(spark, d).where("title_score > 0")
    w = Window.partitionBy("query_id").orderBy("rk")
    return hits.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "doc_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("evidence_id"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Claims' evidence in order, with a snippet of the chunk it names (chunk id first, second name next)."""
    claims = table(spark, d, "claims").groupBy("claim_id").agg(F.min("evidence_ids").alias("ids")).select("claim_id", F.posexplode("ids").alias("pos", "ref")).where("ref is not null")
    cited = cl.cited(claims, table(spark, d, "chunks"))
    n = tx.normalize(F.col("text"))
    snippet = F.concat(F.substring(n, 1, 180), F.when(F.length(n) > 180, "...").otherwise(""))
    return cited.select("claim_id", "pos", "ref", "chunk_id", snippet.alias("snippet"))


def page_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Parent chunks cut by title beside those that protect tables, where their pages overlap; `page_overlap_all` has every pair."""
    c = table(spark, d, "chunks").where("granularity = 'parent' and page_start is not null and page_end >= page_start").select("doc_id", "chunk_id", "strategy_name", "page_start", "page_end").distinct()
    p = c.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    a = p.where("strategy_name = 'title_aware'").select("doc_id", "page", F.col("chunk_id").alias("a_id"))
    b = p.where("strategy_name = 'table_protected'").select("doc_id", "page", F.col("chunk_id").alias("b_id"))
    return a.join(b, ["doc_id", "page"]).groupBy("a_id", "b_id").agg(F.count("*").alias("n_pages"))


def page_overlap_all(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of different strategies of one report whose page intervals overlap: pages as keys, not a theta join.

    Every strategy and granularity takes part; a pair stands once, in order of the strategies' names.  Only chunks without
    valid pages or strategy are in no pair.
    """
    c = table(spark, d, "chunks").where("page_start is not null and page_end >= page_start and strategy_name is not null")
    kept = ("chunk_id", "strategy_name", "granularity")
    p = c.select("doc_id", *kept, F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    a, b = (p.select("doc_id", "page", *[F.col(k).alias(f"{side}_{k.removeprefix('chunk_').removesuffix('_name')}") for k in kept]) for side in "ab")
    pairs = a.join(b, ["doc_id", "page"]).where("a_strategy < b_strategy")
    return pairs.groupBy("a_id", "b_id", "a_strategy", "b_strategy", "a_granularity", "b_granularity").agg(F.count_distinct("doc_id", "page").alias("n_pages"))


def seed_evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Five evenly spaced documents of each source by id (rank positions, ends included)."""
    t = table(spark, d, "documents").where("source is not null").select("doc_id", F.lower(F.trim("source")).alias("source"))
    n = t.groupBy("source").agg(F.count("*").alias("n"))
    want = n.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(5)).cast("int") - 1)))
    pos = F.when(F.col("n") <= 5, F.col("ordinal")).otherwise(F.floor(F.col("ordinal") * (F.col("n") - 1) / 4 + 0.5))
    return ms.ranked_at(t, "source", "doc_id", want.select("source", "ordinal", pos.cast("bigint").alias("i"))).select("source", "ordinal", "doc_id")


def stratified_subset(spark: SparkSession, d: str) -> DataFrame:
    """First ten documents per source and language in order of publication: a sampling operator."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), "published_at")
    w = Window.partitionBy("source", "lang").orderBy("published_at", "doc_id")
    return t.withColumn("rk", F.row_number().over(w)).where("rk <= 10").select("source", "lang", "doc_id", "rk")


QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, hybrid_topk, scoped_search, domain_priority, rerank_candidates, retrieval_metrics, retrieval_badcases, doc_candidates, diverse_docs, evidence_select, citations, page_overlap_join, page_overlap_all, seed_evenly_spaced, stratified_subset)}


def _words(n: str) -> str:
    runs = f"regexp_extract_all(lower({n}), '[a-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]+')"
    gram = "case when regexp_matches(r, '^[a-z0-9]') or length(r) <= 2 then [r] else list_transform(range(1, length(r)), lambda i: substring(r, cast(i as bigint), 2)) end"
    return f"flatten(list_transform({runs}, lambda r: {gram}))"


def _hits() -> str:
    from factloom.queries.texts import s_norm

    return f"""d as (select doc_id, {_words(s_norm('text'))} as ws from documents where text is not null), p0 as (select doc_id, len(ws) as dl, unnest(ws) as token from d),
    p as (select doc_id, token, count(*) as tf, any_value(dl) as dl from p0 group by 1, 2), tdf as (select token, count(*) as df from p group by 1), co as (select count(*) as n, avg(len(ws)) as avgdl from d),
    i0 as (select token, df, ln((n - df + 0.5) / (df + 0.5)) as raw from tdf, co), i1 as (select token, case when raw < 0 then 0.25 * (select avg(raw) from i0) else raw end as idf from i0),
    asked as (select doc_id as query_id, title from documents where doc_id % 100 = 0 and title is not null), q as (select query_id, token, count(*) as qf from (select query_id, unnest({_words(s_norm('title'))}) as token from asked) group by 1, 2),
    sc as (select query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from q join i1 using (token) join p using (token), co group by 1, 2),
    bm as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc) where rk <= {K}),
    tq as (select query_id, unnest(list_distinct({_words(s_norm('title'))})) as token from asked), tn as (select query_id, count(*) as n from tq group by 1), th as (select doc_id, unnest(list_distinct({_words(s_norm('title'))})) as token from documents where title is not null),
    ts as (select query_id, doc_id, round(m / n, 6) as score from (select query_id, doc_id, count(*) as m from th join tq using (token) group by 1, 2) join tn using (query_id)),
    ti as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from ts) where rk <= {K}),
    ta as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as title_score from ti window w as (partition by query_id)),
    ba as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as bm25_score from bm window w as (partition by query_id)),
    fu as (select query_id, doc_id, coalesce(title_score, 0) as title_score, coalesce(bm25_score, 0) as bm25_score, round(0.6 * coalesce(title_score, 0) + 0.4 * coalesce(bm25_score, 0), 6) as score from ta full join ba using (query_id, doc_id)),
    hy as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from fu) where rk <= {K}),
    so as (select doc_id, coalesce(lower(trim(source)), '') as source, lower(trim(source)) as src, case when lower(lang) like 'zh%' or lower(lang) = 'cn' then 'zh' when lower(lang) like 'en%' then 'en' end as lang from documents)"""


def _oracle() -> dict[str, str]:
    from factloom.queries.texts import s_norm

    h = "with " + _hits()
    first = "select query_id, min(rk) as first from {} where query_id = doc_id group by 1"
    metric = "select '{m}' as method, count(*) as query_count, round(avg(case when first <= 5 then 1 else 0 end), 6) as recall_5, round(avg(case when first <= 10 then 1 else 0 end), 6) as recall_10, round(avg(case when first <= 10 then 1.0 / first else 0 end), 6) as mrr_10 from asked left join (" + first.format("{t}") + ") using (query_id)"
    n = s_norm("text")
    return {
        "bm25_topk": h + " select query_id, doc_id, score, rk from bm",
        "dense_topk": """with s as (select a.vec_id as query_id, b.vec_id, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from s) select * from r where rk <= 10""",
        "hybrid_topk": h + " select query_id, doc_id, round(title_score, 6) as title_score, round(bm25_score, 6) as bm25_score, score, rk from hy",
        "scoped_search": h + ", s2 as (select sc.query_id, sc.doc_id, sc.score, row_number() over (partition by sc.query_id order by sc.score desc, sc.doc_id) as rk from sc join so a on a.doc_id = sc.doc_id join so b on b.doc_id = sc.query_id where a.src = b.src) select * from s2 where rk <= 5",
        "domain_priority": h + ", s2 as (select bm.query_id, bm.doc_id, bm.rk, case when a.lang = b.lang then 0 when a.lang is null or b.lang is null then 1 else 2 end as bucket from bm join so a on a.doc_id = bm.doc_id join so b on b.doc_id = bm.query_id) select query_id, doc_id, bucket, row_number() over (partition by query_id order by bucket, rk) as new_rk from s2",
        "rerank_candidates": h + f""", th2 as (select doc_id, title, length(coalesce(text, '')) < 100 as thin from documents), e as (select hy.*, thin, title, count(*) filter (where not thin) over (partition by query_id) >= 5 as enough from hy join th2 using (doc_id)),
            s2 as (select e.query_id, e.doc_id, e.score, round(len(list_intersect(list_distinct({_words(s_norm('asked.title'))}), {_words(s_norm("coalesce(e.title, '')"))})) / greatest(len(list_distinct({_words(s_norm('asked.title'))})), 1), 6) as rerank from e join asked on asked.query_id = e.query_id where not (enough and thin)),
            s3 as (select *, row_number() over (partition by query_id order by rerank desc, score desc, doc_id) as rk from s2) select query_id, doc_id, rerank, rk from s3 where rk <= 5""",
        "retrieval_metrics": h + " " + " union all ".join(metric.format(m=m, t=t) for m, t in (("bm25", "bm"), ("title", "ti"), ("hybrid", "hy"))),
        "retrieval_badcases": h + " " + " union all ".join(f"select '{m}' as method, query_id from asked where query_id not in (select query_id from {t} where rk <= 10 and query_id = doc_id)" for m, t in (("bm25", "bm"), ("hybrid", "hy"))),
        "doc_candidates": h + ", s2 as (select bm.*, source, row_number() over (partition by query_id, source order by rk) as r from bm join so using (doc_id)), g as (select query_id, source, max(score) as best_score, round(sum(score) filter (where r <= 2), 6) as top2, count(*) as n_hits from s2 group by 1, 2) select *, row_number() over (partition by query_id order by top2 desc, source) as rk from g",
        "diverse_docs": h + ", s2 as (select bm.*, source, row_number() over (partition by query_id, source order by rk) as nth from bm join so using (doc_id)), s3 as (select query_id, doc_id, source, row_number() over (partition by query_id order by cast(nth > 1 as int), rk) as new_rk from s2) select * from s3 where new_rk <= 5",
        "evidence_select": h + ", s2 as (select query_id, doc_id, row_number() over (partition by query_id order by rk) as n from hy where title_score > 0) select query_id, doc_id, 'E' || n as evidence_id from s2 where n <= 5",
        "citations": f"""with c as (select claim_id, min(evidence_ids) as ids from claims group by 1), e as (select claim_id, unnest(range(len(ids))) as pos, unnest(ids) as ref from c),
            nm as (select chunk_id as ref, 0 as o, chunk_id, text from chunks union all select evidence_id, 1, chunk_id, text from chunks where evidence_id is not null), r as (select *, row_number() over (partition by ref order by o, chunk_id, text) as k from nm)
            select claim_id, pos, e.ref, chunk_id, substring({n}, 1, 180) || case when length({n}) > 180 then '...' else '' end as snippet from e join r on e.ref = r.ref and k = 1 where e.ref is not null""",
        "page_overlap_join": """with c as (select distinct doc_id, chunk_id, strategy_name, page_start, page_end from chunks where granularity = 'parent' and page_start is not null and page_end >= page_start)
            select a.chunk_id as a_id, b.chunk_id as b_id, least(a.page_end, b.page_end) - greatest(a.page_start, b.page_start) + 1 as n_pages from c a join c b on a.doc_id = b.doc_id and greatest(a.page_start, b.page_start) <= least(a.page_end, b.page_end) where a.strategy_name = 'title_aware' and b.strategy_name = 'table_protected'""",
        "page_overlap_all": """with c as (select distinct doc_id, chunk_id, strategy_name, granularity, page_start, page_end from chunks where page_start is not null and page_end >= page_start)
            select a.chunk_id as a_id, b.chunk_id as b_id, a.strategy_name as a_strategy, b.strategy_name as b_strategy, a.granularity as a_granularity, b.granularity as b_granularity, least(a.page_end, b.page_end) - greatest(a.page_start, b.page_start) + 1 as n_pages
            from c a join c b on a.doc_id = b.doc_id and a.strategy_name < b.strategy_name and greatest(a.page_start, b.page_start) <= least(a.page_end, b.page_end)""",
        "seed_evenly_spaced": """with t as (select lower(trim(source)) as source, doc_id, row_number() over (partition by lower(trim(source)) order by doc_id) - 1 as i, count(*) over (partition by lower(trim(source))) as n from documents where source is not null),
            w as (select distinct source, n, unnest(range(least(n, 5))) as ordinal from t) select t.source, cast(ordinal as int) as ordinal, doc_id from w join t on t.source = w.source and t.i = case when w.n <= 5 then ordinal else cast(floor(ordinal * (w.n - 1) / 4.0 + 0.5) as bigint) end""",
        "stratified_subset": "with r as (select coalesce(lower(trim(source)), '') as source, coalesce(lower(lang), '') as lang, doc_id, row_number() over (partition by coalesce(lower(trim(source)), ''), coalesce(lower(lang), '') order by published_at nulls first, doc_id) as rk from documents) select * from r where rk <= 10",
    }


ORACLE_SQL = _oracle()
