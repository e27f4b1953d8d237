"""Queries on evidence: sections and pages that carry noise, companions, pools of several methods, support of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import claims as cl
from factloom.queries import retrieval as rt
from factloom.queries.evaluation import _claims
from factloom.queries.texts import s_match, s_norm
from factloom.session import materialize, table

# Wording of disclaimers, of appendices, of pages exported from a portal, and of sections that carry noise.
DISCLAIMER = ("免责声明", "风险提示", "投资评级说明", "评级说明", "分析师声明", "法律声明", "披露声明")
APPENDIX = ("相关报告", "报告汇总", "图表目录", "附录", "投资评级说明", "评级说明")
WEB_EXPORT = ("www.eastmoney.com", "choice数据", "查看pdf原文", "研报大全", "数据中心", "热门个股", "相关基金", "回到顶部", "意见反馈")
NOISY_SECTION = ("相关报告", "报告汇总", "图表目录", "目录", "附录", "风险提示", "免责声明", "投资评级说明", "评级说明")
#: Penalty of a noisy section, and how many rows of each method enter a pool.
PENALTY, POOL_HYBRID = 0.25, 12
#: Score of a method without hits.
NO_SCORE = -999.0
#: Shares of a claim's terms that its evidence must hold to support it, and to support it well.
SUPPORTED, WELL = 0.25, 0.6


def tail_noise(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose wording and place in the report, or whose source, mark them as disclaimer, appendix or portal noise."""
    pages = table(spark, d, "doc_manifest").groupBy("doc_id").agg(F.max("page_count").alias("pages"))
    c = table(spark, d, "chunks").where("text is not null").select("chunk_id", "doc_id", "source_type", F.coalesce("page_start", F.lit(0)).alias("page"), "text").distinct().join(pages, "doc_id", "left")
    n, pages = tx.normalize(F.col("text")), F.coalesce("pages", F.lit(0))
    late = lambda least, share: (pages > 0) & (F.col("page") >= F.greatest(F.lit(least), F.floor(pages * share)))
    flags = {
        "disclaimer": late(2, 0.6) & n.rlike("|".join(DISCLAIMER)), "appendix": late(3, 0.5) & n.rlike("|".join(APPENDIX)),
        "web_export": (F.coalesce("source_type", F.lit("")) == "web_export_pdf") & F.lower(n).rlike("|".join(WEB_EXPORT).replace(".", "[.]")),
    }
    out = c.select("chunk_id", "source_type", *[x.cast("int").alias(k) for k, x in flags.items()], (n == "").cast("int").alias("blank")).distinct()
    return out.groupBy("source_type").agg(F.count("*").alias("n_chunks"), *[F.sum(k).alias(k) for k in flags], F.sum("blank").alias("blank"))


def section_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Penalty of every chunk whose section or file name speaks of a noisy section."""
    c = table(spark, d, "chunks").select("chunk_id", "section_title", "section_path", "file_name").distinct()
    noisy = lambda x: F.coalesce(F.col(x).rlike("|".join(NOISY_SECTION)), F.lit(False))
    return c.select("chunk_id", F.when(noisy("section_title") | noisy("section_path") | noisy("file_name"), PENALTY).otherwise(0.0).alias("penalty"))


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    """The text a child is read in: its own copy of the parent's, else the parent's, else its own; lengths only."""
    c = table(spark, d, "chunks").select("chunk_id", "parent_chunk_id", "text", "parent_text").distinct()
    parents = table(spark, d, "chunks").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("parent_chunk_id")).agg(F.max(F.length("text")).alias("n"))
    out = c.where("parent_chunk_id is not null").join(parents, "parent_chunk_id", "left")
    kind = F.when(F.col("parent_text").isNotNull(), "copy").when(F.col("n").isNotNull(), "parent").otherwise("own")
    return out.select("chunk_id", kind.alias("read_in"), F.coalesce(F.length("parent_text"), F.col("n"), F.length("text")).alias("n_chars"))


def companion_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Beside every table chunk, the longest paragraph of its section, else of its pages.

    The best paragraph per section and per page range is one aggregate, so no chunk is paired with all others.
    """
    c = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "doc_id", "section_path", "page_start", "page_end", "element_type", F.length("text").alias("n")).distinct()
    tables, prose = c.where("element_type = 'table'"), c.where("element_type = 'paragraph' and n is not null")
    top = F.min_by("chunk_id", F.struct(-F.col("n"), F.col("chunk_id")))
    by_section = prose.where("section_path is not null").groupBy("doc_id", "section_path").agg(top.alias("in_section"))
    by_pages = prose.where("page_start is not null and page_end is not null").groupBy("doc_id", "page_start", "page_end").agg(top.alias("on_pages"))
    out = tables.join(by_section, ["doc_id", "section_path"], "left").join(by_pages, ["doc_id", "page_start", "page_end"], "left")
    how = F.when(F.col("in_section").isNotNull(), "section").when(F.col("on_pages").isNotNull(), "pages").otherwise("none")
    return out.select("chunk_id", F.coalesce("in_section", "on_pages").alias("companion_id"), how.alias("how")).distinct()


def short_title(file_name: Column) -> Column:
    """Title of a report from its file name: what follows the publisher, else the whole stem."""
    stem = F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, "[：:](.*)$", 1), F.lit("")), stem)


def report_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles, month and day, kind of source and a key of every listed file; equal titles get a hash of the name."""
    m = table(spark, d, "doc_manifest").where("file_name is not null").select("file_name").distinct()
    title = short_title(F.col("file_name"))
    rows = m.select("file_name", title.alias("title"), tx.match_form(title).alias("base"))
    n = rows.groupBy("base").agg(F.count("*").alias("n_same"))
    rows = rows.join(n, "base")
    key = F.when(F.col("n_same") > 1, F.concat("base", F.lit("-"), F.substring(F.sha1(F.col("file_name").cast("binary")), 1, 8))).otherwise(F.col("base"))
    day = F.regexp_extract("file_name", r"(?:19|20)[0-9]{2}-([0-9]{2})-([0-9]{2})", 1)
    label = F.concat(day, F.regexp_extract("file_name", r"(?:19|20)[0-9]{2}-([0-9]{2})-([0-9]{2})", 2))
    portal = F.lower("file_name").rlike("eastmoney|东方财富|财经网|股吧")
    return rows.select("file_name", "title", key.alias("doc_key"), label.alias("period_label"), F.when(portal, "web_export_pdf").otherwise("report_pdf").alias("guessed_source"), "n_same")


def report_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' reports found in the list by id, else by file name, else by title in matching form, each an equi-join."""
    m = table(spark, d, "doc_manifest").where("doc_id is not null").select("doc_id", "file_name").distinct()
    asked = table(spark, d, "chunks").select("doc_id", "file_name").distinct().withColumn("title", tx.match_form(short_title(F.col("file_name"))))
    ids = m.select("doc_id", F.col("doc_id").alias("by_id")).distinct()
    files = m.where("file_name is not null").groupBy("file_name").agg(F.min("doc_id").alias("by_file"))
    titles = m.where("file_name is not null").groupBy(tx.match_form(short_title(F.col("file_name"))).alias("title")).agg(F.min("doc_id").alias("by_title"))
    out = asked.join(ids, "doc_id", "left").join(files, "file_name", "left").join(titles, "title", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_file").isNotNull(), "file").when(F.col("by_title").isNotNull(), "title").otherwise("none")
    return out.select("doc_id", "file_name", F.coalesce("by_id", "by_file", "by_title").alias("resolved"), how.alias("how"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bm25, title = materialize(rt._bm25(spark, d), "bm25"), materialize(rt._title_hits(spark, d), "titles")
    return bm25, title, materialize(rt._fused(title, bm25), "hybrid")


def evidence_pool(spark: SparkSession, d: str) -> DataFrame:
    """Hits of several methods in one list per query: hybrid first, then titles, then BM25; each document once, where it first stands."""
    bm25, title, hybrid = _lists(spark, d)
    rows = None
    for order, hits in enumerate((hybrid.where(F.col("rk") <= POOL_HYBRID), title, bm25)):
        one = hits.select("query_id", "doc_id", F.lit(order).alias("o"), "rk")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("o", "rk")).alias("f"), F.count("*").alias("n_lists"))
    w = Window.partitionBy("query_id").orderBy("f")
    return first.select("query_id", "doc_id", F.row_number().over(w).alias("place"), F.col("f.o").alias("list"), "n_lists")


def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best score of each method per query (NO_SCORE without hits), with the documents and sources found."""
    bm25, title, hybrid = _lists(spark, d)
    out = rt._asked(spark, d).select("query_id")
    for name, hits in (("bm25", bm25), ("title", title), ("hybrid", hybrid)):
        out = out.join(hits.where("rk = 1").select("query_id", F.col("score").alias(f"{name}_top")), "query_id", "left")
    source = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    n = hybrid.join(source, "doc_id").groupBy("query_id").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    return out.join(n, "query_id", "left").na.fill(NO_SCORE, ["bm25_top", "title_top", "hybrid_top"]).na.fill(0, ["n_docs", "n_sources"])


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two methods per query, the query's own document being the answer: a query without it is a failed row, not a missing one."""
    bm25, _, hybrid = _lists(spark, d)
    out = rt._asked(spark, d).select("query_id")
    for name, hits in (("base", bm25), ("new", hybrid)):
        out = out.join(hits.where("query_id = doc_id").select("query_id", F.col("rk").alias(name)), "query_id", "left")
    status = lambda c: F.when(F.col(c).isNull(), "failed").when(F.col(c) <= 5, "hit").otherwise("late")
    return out.select("query_id", status("base").alias("base_status"), status("new").alias("new_status"), (F.col("base") - F.col("new")).alias("gain"))


def shared_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand in the titles of at least two of a query's five best documents: a top-5 report."""
    hits = rt._bm25(spark, d).where("rk <= 5").select("query_id", "doc_id")
    words = table(spark, d, "documents").where("title is not null").select("doc_id", F.explode(F.array_distinct(tx.words(F.col("title")))).alias("term"))
    rows = hits.join(words, "doc_id").where(F.length("term") > 1).groupBy("query_id", "term").agg(F.count("*").alias("n_docs")).where("n_docs >= 2")
    w = Window.partitionBy("query_id").orderBy(F.desc("n_docs"), "term")
    return rows.withColumn("rk", F.row_number().over(w)).where("rk <= 5")


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """How far the cited evidence supports each claim: figures and terms it holds, reports, agreement, and a verdict in order of rules."""
    c = _claims(spark, d).select("claim_id", F.coalesce("text", F.lit("")).alias("text"), "evidence_ids")
    rows = cl.evidence(c, table(spark, d, "chunks")).join(c.select("claim_id", "text"), "claim_id")
    mine, theirs = F.array_distinct(tx.words(F.col("text"))), F.array_distinct(tx.words(F.coalesce("evidence_text", F.lit(""))))
    each = rows.select("claim_id", "doc_id", F.explode_outer(F.array_intersect(mine, theirs)).alias("term"), F.size(mine).alias("n_terms"))
    terms = each.groupBy("claim_id").agg(F.countDistinct("term").alias("held"), F.max("n_terms").alias("n_terms"), F.countDistinct("doc_id").alias("n_docs"))
    figures = rows.select("claim_id", F.explode(cl.figures(F.col("text"))).alias("figure"), "evidence_text")
    figures = figures.withColumn("there", F.contains(F.coalesce("evidence_text", F.lit("")), F.col("figure"))).groupBy("claim_id", "figure").agg(F.bool_or("there").alias("there"))
    figures = figures.groupBy("claim_id").agg(F.count("*").alias("n_figures"), F.count_if("there").alias("held_figures"))
    out = c.select("claim_id").join(terms, "claim_id", "left").join(figures, "claim_id", "left").na.fill(0)
    coverage = F.round(F.col("held") / F.greatest(F.col("n_terms"), F.lit(1)), 6)
    out = out.withColumn("coverage", coverage)
    verdict = (
        F.when(F.col("n_docs") == 0, "no_evidence").when(F.col("held_figures") < F.col("n_figures"), "missing_figures").when(F.col("coverage") < SUPPORTED, "low_coverage")
        .when(F.col("coverage") >= WELL, "well_supported").otherwise("supported")
    )
    return out.select("claim_id", "n_docs", "n_figures", "held_figures", "coverage", verdict.alias("verdict"))


def answer_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Claims as answers, by recorded method: supported and cited shares, and precision and recall of withholding."""
    c = _claims(spark, d).select("claim_id", F.coalesce("verification.method", F.lit("none")).alias("method"), F.col("verification.status").alias("status"))
    rows = c.join(claim_support(spark, d), "claim_id")
    withheld = F.coalesce(F.col("status") == "INSUFFICIENT", F.lit(False))
    should = F.col("verdict").isin("no_evidence", "low_coverage")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(1.0)), 6)
    return rows.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("n_docs") > 0).cast("int")), 6).alias("cited_rate"), F.round(F.avg(F.col("verdict").isin("supported", "well_supported").cast("int")), 6).alias("supported_rate"),
        ratio(withheld & should, withheld).alias("withheld_precision"), ratio(withheld & should, should).alias("withheld_recall"),
    )


def badcases(spark: SparkSession, d: str) -> DataFrame:
    """Claims that came out wrong, grouped by what is known of them, most frequent first by count and key."""
    c = _claims(spark, d).select("claim_id", "claim_type", "is_core", F.col("verification.method").alias("method"), F.col("verification.status").alias("status"), F.col("calculation_id").isNotNull().alias("calculated"))
    rows = c.join(claim_support(spark, d), "claim_id")
    bad = rows.where("(status = 'ENTAILED') <> (verdict in ('supported', 'well_supported')) and status is not null")
    return bad.groupBy("claim_type", "is_core", "method", "status", "calculated", "verdict").agg(F.count("*").alias("n"))


def citation_spans(spark: SparkSession, d: str) -> DataFrame:
    """Facts' citations against the chunks they name: same report, page within the chunk's pages; shares by metric."""
    f = table(spark, d, "facts").where("evidence_id is not null").select("fact_id", "metric", F.col("evidence_id").alias("ref"), "doc_id", "page").distinct()
    t = cl.targets(table(spark, d, "chunks")).select("ref", "chunk_id", F.col("doc_id").alias("chunk_doc"))
    p = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("page_start").alias("a"), F.max("page_end").alias("b"))
    rows = f.join(t, "ref", "left").join(p, "chunk_id", "left")
    found, doc, page = F.col("chunk_id").isNotNull(), F.coalesce(F.col("chunk_doc") == F.col("doc_id"), F.lit(False)), F.coalesce(F.col("page").between(F.col("a"), F.col("b")), F.lit(False))
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    return rows.groupBy("metric").agg(F.count("*").alias("n"), share(found).alias("found_rate"), share(found & doc).alias("doc_hit_rate"), share(found & doc & page).alias("span_hit_rate"))


def snippet_matches(spark: SparkSession, d: str) -> DataFrame:
    """Children against the parents they name: one text holds the other in matching form, or neither."""
    c = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("parent_chunk_id").alias("parent"))
    parents = c.select(F.col("chunk_id").alias("parent"), F.col("text").alias("parent_text"))
    a, b = tx.match_form(F.coalesce("text", F.lit(""))), tx.match_form(F.coalesce("parent_text", F.lit("")))
    kind = F.when((a == "") | (b == ""), "empty").when(a == b, "equal").when(F.contains(b, a), "inside").when(F.contains(a, b), "holds").otherwise("apart")
    return c.where("parent is not null").join(parents, "parent").select("chunk_id", kind.alias("kind"))


def table_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Table chunks as groups of ten rows, each under the two header lines; a last group under five joins the one before."""
    c = table(spark, d, "chunks").where("element_type = 'table' and text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    c = c.withColumn("ls", tx.lines(tx.normalize(F.col("text"))))
    body = F.greatest(F.size("ls") - 2, F.lit(0))
    rest = body % 10
    groups = F.when(body == 0, 1).when((body > 10) & (rest > 0) & (rest < 5), F.floor(body / 10)).otherwise(F.ceil(body / 10)).cast("int")
    c = c.select("chunk_id", "ls", body.cast("int").alias("body"), groups.alias("n_groups")).withColumn("group_no", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    size = F.when(F.col("group_no") == F.col("n_groups") - 1, F.col("body") - 10 * F.col("group_no")).otherwise(10)
    text = F.array_join(F.concat(F.slice("ls", 1, 2), F.when(size > 0, F.slice("ls", 3 + 10 * F.col("group_no"), size)).otherwise(F.array())), "\n")
    return c.select("chunk_id", "group_no", size.cast("int").alias("n_rows"), F.sha1(text.cast("binary")).alias("text_sha1"))


def source_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Listed reports per industry and kind of source against an equal share, with what lacks."""
    m = table(spark, d, "doc_manifest").where("doc_id is not null").select("doc_id", F.coalesce("industry", F.lit("")).alias("industry"), "source_type").distinct()
    n = m.groupBy("industry", "source_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("source_type").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.join(whole, "source_type").select("industry", "source_type", "n", F.floor(F.col("total") / F.col("k")).alias("quota"), F.greatest(F.floor(F.col("total") / F.col("k")) - F.col("n"), F.lit(0)).alias("lacks"))


QUERIES = {
    f.__name__: f
    for f in (
        tail_noise, section_penalty, parent_expand, companion_chunks, report_titles, report_resolve, evidence_pool, retrieval_scores, method_comparison, shared_terms, claim_support, answer_evaluation, badcases, citation_spans,
        snippet_matches, table_row_groups, source_quotas,
    )
}


def _oracle() -> dict[str, str]:
    n, h = s_norm("text"), "with " + rt._hits()
    alt = lambda words: "|".join(words).replace(".", "[.]")
    stem = lambda x: f"regexp_replace({x}, '\\.[A-Za-z0-9]+$', '')"
    title = lambda x: f"coalesce(nullif(regexp_extract({stem(x)}, '[：:](.*)$', 1), ''), {stem(x)})"
    words = lambda x: f"list_distinct({rt._words(x)})"
    claims = "c as (select claim_id, arg_min(struct_pack(t := text, e := evidence_ids, v := verification, y := claim_type, k := is_core, q := calculation_id), loaded_at) as r from claims where claim_id is not null group by 1)"
    targets = "tg as (select ref, min(struct_pack(o := o, chunk_id := chunk_id, doc_id := doc_id)) as r from (select chunk_id as ref, 0 as o, chunk_id, doc_id from chunks union all select evidence_id, 1, chunk_id, doc_id from chunks where evidence_id is not null) group by 1)"
    support = f"""with {claims}, {targets}, tx as (select chunk_id, doc_id, min(text) as text from chunks group by 1, 2),
        ev as (select distinct claim_id, tg.r.chunk_id as chunk_id, tg.r.doc_id as doc_id from (select claim_id, unnest(r.e) as ref from c) x join tg on tg.ref = x.ref), rows_ as (select ev.*, coalesce(c.r.t, '') as t, coalesce(tx.text, '') as e from ev join tx on tx.chunk_id = ev.chunk_id and tx.doc_id is not distinct from ev.doc_id join c on c.claim_id = ev.claim_id),
        it as (select claim_id, count(distinct term) as held from (select claim_id, unnest(list_intersect({words("t")}, {words("e")})) as term from rows_) group by 1), ms as (select claim_id, count(distinct doc_id) as n_docs, max(len({words("t")})) as n_terms from rows_ group by 1),
        fg as (select claim_id, count(*) as n_figures, count(*) filter (where there) as held_figures from (select claim_id, figure, bool_or(contains(e, figure)) as there from (select claim_id, e, unnest(list_distinct(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?%?'))) as figure from rows_) group by 1, 2) group by 1),
        s0 as (select c.claim_id, coalesce(n_docs, 0) as n_docs, coalesce(n_figures, 0) as n_figures, coalesce(held_figures, 0) as held_figures, round(coalesce(held, 0) / greatest(coalesce(n_terms, 0), 1), 6) as coverage from c left join ms using (claim_id) left join it using (claim_id) left join fg using (claim_id)),
        su as (select *, case when n_docs = 0 then 'no_evidence' when held_figures < n_figures then 'missing_figures' when coverage < {SUPPORTED} then 'low_coverage' when coverage >= {WELL} then 'well_supported' else 'supported' end as verdict from s0)"""
    return {
        "tail_noise": f"""with p as (select doc_id, max(page_count) as pages from doc_manifest group by 1), c as (select distinct chunk_id, doc_id, source_type, coalesce(page_start, 0) as page, text from chunks where text is not null),
            f as (select distinct chunk_id, source_type, cast(coalesce(pages, 0) > 0 and page >= greatest(2, floor(pages * 0.6)) and regexp_matches({n}, '{alt(DISCLAIMER)}') as int) as disclaimer, cast(coalesce(pages, 0) > 0 and page >= greatest(3, floor(pages * 0.5)) and regexp_matches({n}, '{alt(APPENDIX)}') as int) as appendix,
            cast(coalesce(source_type, '') = 'web_export_pdf' and regexp_matches(lower({n}), '{alt(WEB_EXPORT)}') as int) as web_export, cast({n} = '' as int) as blank from c left join p using (doc_id))
            select source_type, count(*) as n_chunks, sum(disclaimer) as disclaimer, sum(appendix) as appendix, sum(web_export) as web_export, sum(blank) as blank from f group by 1""",
        "section_penalty": f"select chunk_id, case when regexp_matches(coalesce(section_title, ''), '{alt(NOISY_SECTION)}') or regexp_matches(coalesce(section_path, ''), '{alt(NOISY_SECTION)}') or regexp_matches(coalesce(file_name, ''), '{alt(NOISY_SECTION)}') then {PENALTY} else 0.0 end as penalty from (select distinct chunk_id, section_title, section_path, file_name from chunks)",
        "parent_expand": "with p as (select chunk_id, max(length(text)) as n from chunks where chunk_id is not null group by 1) select c.chunk_id, case when parent_text is not null then 'copy' when n is not null then 'parent' else 'own' end as read_in, coalesce(length(parent_text), n, length(text)) as n_chars from (select distinct chunk_id, parent_chunk_id, text, parent_text from chunks where parent_chunk_id is not null) c left join p on p.chunk_id = c.parent_chunk_id",
        "companion_chunks": """with c as (select distinct chunk_id, doc_id, section_path, page_start, page_end, element_type, length(text) as n from chunks where chunk_id is not null), p as (select * from c where element_type = 'paragraph' and n is not null),
            s as (select doc_id, section_path, arg_min(chunk_id, (-n, chunk_id)) as x from p where section_path is not null group by 1, 2), g as (select doc_id, page_start, page_end, arg_min(chunk_id, (-n, chunk_id)) as y from p where page_start is not null and page_end is not null group by 1, 2, 3)
            select distinct chunk_id, coalesce(x, y) as companion_id, case when x is not null then 'section' when y is not null then 'pages' else 'none' end as how from c left join s using (doc_id, section_path) left join g using (doc_id, page_start, page_end) where element_type = 'table'""",
        "report_titles": f"""with m as (select distinct file_name, {title('file_name')} as title, {s_match(title('file_name'))} as base from doc_manifest where file_name is not null), k as (select *, count(*) over (partition by base) as n_same from m)
            select file_name, title, case when n_same > 1 then base || '-' || substring(sha1(file_name), 1, 8) else base end as doc_key, regexp_extract(file_name, '(?:19|20)[0-9]{{2}}-([0-9]{{2}})-([0-9]{{2}})', 1) || regexp_extract(file_name, '(?:19|20)[0-9]{{2}}-([0-9]{{2}})-([0-9]{{2}})', 2) as period_label,
            case when regexp_matches(lower(file_name), 'eastmoney|东方财富|财经网|股吧') then 'web_export_pdf' else 'report_pdf' end as guessed_source, n_same from k""",
        "report_resolve": f"""with m as (select distinct doc_id, file_name from doc_manifest where doc_id is not null), a as (select distinct doc_id, file_name, {s_match(title('file_name'))} as title from chunks), i as (select distinct doc_id from m), f as (select file_name, min(doc_id) as x from m where file_name is not null group by 1), t as (select {s_match(title('file_name'))} as title, min(doc_id) as y from m where file_name is not null group by 1)
            select a.doc_id, a.file_name, coalesce(i.doc_id, x, y) as resolved, case when i.doc_id is not null then 'id' when x is not null then 'file' when y is not null then 'title' else 'none' end as how from a left join i on i.doc_id = a.doc_id left join f on f.file_name = a.file_name left join t on t.title = a.title""",
        "evidence_pool": h + f""", u as (select query_id, doc_id, 0 as o, rk from hy where rk <= {POOL_HYBRID} union all select query_id, doc_id, 1, rk from ti union all select query_id, doc_id, 2, rk from bm), f as (select query_id, doc_id, min(struct_pack(o := o, rk := rk)) as f, count(*) as n_lists from u group by 1, 2)
            select query_id, doc_id, row_number() over (partition by query_id order by f) as place, f.o as list, n_lists from f""",
        "retrieval_scores": h + f""", n as (select query_id, count(*) as n_docs, count(distinct src) as n_sources from hy join so using (doc_id) group by 1)
            select asked.query_id, coalesce(b.score, {NO_SCORE}) as bm25_top, coalesce(t.score, {NO_SCORE}) as title_top, coalesce(y.score, {NO_SCORE}) as hybrid_top, coalesce(n_docs, 0) as n_docs, coalesce(n_sources, 0) as n_sources from asked left join bm b on b.query_id = asked.query_id and b.rk = 1 left join ti t on t.query_id = asked.query_id and t.rk = 1 left join hy y on y.query_id = asked.query_id and y.rk = 1 left join n on n.query_id = asked.query_id""",
        "method_comparison": h + """, x as (select asked.query_id, b.rk as a, y.rk as c from asked left join bm b on b.query_id = asked.query_id and b.doc_id = asked.query_id left join hy y on y.query_id = asked.query_id and y.doc_id = asked.query_id)
            select query_id, case when a is null then 'failed' when a <= 5 then 'hit' else 'late' end as base_status, case when c is null then 'failed' when c <= 5 then 'hit' else 'late' end as new_status, a - c as gain from x""",
        "shared_terms": h + ", g as (select query_id, term, count(*) as n_docs from bm join (select doc_id, token as term from th) using (doc_id) where rk <= 5 and length(term) > 1 group by 1, 2 having count(*) >= 2), r as (select *, row_number() over (partition by query_id order by n_docs desc, term) as rk from g) select * from r where rk <= 5",
        "claim_support": support + " select * from su",
        "answer_evaluation": support + """ select coalesce(c.r.v.method, 'none') as method, count(*) as n, round(avg(cast(n_docs > 0 as int)), 6) as cited_rate, round(avg(cast(verdict in ('supported', 'well_supported') as int)), 6) as supported_rate,
            round(coalesce(count(*) filter (where c.r.v.status = 'INSUFFICIENT' and verdict in ('no_evidence', 'low_coverage')) / nullif(count(*) filter (where c.r.v.status = 'INSUFFICIENT'), 0), 1.0), 6) as withheld_precision,
            round(coalesce(count(*) filter (where c.r.v.status = 'INSUFFICIENT' and verdict in ('no_evidence', 'low_coverage')) / nullif(count(*) filter (where verdict in ('no_evidence', 'low_coverage')), 0), 1.0), 6) as withheld_recall from su join c using (claim_id) group by 1""",
        "badcases": support + " select c.r.y as claim_type, c.r.k as is_core, c.r.v.method as method, c.r.v.status as status, c.r.q is not null as calculated, verdict, count(*) as n from su join c using (claim_id) where c.r.v.status is not null and (c.r.v.status = 'ENTAILED') <> (verdict in ('supported', 'well_supported')) group by all",
        "citation_spans": f"""with {targets}, p as (select chunk_id, min(page_start) as a, max(page_end) as b from chunks where chunk_id is not null group by 1), f as (select distinct fact_id, metric, evidence_id as ref, doc_id, page from facts where evidence_id is not null),
            x as (select metric, tg.r.chunk_id is not null as found, coalesce(tg.r.doc_id = f.doc_id, false) as doc, coalesce(page between a and b, false) as pg from f left join tg on tg.ref = f.ref left join p on p.chunk_id = tg.r.chunk_id)
            select metric, count(*) as n, round(avg(cast(found as int)), 6) as found_rate, round(avg(cast(found and doc as int)), 6) as doc_hit_rate, round(avg(cast(found and doc and pg as int)), 6) as span_hit_rate from x group by 1""",
        "snippet_matches": f"""with c as (select chunk_id, min(text) as text, min(parent_chunk_id) as parent from chunks where chunk_id is not null group by 1), m as (select chunk_id, parent, {s_match("coalesce(text, '')")} as t from c)
            select a.chunk_id, case when a.t = '' or b.t = '' then 'empty' when a.t = b.t then 'equal' when contains(b.t, a.t) then 'inside' when contains(a.t, b.t) then 'holds' else 'apart' end as kind from m a join m b on a.parent = b.chunk_id""",
        "table_row_groups": f"""with c as (select chunk_id, min(text) as text from chunks where element_type = 'table' and text is not null group by 1), l as (select chunk_id, string_split({n}, chr(10)) as ls from c), b as (select *, greatest(len(ls) - 2, 0) as body from l),
            g as (select *, cast(case when body = 0 then 1 when body > 10 and body % 10 between 1 and 4 then floor(body / 10) else ceil(body / 10) end as int) as n_groups from b), e as (select *, unnest(range(n_groups)) as group_no from g),
            z as (select *, case when group_no = n_groups - 1 then body - 10 * group_no else 10 end as size from e)
            select chunk_id, cast(group_no as int) as group_no, cast(size as int) as n_rows, sha1(array_to_string(list_concat(ls[1:2], case when size > 0 then ls[3 + 10 * group_no : 2 + 10 * group_no + size] else [] end), chr(10))) as text_sha1 from z""",
        "source_quotas": """with m as (select distinct doc_id, coalesce(industry, '') as industry, source_type from doc_manifest where doc_id is not null), n as (select industry, source_type, count(*) as n from m group by 1, 2), w as (select source_type, sum(n) as total, count(*) as k from n group by 1)
            select industry, n.source_type, n, floor(total / k) as quota, greatest(floor(total / k) - n, 0) as lacks from n join w on w.source_type = n.source_type""",
    }


ORACLE_SQL = _oracle()
