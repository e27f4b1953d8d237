"""Queries on texts, lines, names and chunks."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.session import table

# ---- the same expressions for the checking SQL
_W = tx.WS


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def s_norm(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '\\x{{A0}}', ' ', 'g'), '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\x{{3000}}]+', ' ', 'g')"
    return s_strip(f"regexp_replace({x}, '{_W}*\\n{_W}*', chr(10), 'g')")


def s_match(x: str) -> str:
    return f"lower(regexp_replace({s_norm(x)}, '[^0-9A-Za-z\\x{{4E00}}-\\x{{9FFF}}]+', '', 'g'))"


def s_like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def s_noise(n: str) -> str:
    """On an already normalised column."""
    words = f"list_filter(string_split_regex({n}, '{_W}+'), lambda w: w <> '')"
    return (
        f"({n} = '' or regexp_matches(lower({n}), '^(第?\\s*[0-9]+\\s*页|page\\s*[0-9]+|[0-9]+\\s*/\\s*[0-9]+)$') or regexp_matches(lower({n}), '{'|'.join(tx.PORTAL)}')"
        f" or (length({n}) > 120 and length(regexp_replace({n}, '[^0-9]', '', 'g')) > 20) or (len({words}) > 20 and len(list_distinct({words})) < len({words}) * 0.4))"
    )


def s_table_like(n: str) -> str:
    ls = f"string_split({n}, chr(10))"
    words = " + ".join(f"len(list_filter({ls}, lambda w: contains(w, '{w}')))" for w in ("亿元", "万元", "同比", "环比", "pct", "%", "市盈率", "毛利率"))
    return (
        f"({n} <> '' and len({ls}) >= 2 and ((len(regexp_extract_all({n}, '[0-9]+(?:\\.[0-9]+)?%?')) >= 4 and len(list_filter({ls}, lambda w: length(w) <= 40)) * 2 >= len({ls}))"
        f" or len(regexp_extract_all({n}, ' \\| ')) >= 2 or ({words}) >= 5))"
    )


def s_first(n: str, most: int) -> str:
    s = f"coalesce(list_extract(list_filter(list_transform(string_split_regex({n}, '[。！？!?;\\n]'), lambda w: {s_strip('w')}), lambda w: w <> ''), 1), {n})"
    return f"regexp_replace(substring({s}, 1, {most}), '[，,；; ]+$', '') || case when length({s}) > {most} then '...' else '' end"


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.length(tx.normalize(F.col("text"))).alias("norm_len"), F.length(tx.match_form(F.col("text"))).alias("match_len"), F.sha1(tx.match_form(F.col("text")).cast("binary")).alias("match_sha1"))


def text_numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(tx.numeric_tokens(F.col("text"))).alias("n_numeric"))


def text_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


def text_terms_topk(spark: SparkSession, d: str) -> DataFrame:
    """Eight most frequent terms of each document; ties by first place.  A document is one row, so nothing is shuffled."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.runs(F.col("text")).alias("runs"))

    def count(batches):
        for b in batches:
            out = []
            for doc, runs in zip(b["doc_id"], b["runs"], strict=True):
                n = Counter(g for r in runs for g in tx.grams(r))  # keeps the order of first places
                for w in tx.STOPWORDS:
                    n.pop(w, None)
                out += [(doc, term, tf, i + 1) for i, (term, tf) in enumerate(n.most_common(8))]
            yield pd.DataFrame(out, columns=["doc_id", "term", "tf", "rk"])

    return t.mapInPandas(count, "doc_id bigint, term string, tf bigint, rk int")


def text_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    ls = F.split("text", "\n")
    return t.select("doc_id", F.size(ls).alias("n_lines"), F.size(F.filter(ls, tx.is_noise_line)).alias("n_noise"))


def text_title_like(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunks")
    return t.groupBy("chunk_id").agg(F.max(F.size(F.filter(F.split("text", "\n"), tx.is_title_like))).alias("n_title"), F.max(tx.is_title_like(F.col("section_title")).cast("int")).alias("section_is_title"))


def text_table_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.max(tx.is_table_like(F.col("text")).cast("int")).alias("is_table"))


def support_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", tx.support_span(F.col("text")).alias("span")).distinct()


def domain_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_manifest").select("doc_id", tx.industry(F.col("file_name")).alias("domain")).distinct()


def file_name_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids derived from file names, and whether the stored id agrees."""
    t = table(spark, d, "doc_manifest").select("doc_id", tx.doc_id(F.col("file_name")).alias("derived_id"), F.regexp_extract("file_name", r"^[^_]+_([0-9]{4}-[0-9]{2}-[0-9]{2})_", 1).alias("file_date")).distinct()
    return t.withColumn("same", (F.col("doc_id") == F.col("derived_id")).cast("int"))


def route_question_type(spark: SparkSession, d: str) -> DataFrame:
    """Claims read as questions: comparison, induction or fact, and whether a figure is asked for."""
    t = table(spark, d, "claims").where("text is not null").select("claim_id", "text").distinct()
    return t.select("claim_id", tx.question_mode(F.col("text")).alias("mode"), tx.normalize(F.col("text")).rlike(tx.NUMERIC_HINTS).cast("int").alias("is_numeric"))


def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """First and last two lines of the chunks of a report that recur in at least two fifths of them (three at least)."""
    t = table(spark, d, "chunks").select("doc_id", "chunk_id", "text").distinct()
    n = t.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    ls = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "")
    edge = F.concat(F.slice("ls", 1, 2), F.slice("ls", F.greatest(F.size("ls") - 1, F.lit(1)), 2))
    t = t.withColumn("ls", ls).select("doc_id", F.explode(edge).alias("line"))
    key = F.lower(F.regexp_replace("line", r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]+", ""))
    t = t.withColumn("line_key", key).where((F.length("line_key") >= 3) & (F.length("line") <= 80) & ~tx.is_noise_line(F.col("line")))
    t = t.groupBy("doc_id", "line_key").agg(F.count("*").alias("n")).join(n.where("n_pages >= 3"), "doc_id")
    return t.where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.4))).select("doc_id", "line_key", "n", "n_pages")


def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """Characters left of each chunk once noise lines are dropped."""
    kept = F.filter(F.transform(F.split("text", "\n"), tx.normalize), lambda x: ~tx.is_noise_line(x))
    t = table(spark, d, "chunks").select("chunk_id", F.length(F.array_join(kept, "\n")).alias("cleaned_chars")).distinct()
    return t.withColumn("is_empty", (F.col("cleaned_chars") == 0).cast("int"))


TARGET, OVERLAP = 1050, 120


def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows over each normalised text; windows that hold only blanks fall away."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.normalize(F.col("text")).alias("t"))
    step = TARGET - OVERLAP
    n = F.when(F.length("t") <= TARGET, 1).otherwise(F.ceil((F.length("t") - TARGET) / F.lit(step)) + 1).cast("int")
    t = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
    t = t.select("doc_id", "chunk_idx", F.length(tx.strip(F.substring("t", F.col("chunk_idx") * step + 1, F.lit(TARGET)))).alias("char_count"))
    return t.where("char_count > 0")


def chunk_strategy_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean over reports of each strategy's chunk count, length and table share."""
    t = table(spark, d, "chunks").select("doc_id", "chunk_id", "strategy_name", "chunk_type", F.length("text").alias("n")).distinct()
    t = t.groupBy("doc_id", "strategy_name").agg(F.count("*").alias("c"), F.avg("n").alias("a"), F.avg((F.col("chunk_type") == "table_like").cast("int")).alias("r"))
    return t.groupBy("strategy_name").agg(F.round(F.avg("c"), 4).alias("avg_chunk_count"), F.round(F.avg("a"), 4).alias("avg_char_count"), F.round(F.avg("r"), 4).alias("avg_table_ratio"))


def corpus_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Share of empty, short and broken chunks and of tableless reports, and the decision they lead to."""
    t = table(spark, d, "chunks").select("doc_id", "chunk_id", "text", "element_type", "chunk_type").distinct()
    n = F.length("text")
    pages = t.agg(F.count("*").alias("page_count"), F.countDistinct("doc_id").alias("document_count"), F.avg((n == 0).cast("int")).alias("e"), F.avg(((n > 0) & (n < 50)).cast("int")).alias("l"), F.avg((F.length(F.regexp_replace("text", "[^�]", "")) >= 0.01 * F.greatest(n, F.lit(1))).cast("int")).alias("b"))
    docs = t.groupBy("doc_id").agg(F.max((F.col("element_type") == "table").cast("int")).alias("has_table"), F.max(F.col("chunk_type").isin("table_like", "table_parent").cast("int")).alias("has_chunk"))
    gap = docs.where("has_table = 1").agg(F.coalesce(F.avg((F.col("has_chunk") == 0).cast("int")), F.lit(0.0)).alias("g"))
    out = pages.join(gap, F.lit(True))  # two one-row tables
    bad = (F.col("e") >= 0.02) | (F.col("l") >= 0.1) | (F.col("b") >= 0.01) | (F.col("g") >= 0.1)
    decision = F.when(F.col("page_count") < 10, "INSUFFICIENT_DATA").when(bad, "PROMOTE").otherwise("KEEP")
    return out.select("page_count", "document_count", F.round("e", 6).alias("empty_ratio"), F.round("l", 6).alias("low_text_ratio"), F.round("b", 6).alias("broken_ratio"), F.round("g", 6).alias("table_gap_ratio"), decision.alias("decision"))


def doc_manifest_build(spark: SparkSession, d: str) -> DataFrame:
    """One row per report: chunks, distinct pages, best summary chunk and best fact chunk."""
    t = table(spark, d, "chunks").groupBy("doc_id", "chunk_id").agg(F.min("text").alias("text"), F.min("element_type").alias("element_type"), F.min("chunk_type").alias("chunk_type"), F.min("page_start").alias("ps"), F.min("page_end").alias("pe"))
    n, first = F.length(tx.normalize(F.col("text"))), F.greatest(F.coalesce("ps", F.lit(1)) - 1, F.lit(0))
    paragraph = F.when(F.col("element_type") == "paragraph", 30).when(F.col("element_type").isin("figure_context", "figure_caption"), 10).otherwise(0)
    summary = paragraph + F.when(F.col("chunk_type") != "table_like", 10).otherwise(0) + F.when(n.between(80, 320), 25).when(n.between(40, 420), 15).otherwise(0) + F.greatest(F.lit(0), 20 - first * 4)
    k = F.size(tx.numeric_tokens(F.col("text")))
    fact = k * 10 + F.when((F.col("chunk_type") == "table_like") | (F.col("element_type") == "table"), 30).otherwise(0) + F.when(n.between(40, 260), 15).when(n.between(20, 360), 5).otherwise(0) + F.greatest(F.lit(0), 15 - first * 3) - F.when(k == 0, 10).otherwise(0)
    t = t.withColumns({"s": summary, "f": fact})
    pages = F.explode(F.sequence("ps", F.greatest("ps", "pe")))
    distinct = t.where("ps is not null and pe is not null").select("doc_id", pages.alias("p")).distinct().groupBy("doc_id").agg(F.count("*").alias("page_count"))
    best = t.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.min_by("chunk_id", F.struct(-F.col("s"), "chunk_id")).alias("summary_chunk_id"), F.min_by("chunk_id", F.struct(-F.col("f"), "chunk_id")).alias("fact_chunk_id"))
    return best.join(distinct, "doc_id", "left")


QUERIES = {f.__name__: f for f in (text_normalize, text_numeric_tokens, text_first_sentence, text_terms_topk, text_noise_lines, text_title_like, text_table_like, support_spans, domain_classify, file_name_ids, route_question_type, boilerplate_lines, clean_pages, chunk_fixed_window, chunk_strategy_stats, corpus_quality_gate, doc_manifest_build)}

_TITLE = "(n <> '' and length(n) <= 60 and not {noise} and length(regexp_replace(n, '[^。；！？,，]', '', 'g')) <= 1 and regexp_matches(n, '^([0-9]+(\\.[0-9]+)*|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十0-9]+[章节部分])'))".format(noise=s_noise("n"))
_NUMS = "list_distinct(list_concat(list_concat(regexp_extract_all(n, '{}'), regexp_extract_all(n, '{}')), regexp_extract_all(n, '{}')))".format(tx.NUMERIC, tx.YEAR, tx.PERCENT)
_RUN = "[a-z]{2,}|[\\x{4E00}-\\x{9FFF}]{2,}"
_PREFIX = "case " + " ".join(f"when p = '{k}' then '{v}'" for k, v in tx.INDUSTRY_PREFIX.items()) + " " + " ".join(f"when regexp_matches(lower(stem), '{v}') then '{k}'" for k, v in tx.INDUSTRY_WORDS.items()) + " else 'other' end"

ORACLE_SQL = {
    "text_normalize": f"select doc_id, length({s_norm('text')}) as norm_len, length({s_match('text')}) as match_len, sha1({s_match('text')}) as match_sha1 from documents where text is not null",
    "text_numeric_tokens": f"select doc_id, len({_NUMS}) as n_numeric from (select doc_id, {s_norm('text')} as n from documents where text is not null)",
    "text_first_sentence": f"select doc_id, {s_first('n', 80)} as sentence from (select doc_id, {s_norm('text')} as n from documents where text is not null)",
    "text_terms_topk": f"""
        with runs as (select doc_id, unnest(rs) as r, unnest(range(len(rs))) as i from (select doc_id, regexp_extract_all(lower({s_norm('text')}), '{_RUN}') as rs from documents where text is not null)),
        long as (select * from runs where ord(r) >= 19968 and length(r) > 4),
        all_terms as (select doc_id, r as term, i * 100000 as ord from runs
            union all select doc_id, substring(r, cast(j as bigint), 2), i * 100000 + j from (select *, unnest(range(1, length(r))) as j from long)
            union all select doc_id, substring(r, cast(j as bigint), 3), i * 100000 + j + length(r) from (select *, unnest(range(1, length(r) - 1)) as j from long)),
        tf as (select doc_id, term, count(*) as tf, min(ord) as ord from all_terms where term not in ({', '.join(f"'{w}'" for w in tx.STOPWORDS)}) group by 1, 2),
        ranked as (select *, row_number() over (partition by doc_id order by tf desc, ord) as rk from tf)
        select doc_id, term, tf, rk from ranked where rk <= 8""",
    "text_noise_lines": f"""with l as (select doc_id, len(string_split(text, chr(10))) as n_lines, unnest(string_split(text, chr(10))) as line from documents where text is not null),
        m as (select doc_id, n_lines, {s_norm('line')} as n from l) select doc_id, n_lines, count(*) filter (where {s_noise('n')}) as n_noise from m group by 1, 2""",
    "text_title_like": f"""with c as (select distinct chunk_id, text, section_title from chunks), l as (select chunk_id, {s_norm('line')} as n from (select chunk_id, unnest(string_split(text, chr(10))) as line from c)),
        a as (select chunk_id, count(*) filter (where {_TITLE}) as n_title from l group by 1), b as (select chunk_id, max(case when {_TITLE} then 1 when n is null then null else 0 end) as section_is_title from (select chunk_id, {s_norm('section_title')} as n from c) group by 1)
        select chunk_id, n_title, section_is_title from a join b using (chunk_id)""",
    "text_table_like": f"select chunk_id, max(case when {s_table_like('n')} then 1 else 0 end) as is_table from (select chunk_id, {s_norm('text')} as n from chunks) group by 1",
    "support_spans": f"""select distinct chunk_id, case when n = '' then '' when {s_table_like('n')} then regexp_replace(substring(array_to_string(list_slice(string_split(n, chr(10)), 1, 3), ' | '), 1, 180), '\\s+$', '')
        else {s_first('n', 180)} end as span from (select chunk_id, {s_norm('text')} as n from chunks)""",
    "domain_classify": f"select distinct doc_id, {_PREFIX} as domain from (select doc_id, stem, regexp_extract(stem, '^([^_]+)_[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_[A-Za-z0-9]+_.+$', 1) as p from (select doc_id, regexp_replace(file_name, '\\.[A-Za-z0-9]+$', '') as stem from doc_manifest))",
    "file_name_ids": """with t as (select distinct doc_id, file_name, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_name, '\\.[A-Za-z0-9]+$', ''), '\\s+', '-', 'g'), '[^0-9A-Za-z\\x{4E00}-\\x{9FFF}_-]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from doc_manifest),
        u as (select doc_id, (case when slug = '' then 'doc' else substring(slug, 1, 48) end) || '-' || substring(sha1(file_name), 1, 8) as derived_id, regexp_extract(file_name, '^[^_]+_([0-9]{4}-[0-9]{2}-[0-9]{2})_', 1) as file_date from t)
        select distinct doc_id, derived_id, file_date, cast(doc_id = derived_id as int) as same from u""",
    "route_question_type": f"""select claim_id, case when regexp_matches(n, '{tx.COMPARISON}') then 'comparison' when regexp_matches(n, '{tx.INDUCTIVE}') then 'inductive' else 'fact' end as mode, cast(regexp_matches(n, '{tx.NUMERIC_HINTS}') as int) as is_numeric
        from (select claim_id, {s_norm('text')} as n from (select distinct claim_id, text from claims where text is not null))""",
    "boilerplate_lines": f"""with c as (select distinct doc_id, chunk_id, text from chunks), np as (select doc_id, count(*) as n_pages from c group by 1 having count(*) >= 3),
        l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda w: {s_strip('w')}), lambda w: w <> '') as ls from c),
        e as (select doc_id, unnest(list_concat(list_slice(ls, 1, 2), list_slice(ls, greatest(len(ls) - 1, 1), greatest(len(ls) - 1, 1) + 1))) as line from l),
        k as (select doc_id, line, lower(regexp_replace(line, '[^0-9A-Za-z\\x{{4E00}}-\\x{{9FFF}}]+', '', 'g')) as line_key, {s_norm('line')} as n from e)
        select doc_id, line_key, count(*) as n, n_pages from k join np using (doc_id) where length(line_key) >= 3 and length(line) <= 80 and not {s_noise('k.n')} group by doc_id, line_key, n_pages having count(*) >= greatest(3, floor(n_pages * 0.4))""",
    "clean_pages": f"""with c as (select distinct chunk_id, text from chunks), l as (select chunk_id, {s_norm('line')} as n from (select chunk_id, unnest(string_split(text, chr(10))) as line from c)),
        a as (select chunk_id, coalesce(sum(length(n) + 1) filter (where not {s_noise('n')}) - 1, 0) as cleaned_chars from l group by 1) select chunk_id, cast(cleaned_chars as int) as cleaned_chars, cast(cleaned_chars = 0 as int) as is_empty from a""",
    "chunk_fixed_window": f"""with t as (select doc_id, {s_norm('text')} as t from documents where text is not null),
        w as (select doc_id, t, unnest(range(case when length(t) <= {TARGET} then 1 else cast(ceil((length(t) - {TARGET}) / {TARGET - OVERLAP}.0) as int) + 1 end)) as chunk_idx from t),
        c as (select doc_id, cast(chunk_idx as int) as chunk_idx, length({s_strip(f"substring(t, chunk_idx * {TARGET - OVERLAP} + 1, {TARGET})")}) as char_count from w) select * from c where char_count > 0""",
    "chunk_strategy_stats": """with c as (select distinct doc_id, chunk_id, strategy_name, chunk_type, length(text) as n from chunks),
        p as (select doc_id, strategy_name, count(*) as c, avg(n) as a, avg(case when chunk_type = 'table_like' then 1 when chunk_type is null then null else 0 end) as r from c group by 1, 2)
        select strategy_name, round(avg(c), 4) as avg_chunk_count, round(avg(a), 4) as avg_char_count, round(avg(r), 4) as avg_table_ratio from p group by 1""",
    "corpus_quality_gate": """with t as (select distinct doc_id, chunk_id, text, element_type, chunk_type from chunks),
        p as (select count(*) as page_count, count(distinct doc_id) as document_count, avg(cast(length(text) = 0 as int)) as e, avg(cast(length(text) > 0 and length(text) < 50 as int)) as l, avg(cast(length(regexp_replace(text, '[^\\x{FFFD}]', '', 'g')) >= 0.01 * greatest(length(text), 1) as int)) as b from t),
        q as (select doc_id, max(cast(element_type = 'table' as int)) as ht, max(cast(chunk_type in ('table_like', 'table_parent') as int)) as hc from t group by 1), g as (select coalesce(avg(cast(hc = 0 as int)), 0.0) as g from q where ht = 1)
        select page_count, document_count, round(e, 6) as empty_ratio, round(l, 6) as low_text_ratio, round(b, 6) as broken_ratio, round(g, 6) as table_gap_ratio,
        case when page_count < 10 then 'INSUFFICIENT_DATA' when e >= 0.02 or l >= 0.1 or b >= 0.01 or g >= 0.1 then 'PROMOTE' else 'KEEP' end as decision from p, g""",
    "doc_manifest_build": f"""with t as (select doc_id, chunk_id, min(text) as text, min(element_type) as element_type, min(chunk_type) as chunk_type, min(page_start) as ps, min(page_end) as pe from chunks group by 1, 2),
        u as (select *, {s_norm('text')} as n, greatest(coalesce(ps, 1) - 1, 0) as first from t), v as (select *, length(n) as ln, len({_NUMS}) as k from u),
        s as (select *, case when element_type = 'paragraph' then 30 when element_type in ('figure_context', 'figure_caption') then 10 else 0 end + case when chunk_type <> 'table_like' then 10 else 0 end + case when ln between 80 and 320 then 25 when ln between 40 and 420 then 15 else 0 end + greatest(0, 20 - first * 4) as s,
          k * 10 + case when chunk_type = 'table_like' or element_type = 'table' then 30 else 0 end + case when ln between 40 and 260 then 15 when ln between 20 and 360 then 5 else 0 end + greatest(0, 15 - first * 3) - case when k = 0 then 10 else 0 end as f from v),
        rs as (select *, row_number() over (partition by doc_id order by s desc, chunk_id) as r1, row_number() over (partition by doc_id order by f desc, chunk_id) as r2 from s),
        pg as (select doc_id, count(distinct p) as page_count from (select doc_id, unnest(range(ps, greatest(ps, pe) + 1)) as p from t where ps is not null and pe is not null) group by 1)
        select doc_id, count(*) as chunk_count, max(case when r1 = 1 then chunk_id end) as summary_chunk_id, max(case when r2 = 1 then chunk_id end) as fact_chunk_id, any_value(page_count) as page_count from rs left join pg using (doc_id) group by 1""",
}
