"""Integrity of the stored records: one rule per row, with how many records break it, and a verdict per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import claims as cl
from factloom.operators import facts as ft
from factloom.queries.evaluation import _claims
from factloom.session import table

# Statuses and methods a verification may have.
STATUSES, METHODS = ("ENTAILED", "CONTRADICTED", "INSUFFICIENT"), ("numeric", "lexical", "semantic", "calculation")


def _count(rows: DataFrame, key: str, rules: dict[str, Column], name: str) -> DataFrame:
    """Distinct keys that break each rule, all rules in one pass over the rows."""
    broken = rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule")).distinct()
    every = rows.sparkSession.createDataFrame([(name, r) for r in rules], "table_name string, rule string")
    return every.join(broken.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("table_name", "rule", F.coalesce("n", F.lit(0)).alias("n"))


def _claim_rules(spark: SparkSession, d: str) -> DataFrame:
    c, chunks = _claims(spark, d), table(spark, d, "chunks")
    found = cl.evidence(c, chunks).groupBy("claim_id").agg(F.count("*").alias("n_found"), F.countDistinct("doc_id").alias("n_docs"))
    parents = c.select("claim_id", F.explode("parent_claim_ids").alias("p")).where("p is not null").distinct()
    parents = parents.join(c.select(F.col("claim_id").alias("p"), F.lit(1).alias("there"), F.col("verification.status").alias("p_status")), "p", "left")
    parents = parents.groupBy("claim_id").agg(F.count_if(F.col("there").isNull()).alias("p_missing"), F.count_if(F.col("p") == F.col("claim_id")).alias("p_self"), F.count_if(F.col("there").isNotNull() & ~F.coalesce(F.col("p_status") == "ENTAILED", F.lit(False))).alias("p_open"))
    rows = c.join(found, "claim_id", "left").join(parents, "claim_id", "left").na.fill(0, ["n_found", "n_docs", "p_missing", "p_self", "p_open"])
    v, entailed = F.col("verification"), F.coalesce(F.col("verification.status") == "ENTAILED", F.lit(False))
    steps, ids = F.coalesce("source_step_ids", F.array()), F.coalesce("evidence_ids", F.array())
    return _count(rows, "claim_id", {
        "no_verification": v.isNull(), "unknown_status": v.status.isNotNull() & ~v.status.isin(*STATUSES), "unknown_method": v.method.isNotNull() & ~v.method.isin(*METHODS), "score_out_of_range": v.score.isNotNull() & ~v.score.between(0, 1),
        "entailed_without_evidence": entailed & (F.col("n_found") == 0), "entailed_over_open_parent": entailed & (F.col("p_open") > 0), "core_not_entailed": F.coalesce("is_core", F.lit(False)) & ~entailed, "no_source_step": F.size(steps) == 0,
        "parent_missing": F.col("p_missing") > 0, "own_parent": F.col("p_self") > 0, "derived_without_calculation": F.coalesce(F.col("claim_type") == "DERIVED", F.lit(False)) & F.col("calculation_id").isNull(),
        "synthesized_from_one_report": F.coalesce(F.col("claim_type") == "SYNTHESIZED", F.lit(False)) & (F.col("n_docs") < 2), "extracted_from_several": F.coalesce(F.col("claim_type") == "EXTRACTED", F.lit(False)) & (F.col("n_docs") > 1),
        "evidence_not_found": (F.size(F.array_compact(ids)) > 0) & (F.col("n_found") == 0),
    }, "claims")


def _fact_rules(spark: SparkSession, d: str) -> DataFrame:
    f = ft.flat(table(spark, d, "facts"))
    metrics = table(spark, d, "metric_registry").select("metric", "dimension").dropDuplicates(["metric"])
    pages = table(spark, d, "doc_manifest").where("doc_id is not null").groupBy("doc_id").agg(F.max("page_count").alias("pages"), F.min("published_on").alias("published"))
    named = cl.targets(table(spark, d, "chunks")).select(F.col("ref").alias("evidence_id"), F.col("doc_id").alias("chunk_doc"))
    rows = f.join(metrics, "metric", "left").join(pages, "doc_id", "left").join(named, "evidence_id", "left")
    unit = F.lower(F.trim("unit"))
    return _count(rows, "fact_id", {
        "unknown_metric": F.col("dimension").isNull(), "percentage_in_money": (F.col("dimension") == "percentage") & unit.rlike("元|rmb|cny"), "money_in_percent": (F.col("dimension") == "currency") & unit.rlike("%|bp"),
        "page_beyond_report": F.col("page") > F.col("pages"), "evidence_of_other_report": F.col("chunk_doc") != F.col("doc_id"), "source_after_loading": F.col("source_date") > F.to_date("loaded_at"),
        "period_after_report": (F.col("kind") == "FY") & (F.col("value_type") == "actual") & (F.col("year") > F.year("published")), "negative_total": F.col("metric").isin("total_assets", "total_liabilities", "inventory") & (F.col("value") < 0),
        "report_not_listed": F.col("doc_id").isNotNull() & F.col("pages").isNull(), "span_without_value": F.col("source_span").isNotNull() & F.col("raw_value").isNotNull() & ~F.contains("source_span", F.trim("raw_value")),
    }, "facts")


def _chunk_rules(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_id is not null")
    parents = c.groupBy(F.col("chunk_id").alias("parent_chunk_id")).agg(F.min("doc_id").alias("parent_doc"), F.min("granularity").alias("parent_kind"))
    pages = table(spark, d, "doc_manifest").where("doc_id is not null").groupBy("doc_id").agg(F.max("page_count").alias("pages"))
    rows = c.join(parents, "parent_chunk_id", "left").join(pages, "doc_id", "left")
    return _count(rows, "chunk_id", {
        "no_text": F.coalesce(F.trim("text"), F.lit("")) == "", "pages_beyond_report": F.col("page_end") > F.col("pages"), "child_without_parent": (F.col("granularity") == "child") & F.col("parent_chunk_id").isNull(), "parent_not_stored": F.col("parent_chunk_id").isNotNull() & F.col("parent_kind").isNull(),
        "parent_of_other_report": F.col("parent_doc") != F.col("doc_id"), "parent_is_child": F.col("parent_kind") == "child", "own_parent": F.col("parent_chunk_id") == F.col("chunk_id"), "gone_before_loading": F.col("deleted_at") <= F.col("loaded_at"),
        "span_not_in_text": F.col("support_span").isNotNull() & F.col("text").isNotNull() & ~F.contains("text", "support_span"),
    }, "chunks")


def integrity_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over claims, facts and chunks, with the number of records that break each."""
    return _claim_rules(spark, d).unionByName(_fact_rules(spark, d)).unionByName(_chunk_rules(spark, d))


def integrity_verdict(spark: SparkSession, d: str) -> DataFrame:
    """READY where no rule of a table is broken, else BLOCKED with the number of broken rules and the first of them."""
    r = integrity_rules(spark, d)
    out = r.groupBy("table_name").agg(F.count("*").alias("n_rules"), F.count_if(F.col("n") > 0).alias("n_broken"), F.min(F.when(F.col("n") > 0, F.col("rule"))).alias("first_broken"))
    return out.withColumn("verdict", F.when(F.col("n_broken") == 0, "READY").otherwise("BLOCKED"))


QUERIES = {f.__name__: f for f in (integrity_rules, integrity_verdict)}

_ST, _ME = (", ".join(f"'{x}'" for x in xs) for xs in (STATUSES, METHODS))
_RULES = {
    "claims": {
        "no_verification": "v is null", "unknown_status": f"v.status not in ({_ST})", "unknown_method": f"v.method not in ({_ME})", "score_out_of_range": "v.score not between 0 and 1", "entailed_without_evidence": "v.status = 'ENTAILED' and n_found = 0", "entailed_over_open_parent": "v.status = 'ENTAILED' and p_open > 0",
        "core_not_entailed": "coalesce(is_core, false) and not coalesce(v.status = 'ENTAILED', false)", "no_source_step": "coalesce(len(steps), 0) = 0", "parent_missing": "p_missing > 0", "own_parent": "p_self > 0", "derived_without_calculation": "claim_type = 'DERIVED' and calculation_id is null",
        "synthesized_from_one_report": "claim_type = 'SYNTHESIZED' and n_docs < 2", "extracted_from_several": "claim_type = 'EXTRACTED' and n_docs > 1", "evidence_not_found": "len(list_filter(coalesce(e, []), lambda x: x is not null)) > 0 and n_found = 0",
    },
    "facts": {
        "unknown_metric": "dimension is null", "percentage_in_money": "dimension = 'percentage' and regexp_matches(u, '元|rmb|cny')", "money_in_percent": "dimension = 'currency' and regexp_matches(u, '%|bp')", "page_beyond_report": "page > pages", "evidence_of_other_report": "chunk_doc <> doc_id",
        "source_after_loading": "source_date > cast(loaded_at as date)", "period_after_report": "period.kind = 'FY' and value_type = 'actual' and period.year > year(published)", "negative_total": "metric in ('total_assets', 'total_liabilities', 'inventory') and value < 0",
        "report_not_listed": "doc_id is not null and pages is null", "span_without_value": "source_span is not null and raw_value is not null and not contains(source_span, trim(raw_value))",
    },
    "chunks": {
        "no_text": "coalesce(trim(text), '') = ''", "pages_beyond_report": "page_end > pages", "child_without_parent": "granularity = 'child' and parent_chunk_id is null", "parent_not_stored": "parent_chunk_id is not null and parent_kind is null", "parent_of_other_report": "parent_doc <> doc_id",
        "parent_is_child": "parent_kind = 'child'", "own_parent": "parent_chunk_id = chunk_id", "gone_before_loading": "deleted_at <= loaded_at", "span_not_in_text": "support_span is not null and text is not null and not contains(text, support_span)",
    },
}
_KEY = {"claims": "claim_id", "facts": "fact_id", "chunks": "chunk_id"}
_INTEGRITY = """with tg as (select ref, min(struct_pack(o := o, chunk_id := chunk_id, doc_id := doc_id)) as r from (select chunk_id as ref, 0 as o, chunk_id, doc_id from chunks union all select evidence_id, 1, chunk_id, doc_id from chunks where evidence_id is not null) group by 1),
    c0 as (select claim_id, arg_min(struct_pack(e := evidence_ids, v := verification, claim_type := claim_type, is_core := is_core, calculation_id := calculation_id, steps := source_step_ids, pa := parent_claim_ids), loaded_at) as r from claims where claim_id is not null group by 1),
    ev as (select claim_id, count(*) as n_found, count(distinct doc_id) as n_docs from (select distinct claim_id, tg.r.chunk_id as chunk_id, tg.r.doc_id as doc_id from (select claim_id, unnest(r.e) as ref from c0) x join tg on tg.ref = x.ref) group by 1),
    pa as (select x.claim_id, count(*) filter (where c0.claim_id is null) as p_missing, count(*) filter (where p = x.claim_id) as p_self, count(*) filter (where c0.claim_id is not null and not coalesce(c0.r.v.status = 'ENTAILED', false)) as p_open from (select distinct claim_id, unnest(r.pa) as p from c0) x left join c0 on c0.claim_id = p where p is not null group by 1),
    claims_ as (select c0.claim_id, r.e, r.v, r.claim_type, r.is_core, r.calculation_id, r.steps, coalesce(n_found, 0) as n_found, coalesce(n_docs, 0) as n_docs, coalesce(p_missing, 0) as p_missing, coalesce(p_self, 0) as p_self, coalesce(p_open, 0) as p_open from c0 left join ev using (claim_id) left join pa using (claim_id)),
    pg as (select doc_id, max(page_count) as pages, min(published_on) as published from doc_manifest where doc_id is not null group by 1), mt as (select metric, min(dimension) as dimension from metric_registry group by 1),
    facts_ as (select facts.*, dimension, pages, published, lower(trim(unit)) as u, tg.r.doc_id as chunk_doc from facts left join mt using (metric) left join pg on pg.doc_id = facts.doc_id left join tg on tg.ref = facts.evidence_id),
    pc as (select chunk_id, min(doc_id) as parent_doc, min(granularity) as parent_kind from chunks where chunk_id is not null group by 1), chunks_ as (select chunks.*, parent_doc, parent_kind, pages from chunks left join pc on pc.chunk_id = chunks.parent_chunk_id left join pg on pg.doc_id = chunks.doc_id where chunks.chunk_id is not null),
    rules as (""" + " union all ".join(f"select '{t}' as table_name, '{r}' as rule, count(distinct {_KEY[t]}) filter (where {x}) as n from {t}_" for t, rules in _RULES.items() for r, x in rules.items()) + ")"

ORACLE_SQL = {
    "integrity_rules": f"{_INTEGRITY} select * from rules",
    "integrity_verdict": f"{_INTEGRITY} select table_name, count(*) as n_rules, count(*) filter (where n > 0) as n_broken, min(rule) filter (where n > 0) as first_broken, case when count(*) filter (where n > 0) = 0 then 'READY' else 'BLOCKED' end as verdict from rules group by 1",
}
