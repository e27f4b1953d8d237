"""Queries on numeric statements: extraction from spans, stable keys, verdicts by coordinates, parsed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import coordinates as co
from factloom.operators import facts as ft
from factloom.queries.structured import _KIND, _KNOWN, _PERIOD
from factloom.session import table


def _aliases(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """(metric, alias in lower case) of the registry, a fixed table."""
    return [(r["metric"], a.lower()) for r in table(spark, d, "metric_registry").collect() if r["metric"] for a in [*(r["aliases"] or []), r["canonical_name"] or ""] if a]


def _known(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "companies")
    return c.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("company")).where("company is not null").distinct().withColumn("company_known", F.lit(True))


def facts_extract(spark: SparkSession, d: str) -> DataFrame:
    """Every fact as a candidate: what its span states, and the first check that rejects it."""
    rows = table(spark, d, "facts").select("fact_id", "company", "source_span", "raw_value", "period_basis").distinct().withColumn("company", F.trim("company"))
    out = co.extract(rows.join(_known(spark, d), "company", "left"), _aliases(spark, d))
    return out.select("fact_id", F.col("x_metric").alias("metric"), "x_period.kind", "x_period.year", F.col("x_type").alias("value_type"), F.col("x_raw").alias("raw"), "reject").distinct()


def facts_extract_summary(spark: SparkSession, d: str) -> DataFrame:
    """Candidates kept and rejected, by metric and reason."""
    return facts_extract(spark, d).groupBy("metric", F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def fact_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stable key of every record from its coordinates, and how many records share one."""
    f = ft.flat(table(spark, d, "facts"))
    label = F.concat(F.col("year").cast("string"), F.when(F.col("kind") == "FY", "").otherwise(F.col("kind")))
    first = [F.col("company"), F.col("metric"), label, F.col("value_type"), F.col("value"), F.col("unit"), F.col("doc_id"), F.col("page"), F.col("evidence_id")]
    key = co.fact_key(first, [F.col(c) for c in ("accounting_scope", "period_basis", "source_date", "revision_status")])
    return f.select("fact_id", key.alias("fact_key")).distinct().groupBy("fact_key").agg(F.count("*").alias("n_records"), F.min("fact_id").alias("first_id"))


def _statements(spark: SparkSession, d: str) -> DataFrame:
    f = ft.flat(table(spark, d, "facts"))
    dimension, quantity = co.scaled(F.col("value"), F.col("unit"))
    said = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return f.select("fact_id", "company", "metric", "kind", "year", "value_type", dimension.alias("dimension"), quantity.alias("quantity"), said("accounting_scope").alias("scope"), said("revision_status").alias("revision")).distinct()


def numeric_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded fact as a statement, judged by all other records of its coordinates."""
    rows = _statements(spark, d)
    return co.verdicts(rows, rows, "fact_id", own=True)


def numeric_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return numeric_verdicts(spark, d).groupBy("status", "reason").agg(F.count("*").alias("n"))


def question_parse(spark: SparkSession, d: str) -> DataFrame:
    """Spans read as questions: entities, metric, period, operation and whether they can be answered from the records."""
    rows = table(spark, d, "facts").where("source_span is not null").select("fact_id", "company", "source_span", "period_basis").distinct()
    span = F.col("source_span")
    op = F.when(span.rlike("同比|环比"), "calculate").when(span.rlike(tx.COMPARISON), "compare").when(span.rlike("趋势|近三年|至今"), "trend").otherwise("lookup")
    out = rows.select("fact_id", "company", co.longest_alias(F.lower(span), _aliases(spark, d)).alias("metric"), tx.period(span).alias("p"), op.alias("operation"), "period_basis")
    status = F.when(F.col("metric").isNull() | F.col("p").isNull(), "miss").when((F.col("p.kind") == "Q2") & F.col("period_basis").isNull(), "fail_closed").when(F.col("operation").isin("compare", "trend"), "fail_closed").otherwise("ok")
    return out.select("fact_id", "metric", "p.kind", "p.year", "operation", status.alias("status")).distinct()


def question_route(spark: SparkSession, d: str) -> DataFrame:
    """Parsed lookups beside the records of their coordinates: answered from records, or left to retrieval."""
    asked = question_parse(spark, d).where("status = 'ok'").join(table(spark, d, "facts").select("fact_id", "company").distinct(), "fact_id")
    have = ft.flat(table(spark, d, "facts")).where("value is not null").groupBy("company", "metric", "kind", "year").agg(F.countDistinct("value").alias("n_values"))
    out = asked.join(have, ["company", "metric", "kind", "year"], "left").withColumn("route", F.when(F.col("n_values") == 1, "structured").when(F.col("n_values") > 1, "ambiguous").otherwise("retrieval"))
    return out.groupBy("metric", "operation", "route").agg(F.countDistinct("fact_id").alias("n"))


def metrics_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each company that can be set side by side: their number, dimensions and shared units, per fiscal year."""
    f = ft.flat(table(spark, d, "facts")).where("kind = 'FY' and unit is not null").select("company", "year", "metric", F.trim("unit").alias("unit"))
    rows = f.join(table(spark, d, "metric_registry").select("metric", "dimension"), "metric")
    out = rows.groupBy("company", "year", "dimension").agg(F.countDistinct("metric").alias("n_metrics"), F.countDistinct("unit").alias("n_units"))
    return out.withColumn("compatible", ((F.col("n_metrics") > 1) & (F.col("n_units") == 1)).cast("int"))


QUERIES = {f.__name__: f for f in (facts_extract, facts_extract_summary, fact_keys, numeric_verdicts, numeric_verdict_counts, question_parse, question_route, metrics_compatible)}

_W = tx.WS
_AL = "(select metric, lower(unnest(list_concat(coalesce(aliases, []), [coalesce(canonical_name, '')]))) as alias from metric_registry)"
_BEST = f"(select fact_id, arg_min(metric, (-length(alias), metric)) as metric from (select distinct fact_id, lower(source_span) as s from facts where source_span is not null) x join (select distinct * from {_AL} where alias <> '') a on contains(s, alias) group by fact_id)"
_TYPE = f"case when regexp_matches(lower(s), '{tx.ADJUSTED}') then 'adjusted' when regexp_matches(s, '{tx.ESTIMATE_YEAR}') then 'forecast' when regexp_matches(s, '{tx.FORECAST}') then 'forecast' when regexp_matches(s, '{tx.ACTUAL}') then 'actual' else 'unknown' end"
_P = f"(select distinct fact_id, case when {_KNOWN} then {_KIND} end as kind, case when {_KNOWN} then cast(ys[1] as int) end as year from {_PERIOD})"
_EXTRACT = f"""with f as (select distinct fact_id, trim(company) as company, coalesce(source_span, '') as s, coalesce(raw_value, '') as r, coalesce(period_basis, '') as b from facts),
    k as (select distinct unnest(list_concat([name], coalesce(aliases, []))) as company from companies), x as (select f.*, m.metric, p.kind, p.year, {_TYPE} as value_type, regexp_replace(regexp_replace(r, '{_W}+', '', 'g'), '^(大约|约|近|逾|超)([0-9])', '\\2') as raw, k.company is not null as known
      from f left join {_BEST} m using (fact_id) left join {_P} p using (fact_id) left join k on k.company = f.company),
    e as (select distinct fact_id, metric, kind, year, value_type, raw, case when metric is null then 'metric' when kind is null then 'period' when kind = 'Q2' and b = '' then 'basis' when not regexp_matches(raw, '[0-9一二三四五六七八九十]') then 'value'
      when not contains(regexp_replace(s, '{_W}+', '', 'g'), regexp_replace(r, '{_W}+', '', 'g')) then 'span' when not known then 'company' end as reject from x)"""
_SCALE = "case lower(trim(unit)) " + " ".join(f"when '{u}' then {{{k}}}" for u, k in ((u, i) for i, u in enumerate(co.SCALES))) + " end"
_DIM = _SCALE.format(*[f"'{k}'" for k, _ in co.SCALES.values()])
_QTY = _SCALE.format(*[f"cast(value as decimal(28,6)) * {f}" for _, f in co.SCALES.values()])
_VERDICTS = f"""with f as (select distinct fact_id, company, metric, period.kind as kind, period.year as year, value_type, {_DIM} as dim, cast({_QTY} as decimal(38,6)) as q, nullif(lower(trim(accounting_scope)), '') as s, nullif(lower(trim(revision_status)), '') as r from facts),
    ok as (select * from f where company is not null and metric is not null and kind is not null and year is not null and value_type is not null and q is not null),
    p as (select a.fact_id, a.s is not null and a.r is not null as full_, b.q = a.q as same from ok a join ok b on a.fact_id || '' <> b.fact_id and a.company = b.company and a.metric = b.metric and a.kind = b.kind and a.year = b.year and a.value_type = b.value_type and a.dim = b.dim and (a.s is null or a.s = b.s) and (a.r is null or a.r = b.r)),
    n as (select fact_id, count(*) filter (where same) as n_support, count(*) filter (where not same and full_) as n_conflict, count(*) filter (where not same and not full_) as n_unresolved from p group by 1),
    v as (select f.fact_id, coalesce(n_support, 0) as n_support, coalesce(n_conflict, 0) as n_conflict, coalesce(n_unresolved, 0) as n_unresolved,
      concat_ws(',', case when company is null then 'company' end, case when metric is null then 'metric' end, case when kind is null then 'kind' end, case when year is null then 'year' end, case when value_type is null then 'value_type' end, case when q is null then 'quantity' end) as lacks from f left join n using (fact_id)),
    w as (select fact_id, n_support, n_conflict, n_unresolved, case when n_conflict > 0 then 'CONTRADICTED' when n_unresolved = 0 and n_support > 0 then 'ENTAILED' else 'INSUFFICIENT' end as status,
      case when lacks <> '' then 'missing:' || lacks when n_conflict > 0 and n_support > 0 then 'support_and_conflict' when n_conflict > 0 then 'numeric_value_conflict' when n_unresolved > 0 then 'numeric_conflict_dimensions_incomplete' when n_support > 0 then 'all_numeric_constraints_match' else 'no_evidence_matches_all_numeric_constraints' end as reason from v)"""
_PARSE = f"""with q0 as (select distinct fact_id, source_span as s, period_basis as b from facts where source_span is not null), q1 as (select q0.*, m.metric, p.kind, p.year, case when regexp_matches(s, '同比|环比') then 'calculate' when regexp_matches(s, '{tx.COMPARISON}') then 'compare' when regexp_matches(s, '趋势|近三年|至今') then 'trend' else 'lookup' end as operation from q0 left join {_BEST} m using (fact_id) left join {_P} p using (fact_id)),
    q as (select distinct fact_id, metric, kind, year, operation, case when metric is null or kind is null then 'miss' when kind = 'Q2' and b is null then 'fail_closed' when operation in ('compare', 'trend') then 'fail_closed' else 'ok' end as status from q1)"""

ORACLE_SQL = {
    "facts_extract": f"{_EXTRACT} select * from e",
    "facts_extract_summary": f"{_EXTRACT} select metric, coalesce(reject, 'kept') as outcome, count(*) as n from e group by 1, 2",
    "fact_keys": """with k as (select distinct fact_id, concat_ws('|', coalesce(company, ''), coalesce(metric, ''), coalesce(cast(period.year as varchar) || case when period.kind = 'FY' then '' else period.kind end, ''), coalesce(value_type, ''), coalesce(cast(value as varchar), ''), coalesce(unit, ''), coalesce(doc_id, ''), coalesce(cast(page as varchar), ''), coalesce(evidence_id, '')) as a,
        concat_ws('|', coalesce(accounting_scope, ''), coalesce(period_basis, ''), coalesce(cast(source_date as varchar), ''), coalesce(revision_status, '')) as b, coalesce(accounting_scope, period_basis, cast(source_date as varchar), revision_status) is not null as later from facts)
        select 'F' || substring(sha1(case when later then a || '|' || b else a end), 1, 12) as fact_key, count(*) as n_records, min(fact_id) as first_id from k group by 1""",
    "numeric_verdicts": f"{_VERDICTS} select * from w",
    "numeric_verdict_counts": f"{_VERDICTS} select status, reason, count(*) as n from w group by 1, 2",
    "question_parse": f"{_PARSE} select * from q",
    "question_route": f"""{_PARSE}, a as (select q.*, f.company from q join (select distinct fact_id, company from facts) f using (fact_id) where status = 'ok'), h as (select company, metric, period.kind as kind, period.year as year, count(distinct value) as n_values from facts where value is not null group by all)
        select metric, operation, case when n_values = 1 then 'structured' when n_values > 1 then 'ambiguous' else 'retrieval' end as route, count(distinct fact_id) as n from a left join h using (company, metric, kind, year) group by 1, 2, 3""",
    "metrics_compatible": """select company, period.year as year, dimension, count(distinct metric) as n_metrics, count(distinct trim(unit)) as n_units, cast(count(distinct metric) > 1 and count(distinct trim(unit)) = 1 as int) as compatible from facts join metric_registry using (metric) where period.kind = 'FY' and unit is not null group by 1, 2, 3""",
}
