"""Queries on the fact table: typing, filters, structured lookups, calculations and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.form import form
from factloom.operators import facts as ft
from factloom.operators import units
from factloom.session import table


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return ft.flat(table(spark, d, "facts"))


def _coords(spark: SparkSession, d: str) -> DataFrame:
    return ft.one_per_coordinate(_facts(spark, d))


def facts_build(spark: SparkSession, d: str) -> DataFrame:
    rows = ft.problems(table(spark, d, "metric_registry"), _facts(spark, d)).select("fact_id", F.array_join("problems", ",").alias("problems")).distinct()
    return rows.withColumn("valid", (F.col("problems") == "").cast("int"))


def facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The later half of loading folded into the earlier one, year by year of loading."""
    rows = _facts(spark, d).select("fact_id", "doc_id", "value", "loaded_at")
    old, new = rows.where("loaded_at < timestamp'2024-01-01'"), rows.where("loaded_at >= timestamp'2024-01-01'")
    return ft.insert_or_ignore(old, new).groupBy(F.year("loaded_at").alias("loaded_year")).agg(F.count("*").alias("inserted"), F.sum("value").cast("double").alias("total_value"))


def facts_query_filters(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and periods by list and range, with optional scope; ordered by value, a top-k report."""
    rows = _facts(spark, d).where(F.col("metric").isin("revenue", "net_profit") & F.col("kind").isin("FY", "H1") & F.col("year").between(2019, 2024) & (F.col("value_type") == "actual"))
    rows = rows.select("fact_id", "company", "metric", "kind", "year", "value").distinct().withColumn("value", F.col("value").cast("double"))
    w = Window.partitionBy("metric", "kind", "year").orderBy(F.desc("value"), "fact_id")
    return rows.withColumn("rk", F.row_number().over(w)).where("rk <= 10")


def facts_provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _facts(spark, d).select("fact_id", F.array_join(ft.missing_provenance(), ",").alias("missing"))
    return rows.where("missing <> ''").distinct()


def value_type_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").where("text is not null").select("claim_id", tx.value_type(F.col("text")).alias("value_type"))
    return rows.distinct()


def period_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").where("source_span is not null").select("fact_id", tx.period(F.col("source_span")).alias("p")).distinct()
    return rows.select("fact_id", "p.kind", "p.year")


def structured_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every (company, metric, FY year) asked for: found once, found several times with one or more values."""
    rows = _facts(spark, d).where("kind = 'FY' and value_type = 'actual'").groupBy("company", "metric", "year").agg(F.countDistinct("fact_id").alias("n_facts"), F.countDistinct("value").alias("n_values"))
    return rows.withColumn("status", F.when(F.col("n_values") > 1, "AMBIGUOUS").otherwise("FOUND"))


def structured_compare(spark: SparkSession, d: str) -> DataFrame:
    """Companies ranked within each metric and fiscal year by their actual value, as recorded in exactly 元; `structured_compare_units` ranks all."""
    rows = _coords(spark, d).where("kind = 'FY' and value_type = 'actual' and unit = '元'").withColumn("value", F.col("value").cast("double"))
    w = Window.partitionBy("metric", "year").orderBy(F.desc("value"), "company")
    return rows.withColumn("rk", F.row_number().over(w)).where("rk <= 5").select("metric", "year", "company", "value", "rk")


def _ranked_quantities(facts: DataFrame, metrics: DataFrame, companies: DataFrame) -> DataFrame:
    """Actual FY values of every metric in its common unit, ranked within metric and year.

    A company is its spelling in `companies`, found by name or alias in the project's form; unlisted ones stay in their own
    form.  Its value is that of its earliest record with a readable quantity; one without any has no rank.
    """
    rows = units.convert(facts.where("kind = 'FY' and value_type = 'actual' and company is not null"), metrics).where("quantity is not null")
    names = companies.select(F.col("name").alias("_listed"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("_name")).where("_name is not null")
    names = names.groupBy("_name").agg(F.min("_listed").alias("_listed"))
    rows = rows.withColumn("_name", F.trim(form(F.col("company")))).join(names, "_name", "left").withColumn("company", F.coalesce("_listed", "_name"))
    rows = ft.one_per_coordinate(rows.withColumn("value", F.col("quantity")))
    w = Window.partitionBy("metric", "year").orderBy(F.desc("value"), "company")
    known = metrics.groupBy("metric").agg(F.min("common_unit").alias("common_unit"))
    rows = rows.withColumn("rk", F.row_number().over(w)).join(known, "metric")
    return rows.select("metric", "year", "company", F.col("value").cast("double").alias("value"), F.col("common_unit").alias("unit"), "rk")


def structured_compare_units(spark: SparkSession, d: str) -> DataFrame:
    """The five leading companies of every metric and fiscal year, whatever unit their values are recorded in."""
    return _ranked_quantities(_facts(spark, d), table(spark, d, "metric_registry"), table(spark, d, "companies")).where("rk <= 5")


def structured_trend(spark: SparkSession, d: str) -> DataFrame:
    """Direction of each company's metric over its fiscal years (three values at least)."""
    rows = _coords(spark, d).where("kind = 'FY' and value_type = 'actual'")
    out = rows.groupBy("company", "metric").agg(F.count("*").alias("n_years"), F.min_by("value", "year").cast("double").alias("first_value"), F.max_by("value", "year").cast("double").alias("last_value"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.where("n_years >= 3").withColumn("direction", F.when(F.col("last_value") > F.col("first_value"), "up").when(F.col("last_value") < F.col("first_value"), "down").otherwise("flat"))


def operand_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Operands that a yearly and a quarterly comparison of every actual value need."""
    rows = _coords(spark, d).where("value_type = 'actual'").select("company", "metric", "kind", "year")
    before = F.when(F.col("kind") == "Q2", "Q1").when(F.col("kind") == "Q3", "Q2")
    need = F.array(F.struct(F.lit("yoy").alias("calc"), F.lit("current").alias("name"), "kind", "year"), F.struct(F.lit("yoy").alias("calc"), F.lit("prior").alias("name"), "kind", (F.col("year") - 1).alias("year")), F.struct(F.lit("qoq").alias("calc"), F.lit("prior").alias("name"), before.alias("kind"), "year"))
    return rows.select("company", "metric", F.col("kind").alias("of_kind"), F.col("year").alias("of_year"), F.explode(need).alias("n")).select("company", "metric", "of_kind", "of_year", "n.calc", "n.name", "n.kind", "n.year").where("kind is not null")


def operand_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each required operand resolved against the facts: RESOLVED, AMBIGUOUS (several values) or MISSING."""
    need = operand_requirements(spark, d)
    have = _facts(spark, d).where("value_type = 'actual'").groupBy("company", "metric", "kind", "year").agg(F.countDistinct("value").alias("n_values"))
    out = need.join(have, ["company", "metric", "kind", "year"], "left").withColumn("resolution", F.when(F.col("n_values").isNull(), "MISSING").when(F.col("n_values") > 1, "AMBIGUOUS").otherwise("RESOLVED"))
    return out.groupBy("metric", "calc", "name", "resolution").agg(F.count("*").alias("n"))


def calc_yoy(spark: SparkSession, d: str) -> DataFrame:
    rows = ft.with_prior(_coords(spark, d))
    status = ft.growth_status(F.col("prior_value"), F.col("prior_unit"), F.col("unit"))
    return rows.select(*ft.COORDS, "value_type", "year", F.when(status == "SUCCESS", ft.growth(F.col("prior_value"), F.col("value"))).alias("growth"), status.alias("status"))


def calc_qoq(spark: SparkSession, d: str) -> DataFrame:
    rows = _coords(spark, d).where("kind in ('Q1', 'Q2', 'Q3')").withColumn("q", F.substring("kind", 2, 1).cast("int"))
    key = ["company", "metric", "value_type", "year", "q"]
    prior = rows.select("company", "metric", "value_type", "year", (F.col("q") + 1).alias("q"), F.col("value").alias("prior_value"), F.col("unit").alias("prior_unit"))
    rows = rows.join(prior, key)
    status = ft.growth_status(F.col("prior_value"), F.col("prior_unit"), F.col("unit"))
    return rows.select("company", "metric", "kind", "value_type", "year", F.when(status == "SUCCESS", ft.growth(F.col("prior_value"), F.col("value"))).alias("growth"), status.alias("status"))


def calc_cagr(spark: SparkSession, d: str) -> DataFrame:
    """Compound growth between the first and the last fiscal year of each series."""
    rows = _coords(spark, d).where("kind = 'FY' and value_type = 'actual'").groupBy("company", "metric").agg(F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    years = F.col("y1") - F.col("y0")
    status = F.when(years <= 0, "INVALID_PERIOD").when((F.col("a") <= 0) | (F.col("b") <= 0), "INVALID_INPUT").otherwise("SUCCESS")
    return rows.select("company", "metric", years.alias("years"), ft.cagr(F.col("a"), F.col("b"), years).alias("cagr"), status.alias("status"))


def _margin(spark: SparkSession, d: str, profit: str, name: str) -> DataFrame:
    rows = ft.with_metric(_coords(spark, d), profit, "revenue")
    status = F.when(ft.percent(F.col("left_unit")) != ft.percent(F.col("right_unit")), "UNIT_MISMATCH").when(F.col("right_value") <= 0, "INVALID_INPUT").otherwise("SUCCESS")
    return rows.select(F.lit(name).alias("calc"), "company", "kind", "year", "value_type", F.when(status == "SUCCESS", ft.fraction(F.col("left_value"), F.col("right_value"))).alias("value"), status.alias("status"))


def calc_margins(spark: SparkSession, d: str) -> DataFrame:
    return _margin(spark, d, "gross_profit", "gross_margin").unionByName(_margin(spark, d, "net_profit", "net_margin"))


def calc_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Liabilities to assets at the same period."""
    rows = ft.with_metric(_coords(spark, d), "total_liabilities", "total_assets")
    return rows.select("company", "kind", "year", "value_type", ft.fraction(F.col("left_value"), F.col("right_value")).alias("ratio"))


def calc_difference(spark: SparkSession, d: str) -> DataFrame:
    """Assets less liabilities, shown with its unit; a percentage against an amount is a mismatch."""
    rows = ft.with_metric(_coords(spark, d), "total_assets", "total_liabilities")
    ok = ft.percent(F.col("left_unit")) == ft.percent(F.col("right_unit"))
    unit = F.when(F.trim("left_unit").eqNullSafe(F.trim("right_unit")), F.trim("left_unit"))
    return rows.select("company", "kind", "year", "value_type", F.when(ok, (F.col("left_value") - F.col("right_value")).cast("double")).alias("difference"), unit.alias("unit"))


def calc_percentage_points(spark: SparkSession, d: str) -> DataFrame:
    rows = ft.with_prior(_coords(spark, d)).where("prior_value is not null and trim(unit) = '%' and trim(prior_unit) = '%'")
    return rows.select(*ft.COORDS, "value_type", "year", F.round((F.col("value") - F.col("prior_value")).cast("double"), 4).alias("pp"))


def calc_status_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How often each status of the yearly growth calculation occurs per metric."""
    return calc_yoy(spark, d).groupBy("metric", "status").agg(F.count("*").alias("n"), F.count("growth").alias("n_values"))


def growth_compare(spark: SparkSession, d: str) -> DataFrame:
    """Which of revenue and net profit grew faster, by company and fiscal year."""
    g = calc_yoy(spark, d).where("kind = 'FY' and value_type = 'actual' and growth is not null")
    key = ["company", "year"]
    a = g.where("metric = 'revenue'").select(*key, F.col("growth").alias("revenue_growth"))
    b = g.where("metric = 'net_profit'").select(*key, F.col("growth").alias("profit_growth"))
    r, p = F.col("revenue_growth"), F.col("profit_growth")
    return a.join(b, key).withColumn("winner", F.when(r > p, "revenue").when(p > r, "net_profit").otherwise("tie"))


def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    """One display line per coordinate."""
    rows = _coords(spark, d).where("unit is not null")
    return rows.select("fact_id", F.concat_ws(" ", "company", "metric", F.concat("kind", F.col("year").cast("string")), ft.display(F.col("value"), F.col("unit"))).alias("line"))


def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Company named in each fact's source span: the longest name or alias that occurs (ties by name)."""
    names = table(spark, d, "companies").select("name", F.explode(F.concat(F.array("name"), "aliases")).alias("alias")).where("alias is not null")
    spans = table(spark, d, "facts").select("fact_id", "source_span").distinct()
    return ft.longest_name(spans, "fact_id", "source_span", [(r["name"], r["alias"]) for r in names.collect()])  # a fixed table


def metric_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Metrics named in each claim, without aliases that lie inside a longer matching alias of another metric."""
    reg = table(spark, d, "metric_registry").select("metric", F.explode("aliases").alias("alias")).withColumn("alias", tx.match_form(F.col("alias"))).where("alias <> ''").distinct()
    rows = [(r["metric"], r["alias"]) for r in reg.collect()]  # a fixed table
    claims = table(spark, d, "claims").where("text is not null").select("claim_id", tx.match_form(F.col("text")).alias("t")).distinct()
    hits = []
    for metric, alias in rows:
        longer = [a for m, a in rows if m != metric and len(a) > len(alias) and alias in a]
        c = F.contains("t", F.lit(alias))
        for a in longer:
            c = c & ~F.contains("t", F.lit(a))
        hits.append(F.when(c, F.lit(metric)))
    return claims.select("claim_id", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("metric"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_build, facts_upsert, facts_query_filters, facts_provenance_gaps, value_type_spans, period_normalize, structured_lookup, structured_compare, structured_compare_units, structured_trend, operand_requirements,
        operand_resolution, calc_yoy, calc_qoq, calc_cagr, calc_margins, calc_ratio, calc_difference, calc_percentage_points, calc_status_cascade, growth_compare, fact_lines, entity_resolve, metric_mentions,
    )
}

_F = "f as (select *, period.kind as kind, period.year as year from facts)"
_C = f"{_F}, c as (select company, metric, kind, year, value_type, arg_min(value, (loaded_at, fact_id)) as value, arg_min(coalesce(unit, '\\0'), (loaded_at, fact_id)) as u0, arg_min(fact_id, (loaded_at, fact_id)) as fact_id, count(*) as n_facts from f where company is not null and metric is not null and kind is not null and year is not null and value_type is not null group by 1, 2, 3, 4, 5), k as (select *, nullif(u0, '\\0') as unit from c)"
_P = "coalesce(trim({}) = '%', false)"
_YOY = f"""{_C}, y as (select a.*, b.value as pv, b.unit as pu from k a left join k b on a.company = b.company and a.metric = b.metric and a.kind = b.kind and a.value_type = b.value_type and a.year = b.year + 1),
    g as (select company, metric, kind, value_type, year, case when pv is null then 'MISSING_OPERAND' when {_P.format('pu')} <> {_P.format('unit')} then 'UNIT_MISMATCH' when pv = 0 then 'DIVIDE_BY_ZERO' else 'SUCCESS' end as status, value, pv from y),
    yoy as (select company, metric, kind, value_type, year, case when status = 'SUCCESS' then round((cast(value as double) - cast(pv as double)) / cast(pv as double), 6) end as growth, status from g)"""
_ALIAS = "select metric, a as alias from (select metric, lower(regexp_replace(unnest(aliases), '[^0-9A-Za-z\\x{4E00}-\\x{9FFF}]+', '', 'g')) as a from metric_registry)"
_MATCH = "lower(regexp_replace(text, '[^0-9A-Za-z\\x{4E00}-\\x{9FFF}]+', '', 'g'))"
_NEED = f"""{_C}, b as (select company, metric, kind as of_kind, year as of_year from k where value_type = 'actual'),
    need as (select *, 'yoy' as calc, 'current' as name, of_kind as kind, of_year as year from b union all select *, 'yoy', 'prior', of_kind, of_year - 1 from b
    union all select *, 'qoq', 'prior', case of_kind when 'Q2' then 'Q1' when 'Q3' then 'Q2' end, of_year from b where of_kind in ('Q2', 'Q3'))"""


def _blank(n: str) -> str:
    return f"({n} is null or trim(cast({n} as varchar)) = '')"


def _pair(left: str, right: str) -> str:
    return f"p as (select a.company, a.kind, a.year, a.value_type, a.value as lv, a.unit as lu, b.value as rv, b.unit as ru from k a join k b on a.company = b.company and a.kind = b.kind and a.year = b.year and a.value_type = b.value_type where a.metric = '{left}' and b.metric = '{right}')"


def _sql_margin(profit: str, name: str) -> str:
    s = f"case when {_P.format('lu')} <> {_P.format('ru')} then 'UNIT_MISMATCH' when rv <= 0 then 'INVALID_INPUT' else 'SUCCESS' end"
    return f"select '{name}' as calc, company, kind, year, value_type, case when {s} = 'SUCCESS' then round(cast(lv as double) / cast(rv as double), 6) end as value, {s} as status from (with {_pair(profit, 'revenue')} select * from p)"


_MISSING = "array_to_string(list_filter([" + ", ".join(f"case when {_blank(n)} then '{n}' end" for n in ft.PROVENANCE) + "], lambda x: x is not null), ',')"
_PERIOD = "(select fact_id, c, list_distinct(list_concat(regexp_extract_all(c, '20[0-9]{2}'), list_concat(list_transform(regexp_extract_all(c, '(?:^|[^0-9])([0-9]{2})[qh][0-9]', 1), lambda y: '20' || y), list_transform(regexp_extract_all(c, '(?:^|[^0-9])([0-9]{2})年', 1), lambda y: '20' || y)))) as ys from (select distinct fact_id, lower(regexp_replace(source_span, '[\\s\\x{A0}\\x{3000}]+', '', 'g')) as c from facts where source_span is not null))"
_KIND = "case " + " ".join(f"when regexp_matches(c, '{p}') then '{k}'" for k, p in tx.PERIOD_KINDS) + " else 'FY' end"
_KNOWN = f"(not regexp_matches(c, '{tx.PERIOD_OUT}') and len(ys) = 1)"

ORACLE_SQL = {
    "facts_build": f"""with {_F}, p as (select distinct fact_id, array_to_string(list_filter([case when m.dimension is null then 'unknown_metric' end,
        case when m.dimension is not null and not coalesce((m.dimension = 'currency' and unit = '元') or (m.dimension = 'percentage' and unit = '%') or (m.dimension = 'per_share' and unit = '元/股'), false) then 'bad_unit' end,
        case when not coalesce(value_type in ('actual', 'forecast', 'adjusted', 'unknown'), false) then 'bad_value_type' end, case when not coalesce(kind in ('FY', 'Q1', 'Q2', 'H1', 'Q3') and year between 1990 and 2100, false) then 'bad_period' end,
        case when value is null then 'no_value' end, case when not coalesce(page >= 0, false) then 'bad_page' end, case when coalesce(trim(company), '') = '' then 'no_company' end, case when {_MISSING} <> '' then 'no_provenance' end], lambda x: x is not null), ',') as problems
        from f left join metric_registry m using (metric)) select fact_id, problems, cast(problems = '' as int) as valid from p""",
    "facts_upsert": """with n as (select fact_id, arg_min(value, (loaded_at, doc_id)) as value, min(loaded_at) as loaded_at from facts where loaded_at >= timestamp '2024-01-01' and fact_id not in (select fact_id from facts where loaded_at < timestamp '2024-01-01') group by 1)
        select year(loaded_at) as loaded_year, count(*) as inserted, cast(sum(value) as double) as total_value from n group by 1""",
    "facts_query_filters": f"""with {_F}, s as (select distinct fact_id, company, metric, kind, year, cast(value as double) as value from f where metric in ('revenue', 'net_profit') and kind in ('FY', 'H1') and year between 2019 and 2024 and value_type = 'actual'),
        r as (select *, row_number() over (partition by metric, kind, year order by value desc nulls last, fact_id) as rk from s) select * from r where rk <= 10""",
    "facts_provenance_gaps": f"select distinct fact_id, missing from (select fact_id, {_MISSING} as missing from facts) where missing <> ''",
    "value_type_spans": f"select distinct claim_id, case when regexp_matches(lower(text), '{tx.ADJUSTED}') then 'adjusted' when regexp_matches(text, '{tx.ESTIMATE_YEAR}') then 'forecast' when regexp_matches(text, '{tx.FORECAST}') then 'forecast' when regexp_matches(text, '{tx.ACTUAL}') then 'actual' else 'unknown' end as value_type from claims where text is not null",
    "period_normalize": f"select distinct fact_id, case when {_KNOWN} then {_KIND} end as kind, case when {_KNOWN} then cast(ys[1] as int) end as year from {_PERIOD}",
    "structured_lookup": f"with {_F} select company, metric, year, count(distinct fact_id) as n_facts, count(distinct value) as n_values, case when count(distinct value) > 1 then 'AMBIGUOUS' else 'FOUND' end as status from f where kind = 'FY' and value_type = 'actual' group by 1, 2, 3",
    "structured_compare": f"with {_C}, r as (select metric, year, company, cast(value as double) as value, row_number() over (partition by metric, year order by cast(value as double) desc nulls last, company) as rk from k where kind = 'FY' and value_type = 'actual' and unit = '元') select * from r where rk <= 5",
    "structured_trend": f"""with {_C}, t as (select company, metric, count(*) as n_years, cast(arg_min(value, year) as double) as first_value, cast(arg_max(value, year) as double) as last_value, min(year) as first_year, max(year) as last_year from k where kind = 'FY' and value_type = 'actual' group by 1, 2)
        select *, case when last_value > first_value then 'up' when last_value < first_value then 'down' else 'flat' end as direction from t where n_years >= 3""",
    "operand_requirements": f"with {_NEED} select * from need",
    "operand_resolution": f"""with {_NEED}, h as (select company, metric, kind, year, count(distinct value) as nv from f where value_type = 'actual' group by 1, 2, 3, 4)
        select metric, calc, name, case when nv is null then 'MISSING' when nv > 1 then 'AMBIGUOUS' else 'RESOLVED' end as resolution, count(*) as n from need left join h using (company, metric, kind, year) group by 1, 2, 3, 4""",
    "calc_yoy": f"with {_YOY} select * from yoy",
    "calc_qoq": f"""with {_C}, q as (select *, cast(substring(kind, 2, 1) as int) as q from k where kind in ('Q1', 'Q2', 'Q3')),
        y as (select a.*, b.value as pv, b.unit as pu from q a join q b on a.company = b.company and a.metric = b.metric and a.value_type = b.value_type and a.year = b.year and a.q = b.q + 1),
        s as (select *, case when {_P.format('pu')} <> {_P.format('unit')} then 'UNIT_MISMATCH' when pv = 0 then 'DIVIDE_BY_ZERO' else 'SUCCESS' end as status from y)
        select company, metric, kind, value_type, year, case when status = 'SUCCESS' then round((cast(value as double) - cast(pv as double)) / cast(pv as double), 6) end as growth, status from s""",
    "calc_cagr": f"""with {_C}, t as (select company, metric, cast(arg_min(value, year) as double) as a, cast(arg_max(value, year) as double) as b, max(year) - min(year) as years from k where kind = 'FY' and value_type = 'actual' group by 1, 2)
        select company, metric, years, case when years > 0 and a > 0 and b > 0 then round(pow(b / a, 1.0 / years) - 1, 6) end as cagr, case when years <= 0 then 'INVALID_PERIOD' when a <= 0 or b <= 0 then 'INVALID_INPUT' else 'SUCCESS' end as status from t""",
    "calc_margins": f"with {_C} {_sql_margin('gross_profit', 'gross_margin')} union all {_sql_margin('net_profit', 'net_margin')}",
    "calc_ratio": f"with {_C}, {_pair('total_liabilities', 'total_assets')} select company, kind, year, value_type, case when rv <> 0 then round(cast(lv as double) / cast(rv as double), 6) end as ratio from p",
    "calc_difference": f"with {_C}, {_pair('total_assets', 'total_liabilities')} select company, kind, year, value_type, case when {_P.format('lu')} = {_P.format('ru')} then cast(lv - rv as double) end as difference, case when trim(lu) is not distinct from trim(ru) then trim(lu) end as unit from p",
    "calc_percentage_points": f"with {_YOY} select company, metric, kind, value_type, year, round(cast(value - pv as double), 4) as pp from y where pv is not null and trim(unit) = '%' and trim(pu) = '%'",
    "calc_status_cascade": f"with {_YOY} select metric, status, count(*) as n, count(growth) as n_values from yoy group by 1, 2",
    "growth_compare": f"""with {_YOY}, g2 as (select * from yoy where kind = 'FY' and value_type = 'actual' and growth is not null)
        select a.company, a.year, a.growth as revenue_growth, b.growth as profit_growth, case when a.growth > b.growth then 'revenue' when b.growth > a.growth then 'net_profit' else 'tie' end as winner from g2 a join g2 b on a.company = b.company and a.year = b.year where a.metric = 'revenue' and b.metric = 'net_profit'""",
    "fact_lines": f"""with {_C}, v as (select *, cast(value as decimal(26, 6)) as v, trim(unit) as tu from k where unit is not null)
        select fact_id, company || ' ' || metric || ' ' || kind || cast(year as varchar) || ' ' || case when tu = '元' and abs(v) >= 100000000 then cast(cast(round(v * cast('0.00000001' as decimal(9, 8)), 2) as decimal(30, 2)) as varchar) || '亿元'
        when tu = '元' and abs(v) >= 10000 then cast(cast(round(v * cast('0.0001' as decimal(9, 8)), 2) as decimal(30, 2)) as varchar) || '万元' when tu = '元' then cast(cast(round(v, 2) as decimal(30, 2)) as varchar) || '元'
        else cast(cast(round(v, 2) as decimal(30, 2)) as varchar) || tu end as line from v""",
    "entity_resolve": """with n as (select name, unnest(list_concat([name], aliases)) as alias from companies), s as (select distinct fact_id, source_span from facts where source_span is not null),
        h as (select fact_id, name, length(alias) as l, row_number() over (partition by fact_id order by length(alias) desc, name) as rk from s join n on contains(source_span, alias) where length(alias) > 0)
        select fact_id, name as company, l as alias_length from h where rk = 1""",
    "metric_mentions": f"""with r as (select distinct * from ({_ALIAS}) where alias <> ''), c as (select distinct claim_id, {_MATCH} as t from claims where text is not null), h as (select claim_id, metric, alias from c join r on contains(t, alias))
        select distinct claim_id, metric from h a where not exists (select 1 from h b where b.claim_id = a.claim_id and b.metric <> a.metric and length(b.alias) > length(a.alias) and contains(b.alias, a.alias))""",
}
