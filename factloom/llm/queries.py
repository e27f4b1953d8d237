"""Queries of the problems on texts and records for training corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import lookalikes, mixing, packing, site_lines, subjects, survivors, tokens
from factloom.functions.form import ARMENIAN, BLANKS_WITHOUT_FORM, CYRILLIC, GREEK, HYPHENS, SYMBOLS, WIDE_SIGNS, sql_form
from factloom.session import materialize, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of chunks and facts whose value is not in the project's form."""
    chunks, facts = table(spark, d, "chunks"), table(spark, d, "facts")
    out = lookalikes.find(chunks, "chunks", "chunk_id", "text")
    return out.unionByName(lookalikes.find(facts, "facts", "fact_id", "raw_value")).unionByName(lookalikes.find(facts, "facts", "fact_id", "company"))


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each field hold each kind of disguise."""
    out = None
    for t, k, f in (("chunks", "chunk_id", "text"), ("facts", "fact_id", "raw_value"), ("facts", "fact_id", "company")):
        one = lookalikes.kinds(table(spark, d, t), k, f).groupBy("kind").agg(F.countDistinct("src_key").alias("n_records")).withColumn("field_name", F.lit(f"{t}.{f}"))
        out = one if out is None else out.unionByName(one)
    return out


def _site() -> Column:
    return F.struct(F.col("source_type"), site_lines.publisher(F.col("file_name")))


def _line_state(spark: SparkSession, chunks: DataFrame, rows: DataFrame | None = None) -> site_lines.LineState:
    """The whole table as one delta upon the empty state."""
    rows = site_lines.lines(chunks, _site(), "doc_id", "text") if rows is None else rows
    return site_lines.merge(site_lines.LineState.empty(spark), rows, site_lines.source_docs(chunks, _site(), "doc_id"))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat excessively within their source."""
    chunks = table(spark, d, "chunks")
    rows = site_lines.lines(chunks.select("chunk_id", "doc_id", "source_type", "file_name", "text"), _site(), "doc_id", "text", keep=["chunk_id"])
    rows = materialize(rows, "lines")  # texts are read once; counting and marking use the hashed lines
    return site_lines.mark(rows, _line_state(spark, chunks, rows).excessive()).select("chunk_id", "line_no").distinct()


def p3_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its site lines taken out; one full load has no earlier result that `affected` could spare."""
    chunks = table(spark, d, "chunks")
    out = site_lines.strip(chunks, _site(), "text", _line_state(spark, chunks).excessive())
    return out.select("chunk_id", "doc_id", "loaded_at", "deleted_at", "text", "lines_removed")


#: Batches of p3_batches; one row in LATE comes a batch late, one in AGAIN comes once more in the last batch.
BATCHES, LATE, AGAIN = 3, 9, 7


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """p3_stripped by partitions of `loaded_at`: deltas of the state, and only documents with crossed lines made anew.

    The state goes through files between partitions; some rows come late; lines of rows that come again count once.
    """
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "source_type", "file_name", "text", "loaded_at", "deleted_at")
    bounds = chunks.agg(F.percentile_approx("loaded_at", [i / BATCHES for i in range(1, BATCHES)]).alias("b")).first()["b"] or []  # two moments
    key = F.xxhash64("chunk_id", "loaded_at")
    batch = sum((F.coalesce((F.col("loaded_at") > F.lit(b)).cast("int"), F.lit(0)) for b in bounds), F.lit(0)) + (F.pmod(key, F.lit(LATE)) == 0).cast("int")
    rows = materialize(chunks.withColumns({"_batch": F.least(batch, F.lit(BATCHES - 1)), "_again": F.pmod(key, F.lit(AGAIN)) == 0}), "batched")
    state, built = site_lines.LineState.empty(spark), None
    for i in range(BATCHES):
        part = rows.where(F.col("_batch") == i)
        again = rows.where((F.col("_batch") < i) & F.col("_again")) if i == BATCHES - 1 else part.limit(0)
        given = part.unionByName(again)
        lines = materialize(site_lines.lines(given, _site(), "doc_id", "text"), "lines")
        state, crossed = site_lines.merge(state, lines, site_lines.source_docs(given, _site(), "doc_id"))
        crossed, state = materialize(crossed, "crossed"), state.save(f"lines-{i}")
        built = site_lines.rebuild(built, rows.where(F.col("_batch") <= i), part, site_lines.affected(state, crossed), _site(), "doc_id", "text", state)
        built = materialize(built, "built")
    return built.select("chunk_id", "doc_id", "loaded_at", "deleted_at", "text", "lines_removed")


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    facts, companies, trust, metrics = (table(spark, d, t) for t in ("facts", "companies", "field_trust", "metric_registry"))
    return survivors.survivors(facts, companies, trust, metrics)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose surviving record beats each of its others."""
    return _survivors(spark, d).where("sure").select("group_id", "fact_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The survivor of every group, with its posterior's parts and the best value of each field."""
    return _survivors(spark, d)


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per group: how many records it has, its survivor where that one is beyond doubt, and whether it is one of the group."""
    out = materialize(_survivors(spark, d), "survivors")
    known = table(spark, d, "facts").select("fact_id", "doc_id", "metric", "period").distinct()
    ours = out.join(known, "fact_id").select("group_id", F.struct("doc_id", "metric", "period").alias("a"))
    theirs = out.join(known, out["group_id"] == known["fact_id"]).select("group_id", F.struct("doc_id", "metric", "period").alias("b"))
    same = ours.join(theirs, "group_id").groupBy("group_id").agg(F.bool_or(F.col("a") == F.col("b")).alias("of_group"))
    return out.join(same, "group_id").select("group_id", "n_records", F.when(F.col("sure"), F.col("fact_id")).alias("sure_fact_id"), "of_group")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(tokens.sizes(table(spark, d, "documents"), "doc_id"), "sizes")
    specs = table(spark, d, "pack_specs")
    return packing.pack(sized, specs, materialize), specs


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds the capacity, for every spec."""
    return _packed(spark, d)[0]


def p6_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each spec are."""
    return packing.utilisation(*_packed(spark, d))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: documents, those whose tokens all stand in containers exactly once, and containers over the capacity."""
    sized = materialize(tokens.sizes(table(spark, d, "documents"), "doc_id"), "sizes")
    specs = table(spark, d, "pack_specs")
    placed = materialize(packing.pack(sized, specs, materialize), "placed")
    pieces = placed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("held"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count("*").alias("n"), F.countDistinct("first_token").alias("starts"))
    whole = (F.col("held") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("n") == F.col("starts"))
    docs = pieces.join(sized, "doc_id").groupBy("spec_id").agg(F.count("*").alias("n_documents"), F.count_if(whole).alias("n_whole"))
    used = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("n")).join(specs, "spec_id")
    over = used.groupBy("spec_id").agg(F.count_if(F.col("used") + F.coalesce("separator_tokens", F.lit(0)) * (F.col("n") - 1) > F.col("capacity_tokens")).alias("n_over"))
    return docs.join(over, "spec_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(tokens.sizes(table(spark, d, "documents"), "doc_id", "source"), "sizes")
    return mixing.draw(sized, table(spark, d, "mix_targets"), materialize)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix, with how many times each is used."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    return mixing.report(*_mixed(spark, d))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: the repetition limit holds, the plan is at the target or at the limit, the draw is at the plan.

    A plan is at the target within SHORTFALL of the mix, among the wanted sources that have documents; a draw is at the
    plan within one document of the source.
    """
    drawn, plans = _mixed(spark, d)
    largest = tokens.sizes(table(spark, d, "documents"), "source").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("tokens").alias("largest"))
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached"), F.max("times").alias("times"))
    rows = plans.join(got, ["mix_id", "source"], "left").join(largest, "source", "left").na.fill(0, ["reached", "times", "largest"])
    mix = Window.partitionBy("mix_id")
    share, wanted = F.col("planned_tokens") / F.sum("planned_tokens").over(mix), F.col("target_share") / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(mix)
    planned = F.col("at_limit") | (F.abs(share - wanted) <= mixing.SHORTFALL + 1e-6)
    return rows.select("mix_id", "source", "target_share", (F.col("times") <= F.col("max_repeats")).alias("within_limit"), planned.alias("planned"), (F.abs(F.col("reached") - F.col("planned_tokens")) <= F.col("largest")).alias("drawn"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return subjects.classify(*(table(spark, d, t) for t in ("documents", "labels", "subjects")))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects that each document treats."""
    return _classified(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Composition of the corpus by subject: documents, and sentences that concern the subject."""
    return _classified(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p2_found, p2_kinds, p3_found, p3_stripped, p3_batches, p5_found, p5_survivors, p5_checked, p6_packing, p6_utilisation, p6_checked, p7_mix, p7_shares, p7_checked, p8_found, p8_composition)}

_SURVIVORS = f"""with n as (select company_id, unnest(list_concat([name], coalesce(aliases, []))) as name from companies), f0 as (select fact_id, {sql_form('company')} as name, doc_id, metric, period, source_date, revision_status, value_type, accounting_scope, min(loaded_at) as t from facts group by all),
    f1 as (select fact_id, company_id, doc_id, metric, period, case when source_date <= cast(t as date) then date_diff('day', date '1900-01-01', source_date) else -1 end as d,
      coalesce((select max(trust) from field_trust where field_name = 'revision_status' and lower(trim(field_value)) = lower(trim(revision_status))), -1) as a,
      coalesce((select max(trust) from field_trust where field_name = 'value_type' and lower(trim(field_value)) = lower(trim(value_type))), -1) as b,
      coalesce((select max(trust) from field_trust where field_name = 'accounting_scope' and lower(trim(field_value)) = lower(trim(accounting_scope))), -1) as c from f0 join n on n.name = trim(f0.name)),
    g as (select *, min(fact_id) over w as group_id, count(*) over w as n, max(d) over w as md, max(a) over w as ma, max(b) over w as mb, max(c) over w as mc from f1 window w as (partition by doc_id, company_id, metric, period)),
    top as (select group_id, min(fact_id) as fact_id from g where n > 1 and d = md and a = ma and b = mb and c = mc group by 1 having count(*) = 1)"""

_LINES = f"""with l as (select chunk_id, doc_id, source_type, regexp_extract(file_name, '^[^_]*_[^_]*_[^_]*_([^：]*)：', 1) as site, unnest(range(len(ls))) + 1 as line_no, regexp_replace(unnest(ls), '[\\s0-9]+', '', 'g') as k from (select *, string_split({sql_form('text')}, chr(10)) as ls from chunks)),
    s as (select source_type, site, count(distinct doc_id) as docs from l group by 1, 2), c as (select source_type, site, k, count(distinct doc_id) as n from l group by 1, 2, 3),
    bad as (select c.source_type, c.site, c.k from c join s on c.source_type = s.source_type and c.site = s.site where n >= 5 and n * 10 >= docs)"""

# What stands out of the form, told by character classes and words instead of by normalising.
_GONE = rf"[\x{{2E80}}-\x{{2FD5}}\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{FB00}}-\x{{FB06}}\x{{1D400}}-\x{{1D7FF}}\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}{WIDE_SIGNS}{HYPHENS}{BLANKS_WITHOUT_FORM}]"
_LETTERS = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{M}"
_ALIKE = CYRILLIC + GREEK + ARMENIAN


def _odd(x: str) -> str:
    words = f"regexp_extract_all({x}, '[{_LETTERS}]+')"
    mixed = rf"list_filter({words}, lambda w: regexp_matches(w, '\p{{Latin}}') and regexp_matches(w, '[{_ALIKE}]') and not regexp_matches(translate(w, '{_ALIKE}', ''), '[\p{{Greek}}\p{{Cyrillic}}\p{{Armenian}}]'))"
    alone = rf"(?:[{CYRILLIC}]+|[{ARMENIAN}]+|[{GREEK}]{{2,}})"
    beside = rf"regexp_matches({x}, '\p{{Latin}}\p{{M}}*[ \-&./]{alone}(?:[^{_LETTERS}]|$)') or regexp_matches({x}, '(?:^|[^{_LETTERS}]){alone}[ \-&./]\p{{Latin}}')"
    return rf"(regexp_matches({x}, '{_GONE}') or regexp_matches(translate({x}, ' ', ''), '[\p{{Z}}\x{{0}}-\x{{9}}\x{{B}}-\x{{1F}}\x{{7F}}-\x{{9F}}]') or nfc_normalize({x}) <> {x} or len({mixed}) > 0 or {beside} or regexp_matches({x}, '[a-z][{SYMBOLS}][a-z]'))"


_STRIPPED = f"""{_LINES}, r as (select row_number() over () as rid, chunk_id, doc_id, loaded_at, deleted_at, source_type, regexp_extract(file_name, '^[^_]*_[^_]*_[^_]*_([^：]*)：', 1) as site, text from chunks),
      e as (select rid, source_type, site, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as t, regexp_replace(unnest(string_split({sql_form('text')}, chr(10))), '[\\s0-9]+', '', 'g') as k from r),
      done as (select rid, coalesce(string_agg(t, chr(10) order by n) filter (where bad.k is null), '') as t, count(bad.k) as gone from e left join bad on e.source_type is not distinct from bad.source_type and e.site = bad.site and e.k = bad.k group by rid)
      select chunk_id, doc_id, loaded_at, deleted_at, done.t as text, cast(coalesce(gone, 0) as int) as lines_removed from r left join done on r.rid = done.rid"""

ORACLE_SQL = {
    "p2_found": " union all ".join(f"select distinct '{t}' as src_table, {k} as src_key, '{t}.{f}' as field_name from {t} where {f} is not null and {_odd(f)}" for t, k, f in (("chunks", "chunk_id", "text"), ("facts", "fact_id", "raw_value"), ("facts", "fact_id", "company"))),
    "p3_found": f"{_LINES} select distinct chunk_id, cast(line_no as int) as line_no from l join bad on l.source_type = bad.source_type and l.site = bad.site and l.k = bad.k",
    "p3_stripped": _STRIPPED,
    "p3_batches": _STRIPPED,
    "p5_found": f"{_SURVIVORS} select group_id, fact_id from top",
    "p5_checked": f"{_SURVIVORS} select g.group_id, count(*) as n_records, max(top.fact_id) as sure_fact_id, true as of_group from g left join top on g.group_id = top.group_id where n > 1 group by 1",
    "p6_checked": "with n as (select count(*) as n from documents where text is not null) select spec_id, n as n_documents, n as n_whole, 0 as n_over from pack_specs, n where capacity_tokens >= 1",
    "p7_checked": "select mix_id, lower(trim(source)) as source, target_share, true as within_limit, true as planned, true as drawn from mix_targets where mix_id is not null and source is not null",
}
