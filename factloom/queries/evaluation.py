"""Queries on claims, labels, events and orders: verification, metrics, calibration, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import claims as cl
from factloom.operators import measures as ms
from factloom.session import table

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return cl.records(table(spark, d, "claims"))


def claim_split(spark: SparkSession, d: str) -> DataFrame:
    return cl.split(_claims(spark, d)).select("claim_id", "claim_idx", "atomic_id")


def claim_types(spark: SparkSession, d: str) -> DataFrame:
    """Type by wording and number of cited reports, beside the recorded one."""
    c = _claims(spark, d)
    docs = cl.evidence(c, table(spark, d, "chunks")).groupBy("claim_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    rows = c.select("claim_id", "claim_type", F.coalesce("text", F.lit("")).alias("text")).join(docs, "claim_id", "left")
    rows = rows.withColumn("derived_type", tx.claim_type(F.col("text"), F.coalesce("n_docs", F.lit(0))))
    return rows.groupBy("claim_type", "derived_type").agg(F.count("*").alias("n"))


def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return cl.verify(_claims(spark, d), table(spark, d, "chunks"))


def claim_lineage_errors(spark: SparkSession, d: str) -> DataFrame:
    return cl.lineage(_claims(spark, d))


def claim_gate(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return cl.gate(cl.verify(c, table(spark, d, "chunks")), c)


def claim_gold_eval(spark: SparkSession, d: str) -> DataFrame:
    """Recorded verification status against the derived one."""
    c = _claims(spark, d)
    rows = c.select("claim_id", F.col("verification.status").alias("recorded")).join(claim_verdicts(spark, d).select("claim_id", "status"), "claim_id")
    rows = rows.where("recorded is not null")
    return rows.groupBy("recorded").agg(F.count("*").alias("n"), ms.rate(F.col("recorded") == F.col("status")).alias("accuracy"), F.count_if(F.col("status") == "ENTAILED").alias("entailed"))


def integrity_issues(spark: SparkSession, d: str) -> DataFrame:
    """Counts of broken rules over claims, chunks and reports."""
    c, ch, m = _claims(spark, d), table(spark, d, "chunks"), table(spark, d, "doc_manifest")
    arrays = c.select("claim_id", "evidence_ids")
    issue = lambda rows, code: rows.agg(F.count("*").alias("n")).withColumn("code", F.lit(code))
    parts = [
        issue(arrays.where("evidence_ids is null or size(evidence_ids) = 0"), "claim_without_evidence"),
        issue(arrays.where(F.exists("evidence_ids", lambda x: x.isNull())), "null_evidence"),
        issue(arrays.where(F.size(F.array_distinct("evidence_ids")) < F.size("evidence_ids")), "repeated_evidence"),
        issue(c.where("text is null or trim(text) = ''"), "claim_without_text"),
        issue(ch.select("chunk_id", "text", "char_count").distinct().where(F.length("text") != F.col("char_count")), "wrong_char_count"),
        issue(ch.select("chunk_id", "page_start", "page_end").distinct().where("page_end < page_start"), "reversed_pages"),
        issue(ch.select("doc_id").distinct().join(m.select("doc_id").distinct(), "doc_id", "left_anti"), "report_not_listed"),
        issue(m.groupBy("doc_id").count().where("count > 1"), "report_listed_again"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Recorded scores as predictors of the recorded status, at nine thresholds."""
    rows = _claims(spark, d).where("verification is not null").select(F.col("verification.score").alias("score"), F.col("verification.status").alias("status"))
    return ms.confusion(rows.where("status is not null"), "score", F.col("status") == "ENTAILED", THRESHOLDS)


def threshold_calibrate(spark: SparkSession, d: str) -> DataFrame:
    return ms.calibrate(threshold_sweep(spark, d), 0.3)


def micro_macro_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Share of cited references that name a chunk, by claim type and overall."""
    c = _claims(spark, d)
    refs = c.select("claim_id", F.explode("evidence_ids").alias("ref")).where("ref is not null")
    names = cl.targets(table(spark, d, "chunks")).select("ref", F.lit(1).alias("ok"))
    per = refs.join(names, "ref", "left").groupBy("claim_id").agg(F.count("ok").alias("num"), F.count("*").alias("den"))
    return ms.micro_macro(c.select("claim_id", F.coalesce("claim_type", F.lit("?")).alias("claim_type")).join(per, "claim_id"), "claim_type", "num", "den")


def profile_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Share of claims that three verification profiles would publish (strict, default, lenient), from one pass."""
    v = claim_verdicts(spark, d)
    cases = {"strict": (F.col("score") >= 0.8) & (F.col("missing_figures") == 0), "default": F.col("status") == "ENTAILED", "lenient": F.col("score") >= 0.4}
    rows = v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), c.cast("int").alias("hit")) for n, c in cases.items()])).alias("p"))
    return rows.groupBy("p.profile").agg(F.count("*").alias("n"), F.sum("p.hit").alias("published"), F.round(F.avg("p.hit"), 6).alias("rate"))


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Labels per subject and rater, with how many documents more than one rater labelled alike."""
    t = table(spark, d, "labels").where("subject is not null").select("doc_id", "subject", "rater").distinct()
    pair = t.groupBy("doc_id", "subject").agg(F.countDistinct("rater").alias("r"))
    return pair.groupBy("subject").agg(F.count("*").alias("n_documents"), F.count_if(F.col("r") > 1).alias("n_agreed"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def percentile_latency(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    p = ms.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(p, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


def api_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens (from the properties), latency and failures per run."""
    e = _events(spark, d).withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), ms.exact_sum(F.col("value")).alias("latency"), F.count_if(F.col("event_type") == "error").alias("failures"))


def api_usage_summary(spark: SparkSession, d: str) -> DataFrame:
    u = api_usage(spark, d).withColumn("_all", F.lit(1))
    p = ms.percentiles(u, ["_all"], "latency", {"p50": 0.5, "p95": 0.95})
    out = u.groupBy("_all").agg(F.count("*").alias("runs"), F.sum("calls").alias("calls"), F.round(F.avg("tokens"), 6).alias("tokens_per_run"), F.round(F.sum("failures") / F.sum("calls"), 6).alias("failure_rate"))
    return out.join(p, "_all").select("runs", "calls", "tokens_per_run", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "failure_rate")


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    return ms.attribution(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "value")


def failure_first_root(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d)


def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _attributed(spark, d)
    return a.agg(F.count("*").alias("runs"), F.count_if(F.col("n_failures") > 0).alias("failed_runs"), F.count_if(F.col("recovered") == 1).alias("recovered_runs"), F.sum("n_failures").alias("failures"), F.round(F.avg("cost_before"), 7).alias("mean_cost_before"))


def trajectory_deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms_ = F.unix_micros(F.col("ts").cast("timestamp"))
    return _events(spark, d).select("event_id", F.floor((ms_ - F.lag(ms_).over(w)) / 1000).cast("bigint").alias("delta_ms"))


def budget_running(spark: SparkSession, d: str) -> DataFrame:
    """Running tokens of each run, and where they pass its budget."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).withColumn("tokens", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)))
    return e.select("event_id", F.sum("tokens").over(w).alias("cum_tokens")).withColumn("exceeded", (F.col("cum_tokens") > 500).cast("int"))


def pool_new_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Per run, the events that bring a kind the run had not seen."""
    first = _events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("user_id", "event_type", F.col("f.event_id").alias("event_id"))


def stream_batch_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind; the streaming form is in factloom.streaming."""
    return _events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), ms.exact_sum(F.col("value")).alias("total"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: a gap of 30 minutes or more starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = _events(spark, d).withColumn("new", (gap.isNull() | (gap >= 30 * 60 * 1000000)).cast("int"))
    e = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n")).drop("s")


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates and a precision over orders by segment, as the test tables hold no runs; `answer_evaluation` has claims."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    return o.groupBy("c_mktsegment").agg(F.count("*").alias("n"), ms.rate(done).alias("finished_rate"), ms.rate(urgent).alias("urgent_rate"), F.round(F.try_divide(F.count_if(done & urgent), F.count_if(urgent)), 6).alias("urgent_precision"))


def badcase_breakdown(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to shipment, by return flag and line status: the table's own delays stand for latencies."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    x = l.select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate").join(o, "l_orderkey")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(days), 6).alias("mean_days"), F.max(days).alias("max_days"))


def agent_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two verification profiles compared measure by measure; passes on a gain without a loss beyond 0.05."""
    m = profile_matrix(spark, d)
    r = lambda n: F.max(F.when(F.col("profile") == n, F.col("rate")))
    out = m.agg(r("default").alias("baseline"), r("lenient").alias("candidate"))
    gain = F.round(F.col("candidate") - F.col("baseline"), 6)
    return out.select("baseline", "candidate", gain.alias("delta"), (gain >= 0.05).cast("int").alias("gate_passed"))


def run_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ms.fingerprint(table(spark, d, "claims").select("claim_id", "text", "claim_type"), ["claim_id", "text", "claim_type"])


def conflicting_groups(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts that stand under several section titles of one report."""
    t = table(spark, d, "chunks").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), "section_title").distinct()
    return t.groupBy("doc_id", "text_sha1").agg(F.countDistinct("section_title").alias("n_sections")).where("n_sections > 1")


QUERIES = {
    f.__name__: f
    for f in (
        claim_split, claim_types, claim_verdicts, claim_lineage_errors, claim_gate, claim_gold_eval, integrity_issues, threshold_sweep, threshold_calibrate, micro_macro_by_category, profile_matrix,
        label_agreement, percentile_latency, api_usage, api_usage_summary, failure_first_root, failure_summary, trajectory_deltas, budget_running, pool_new_kinds, stream_batch_windows, session_windows,
        answer_metrics, badcase_breakdown, latency_summary, agent_quality_gate, run_fingerprint, conflicting_groups,
    )
}


def _oracle() -> dict[str, str]:
    from factloom.queries.retrieval import _words
    from factloom.queries.texts import s_norm, s_strip

    ws = tx.WS
    cid = lambda x: f"'C' || substring(sha1(regexp_replace({s_strip(x)}, '{ws}+', ' ', 'g')), 1, 12)"
    c = "c as (select claim_id, arg_min(coalesce(text, '\\0'), loaded_at) as t0, arg_min(coalesce(claim_type, '\\0'), loaded_at) as ct0, arg_min(coalesce(is_core, false), loaded_at) as is_core, arg_min(coalesce(evidence_ids, ['\\0']), loaded_at) as ev0, arg_min(coalesce(calculation_id, '\\0'), loaded_at) as ca0, arg_min(coalesce(parent_claim_ids, []), loaded_at) as pa, arg_min(struct_pack(v := verification), loaded_at) as ve from claims where claim_id is not null group by 1), cc as (select claim_id, nullif(t0, '\\0') as text, nullif(ct0, '\\0') as claim_type, is_core, case when ev0 = ['\\0'] then null else ev0 end as evidence_ids, nullif(ca0, '\\0') as calculation_id, pa as parent_claim_ids, ve.v as verification from c)"
    ev = c + """, nm as (select chunk_id as ref, 0 as o, chunk_id, doc_id, text from chunks union all select evidence_id, 1, chunk_id, doc_id, text from chunks where evidence_id is not null),
        tg as (select ref, chunk_id, doc_id, text as evidence_text from (select *, row_number() over (partition by ref order by o, chunk_id, doc_id, text) as k from nm) where k = 1),
        rf as (select claim_id, unnest(evidence_ids) as ref from cc), ee as (select distinct claim_id, chunk_id, doc_id, evidence_text from rf join tg using (ref) where ref is not null)"""
    fig = lambda x: f"list_distinct(regexp_extract_all({x}, '[0-9]+(?:\\.[0-9]+)?%?'))"
    ver = ev + f""", pr as (select ee.claim_id, coalesce(cc.text, '') as t, evidence_text as e from ee join cc using (claim_id)),
        sc as (select claim_id, round(len(list_intersect(list_distinct({_words(s_norm('t'))}), {_words(s_norm('e'))})) / greatest(len(list_distinct({_words(s_norm('t'))})), 1), 6) as score,
          len(list_filter({fig('t')}, lambda x: not list_contains({fig('e')}, x))) as missing, cast(regexp_matches(t, '{tx.NEGATION}') <> regexp_matches(e, '{tx.NEGATION}') as int) as flips from pr),
        tp as (select *, row_number() over (partition by claim_id order by score desc, missing, flips) as k, count(*) over (partition by claim_id) as n_evidence from sc),
        ve as (select cc.claim_id, coalesce(n_evidence, 0) as n_evidence, coalesce(score, 0.0) as score, coalesce(missing, 0) as missing_figures, case when n_evidence is null or score < 0.2 then 'INSUFFICIENT' when flips = 1 then 'CONTRADICTED' when missing = 0 and score >= 0.6 then 'ENTAILED' else 'INSUFFICIENT' end as status
          from cc left join (select * from tp where k = 1) x on x.claim_id = cc.claim_id)"""
    sweep = c + ", s as (select verification.score as score, verification.status = 'ENTAILED' as y from cc where verification is not null and verification.status is not null and verification.score is not null), th as (select unnest([" + ", ".join(f"cast({t} as double)" for t in THRESHOLDS) + """]) as threshold),
        cf as (select threshold, count(*) filter (where score >= threshold and y) as tp, count(*) filter (where score >= threshold and not y) as fp, count(*) filter (where score < threshold and not y) as tn, count(*) filter (where score < threshold and y) as fn from s, th group by 1),
        sw as (select *, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from cf)"""
    prof = ver + ", pm as (select 'strict' as profile, cast(score >= 0.8 and missing_figures = 0 as int) as hit from ve union all select 'default', cast(status = 'ENTAILED' as int) from ve union all select 'lenient', cast(score >= 0.4 as int) from ve), pf as (select profile, count(*) as n, sum(hit) as published, round(avg(hit), 6) as rate from pm group by 1)"
    use = "u as (select user_id, count(*) as calls, sum(cast(json_extract_string(props, '$.k') as bigint)) as tokens, cast(round(sum(cast(value as decimal(18, 6))), 4) as double) as latency, count(*) filter (where event_type = 'error') as failures from events group by 1)"
    att = """s as (select *, event_type = 'error' as f, row_number() over w as step, coalesce(lag(event_type = 'error') over w, false) as pf from events window w as (partition by user_id order by ts, event_id)),
        s2 as (select *, min(step) filter (where f) over (partition by user_id) as first from s),
        a as (select user_id, count(*) as n_steps, count(*) filter (where f) as n_failures, min(first) as first_failure, max(step) filter (where f and not pf) as root_failure, max(step) filter (where f) as last_failure, cast(round(sum(cast(value as decimal(18, 6))) filter (where step < first), 4) as double) as cost_before from s2 group by 1), b as (select *, cast(last_failure < n_steps as int) as recovered from a)"""
    lanes = ", ".join(f"cast(sum(cast(cast('0x' || substring(h, {1 + 8 * i}, 8) as ubigint) as hugeint)) as varchar) as lane_{i}" for i in range(4))
    return {
        "claim_split": f"with {c}, p as (select claim_id, list_filter(list_transform(string_split_regex(text, '[。！？!?；;]'), lambda x: {s_strip('x')}), lambda x: x <> '') as ps from cc where text is not null), q as (select claim_id, unnest(range(len(ps))) as claim_idx, unnest(ps) || '。' as piece from p) select claim_id, claim_idx, {cid('piece')} as atomic_id from q",
        "claim_types": f"with {ev}, nd as (select claim_id, count(distinct doc_id) as n_docs from ee group by 1) select claim_type, case when regexp_matches(lower(coalesce(text, '')), '{tx.DERIVED}') then 'DERIVED' when n_docs >= 2 then 'SYNTHESIZED' else 'EXTRACTED' end as derived_type, count(*) as n from cc left join nd using (claim_id) group by 1, 2",
        "claim_verdicts": f"with {ver} select * from ve",
        "claim_lineage_errors": f"""with recursive {c}, e as (select distinct claim_id, p as parent from (select claim_id, unnest(parent_claim_ids) as p from cc) where p is not null), r as (select claim_id as start, parent as at from e union select r.start, e.parent from r join e on e.claim_id = r.at)
            select claim_id, 'unstable_claim_id' as error from cc where {cid("coalesce(text, '')")} <> claim_id union all select distinct claim_id, 'parent_claim_missing' from e where parent not in (select claim_id from cc)
            union all select distinct r.start, 'parent_claim_cycle' from r where r.at = r.start""",
        "claim_gate": f"""with {ver}, g as (select calculation_id, count(*) as n_claims, count(*) filter (where status = 'ENTAILED') as n_entailed, count(*) filter (where is_core and status <> 'ENTAILED') as n_core_open from cc join ve using (claim_id) where calculation_id is not null group by 1)
            select *, case when n_core_open = 0 and n_entailed = n_claims then 'publish' when n_entailed > 0 then 'partial' else 'withhold' end as decision from g""",
        "claim_gold_eval": f"with {ver} select cc.verification.status as recorded, count(*) as n, round(avg(cast(cc.verification.status = ve.status as int)), 6) as accuracy, count(*) filter (where ve.status = 'ENTAILED') as entailed from cc join ve using (claim_id) where cc.verification.status is not null group by 1",
        "integrity_issues": f"""with {c} select 'claim_without_evidence' as code, count(*) as n from cc where evidence_ids is null or len(evidence_ids) = 0 union all select 'null_evidence', count(*) from cc where len(list_filter(evidence_ids, lambda x: x is null)) > 0
            union all select 'repeated_evidence', count(*) from cc where len(list_distinct(evidence_ids)) + cast(len(list_filter(evidence_ids, lambda x: x is null)) > 0 as int) < len(evidence_ids) union all select 'claim_without_text', count(*) from cc where text is null or trim(text) = ''
            union all select 'wrong_char_count', count(*) from (select distinct chunk_id, text, char_count from chunks) where length(text) <> char_count union all select 'reversed_pages', count(*) from (select distinct chunk_id, page_start, page_end from chunks) where page_end < page_start
            union all select 'report_not_listed', count(*) from (select distinct doc_id from chunks where doc_id not in (select doc_id from doc_manifest)) union all select 'report_listed_again', count(*) from (select doc_id from doc_manifest group by 1 having count(*) > 1)""",
        "threshold_sweep": f"with {sweep} select * from sw",
        "threshold_calibrate": f"with {sweep} select * from sw where precision >= 0.3 order by f1 desc nulls last, threshold desc limit 1",
        "micro_macro_by_category": f"""with {ev}, p as (select claim_id, count(tg.ref) as num, count(*) as den from rf left join tg using (ref) where rf.ref is not null group by 1), q as (select coalesce(claim_type, '?') as claim_type, num, den, num / den as r from cc join p using (claim_id))
            select claim_type, grouping(claim_type) as overall, sum(num) as numerator, sum(den) as denominator, round(sum(num) / sum(den), 6) as micro, round(avg(r), 6) as macro from q group by rollup(claim_type)""",
        "profile_matrix": f"with {prof} select * from pf",
        "label_agreement": "with p as (select doc_id, subject, count(distinct rater) as r from labels where subject is not null group by 1, 2) select subject, count(*) as n_documents, count(*) filter (where r > 1) as n_agreed from p group by 1",
        "percentile_latency": "select event_type, round(quantile_cont(cast(value as double), 0.5), 6) as p50, round(quantile_cont(cast(value as double), 0.95), 6) as p95, count(*) as n from events group by 1",
        "api_usage": f"with {use} select * from u",
        "api_usage_summary": f"with {use} select count(*) as runs, sum(calls) as calls, round(avg(tokens), 6) as tokens_per_run, round(quantile_cont(latency, 0.5), 4) as p50, round(quantile_cont(latency, 0.95), 4) as p95, round(sum(failures) / sum(calls), 6) as failure_rate from u",
        "failure_first_root": f"with {att} select * from b",
        "failure_summary": f"with {att} select count(*) as runs, count(*) filter (where n_failures > 0) as failed_runs, count(*) filter (where recovered = 1) as recovered_runs, sum(n_failures) as failures, round(avg(cost_before), 7) as mean_cost_before from b",
        "trajectory_deltas": "select event_id, cast(floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000.0) as bigint) as delta_ms from events",
        "budget_running": "with e as (select event_id, sum(coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)) over (partition by user_id order by ts, event_id rows unbounded preceding) as cum_tokens from events) select *, cast(cum_tokens > 500 as int) as exceeded from e",
        "pool_new_kinds": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1",
        "stream_batch_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, cast(round(sum(cast(value as decimal(18, 6))), 4) as double) as total from events group by 1, 2",
        "session_windows": "with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events), s as (select *, sum(case when gap is null or gap >= 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n from s group by user_id, s",
        "answer_metrics": "select c_mktsegment, count(*) as n, round(avg(cast(o_orderstatus = 'F' as int)), 6) as finished_rate, round(avg(cast(o_orderpriority = '1-URGENT' as int)), 6) as urgent_rate, round(count(*) filter (where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') / nullif(count(*) filter (where o_orderpriority = '1-URGENT'), 0), 6) as urgent_precision from orders join customer on c_custkey = o_custkey group by 1",
        "badcase_breakdown": "select o_orderstatus, o_orderpriority, count(*) as n from orders where o_orderstatus <> 'F' group by 1, 2",
        "latency_summary": "select l_returnflag, l_linestatus, count(*) as n, round(avg(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))), 6) as mean_days, max(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))) as max_days from lineitem join orders on o_orderkey = l_orderkey group by 1, 2",
        "agent_quality_gate": f"with {prof}, g as (select max(rate) filter (where profile = 'default') as baseline, max(rate) filter (where profile = 'lenient') as candidate from pf) select baseline, candidate, round(candidate - baseline, 6) as delta, cast(round(candidate - baseline, 6) >= 0.05 as int) as gate_passed from g",
        "run_fingerprint": f"with h as (select sha256(coalesce(claim_id, chr(0)) || chr(31) || coalesce(text, chr(0)) || chr(31) || coalesce(claim_type, chr(0))) as h from claims) select count(*) as n, {lanes} from h",
        "conflicting_groups": "with t as (select distinct doc_id, sha1(text) as text_sha1, section_title from chunks) select doc_id, text_sha1, count(distinct section_title) as n_sections from t group by 1, 2 having count(distinct section_title) > 1",
    }


ORACLE_SQL = _oracle()
