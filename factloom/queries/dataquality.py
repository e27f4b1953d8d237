"""Queries of the general problems: dead references and unlike units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.form import sql_form
from factloom.operators import orphans, units
from factloom.session import materialize, table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts, chunks, claims, reports = (table(spark, d, t) for t in ("facts", "chunks", "claims", "doc_manifest"))
    refs = orphans.references(facts, "facts", "fact_id", "evidence_id", "evidence")
    refs = refs.unionByName(orphans.references(facts, "facts", "fact_id", "doc_id", "report"))
    refs = refs.unionByName(orphans.references(chunks, "chunks", "chunk_id", "parent_chunk_id", "parent"))
    refs = refs.unionByName(orphans.references(claims, "claims", "claim_id", "evidence_ids", "evidence"))
    events = orphans.parent_events(chunks, {"chunk_id": ("evidence", "parent"), "evidence_id": ("evidence",)})
    return refs, events.unionByName(orphans.parent_events(reports, {"doc_id": ("report",)}))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that was dead when its record came: one advance of the state over the whole history."""
    refs, events = _references(spark, d)
    state, _ = orphans.advance(orphans.OrphanState.empty(spark), refs, events)
    return state.refs.where("dead_at_birth").select("src_table", "src_key", "ref_field", "ref_key")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per table, field and month: references, dead at birth, open at the end of history."""
    refs, events = _references(spark, d)
    state, _ = orphans.advance(orphans.OrphanState.empty(spark), refs, events)
    return orphans.snapshot(state)


#: Batches of p1_batches: one row in LATE comes a batch late, one reference in AGAIN comes once more in the last batch.
BATCHES, LATE, AGAIN = 3, 9, 7


def _batched(df: DataFrame, at: str, bounds: list, keys: list[str]) -> DataFrame:
    """`df` with the batch (from 0) it comes in, by its time; some rows come a batch late."""
    on_time = sum((F.when(F.col(at) > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    late = (F.pmod(F.xxhash64(*keys), F.lit(LATE)) == 0).cast("int")
    return df.withColumn("batch", F.least(on_time + late, F.lit(BATCHES - 1)))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """p1_orphan_counts by batches: the state goes through files between them, rows come late, references come again."""
    refs, events = _references(spark, d)
    bounds = table(spark, d, "facts").agg(F.percentile_approx("loaded_at", [i / BATCHES for i in range(1, BATCHES)]).alias("b")).first()["b"] or []  # two moments
    refs = materialize(_batched(refs, "born", bounds, ["src_key", "ref_key"]), "batched-refs")
    events = materialize(_batched(events, "ts", bounds, ["k1", "k2", "ts"]), "batched-events")
    again = refs.where(F.pmod(F.xxhash64("src_key", "born"), F.lit(AGAIN)) == 0).withColumn("batch", F.lit(BATCHES - 1))
    state = orphans.OrphanState.empty(spark)
    for i in range(BATCHES):
        state, _ = orphans.advance(state, refs.unionByName(again).where(F.col("batch") == i).drop("batch"), events.where(F.col("batch") == i).drop("batch"))
        state = state.save(f"batch-{i}")
    return orphans.snapshot(state)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose stored value differs from the printed quantity in their metric's common unit."""
    facts, metrics = table(spark, d, "facts"), table(spark, d, "metric_registry")
    q = units.convert(facts.select("fact_id", "metric", "value", "raw_value", "unit"), metrics)
    return q.where(F.col("quantity").isNotNull() & ~F.col("value").eqNullSafe(F.col("quantity"))).select("fact_id").distinct()


def p4_units_seen(spark: SparkSession, d: str) -> DataFrame:
    """How often each unit was printed or only recorded, and how often the stored value was off."""
    facts, metrics = table(spark, d, "facts"), table(spark, d, "metric_registry")
    q = units.convert(facts.select("fact_id", "metric", "value", "raw_value", "unit"), metrics)
    wrong = (~F.col("value").eqNullSafe(F.col("quantity"))).cast("bigint")
    return q.groupBy("dimension", "unit_used", "unit_from").agg(F.count("*").alias("n"), F.sum(wrong).alias("n_off"), F.min("factor").alias("factor"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_counts, p1_batches, p4_found, p4_units_seen)}


def _key(x: str) -> str:
    return f"lower(trim({sql_form(x)}))"


def _some(x: str) -> str:
    return f"regexp_matches({x}, '[\\p{{L}}\\p{{N}}]')"


_REFS = " union all ".join(
    f"select '{t}' as src_table, {k} as src_key, '{t}.{f}' as ref_field, r as ref_key, '{target}' as target, loaded_at from (select {k}, loaded_at, {e} as r from {t}) where r is not null and {_some('r')}"
    for t, k, f, e, target in (("facts", "fact_id", "evidence_id", "evidence_id", "e"), ("facts", "fact_id", "doc_id", "doc_id", "d"), ("chunks", "chunk_id", "parent_chunk_id", "parent_chunk_id", "p"), ("claims", "claim_id", "evidence_ids", "unnest(evidence_ids)", "e"))
)
_ORPHANS = f"""with r0 as ({_REFS}), r as (select src_table, src_key, ref_field, ref_key, target, {_key('ref_key')} as k, min(loaded_at) as t from r0 group by all),
    p as (select 'e' as target, {_key('chunk_id')} as k, loaded_at as a, deleted_at as b from chunks union all select 'e', {_key('evidence_id')}, loaded_at, deleted_at from chunks where evidence_id is not null and {_some('evidence_id')}
      union all select 'p', {_key('chunk_id')}, loaded_at, deleted_at from chunks union all select 'd', {_key('doc_id')}, loaded_at, deleted_at from doc_manifest),
    alive as (select distinct r.src_key, r.ref_field, r.ref_key from r join p on p.target = r.target and p.k = r.k and p.a <= r.t and (p.b is null or p.b > r.t)),
    now as (select distinct target, k from p where b is null), dead as (select r.*, alive.src_key is null as dead, now.k is null as open from r left join alive on alive.src_key = r.src_key and alive.ref_field = r.ref_field and alive.ref_key = r.ref_key left join now on now.target = r.target and now.k = r.k)"""

_COUNTS = f"{_ORPHANS} select src_table, ref_field, strftime(t, '%Y-%m') as month, count(*) as n_refs, count(*) filter (where dead) as n_dead, count(*) filter (where open) as n_open from dead group by 1, 2, 3"

ORACLE_SQL = {
    "p1_found": f"{_ORPHANS} select src_table, src_key, ref_field, ref_key from dead where dead",
    "p1_orphan_counts": _COUNTS,
    "p1_batches": _COUNTS,
}
