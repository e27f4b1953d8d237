"""Plan queries: each run of events is a plan, each event a step that needs the one before it of the same kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import chunking
from factloom.plans import steps as ps
from factloom.queries.texts import _TITLE, s_norm
from factloom.session import table


def _plans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims as plans: a claim is a step of its calculation, and needs its parent claims."""
    c = table(spark, d, "claims").where("claim_id is not null and calculation_id is not null")
    one = c.groupBy("claim_id").agg(F.min_by(F.struct("calculation_id", "is_core", "parent_claim_ids", "verification"), "loaded_at").alias("r"))
    status = F.when(F.col("r.verification.status") == "CONTRADICTED", "FAILED").when(F.col("r.verification.status").isNull(), "PENDING").otherwise("SUCCESS")
    steps = one.select(F.col("r.calculation_id").alias("plan_id"), F.col("claim_id").alias("step_id"), F.coalesce("r.is_core", F.lit(False)).alias("required"), status.alias("status"))
    edges = one.select(F.col("r.calculation_id").alias("plan_id"), F.col("claim_id").alias("step_id"), F.explode("r.parent_claim_ids").alias("needs"))
    inside = steps.select("plan_id", F.col("step_id").alias("needs"))
    return steps, edges.join(inside, ["plan_id", "needs"], "left_semi").select("plan_id", "step_id", "needs")


def plan_levels(spark: SparkSession, d: str) -> DataFrame:
    return ps.levels(*_plans(spark, d)).groupBy("level").agg(F.count("*").alias("n_steps"))


def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ps.coverage(*_plans(spark, d))


def chunk_parent_child(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children that packing cuts each document into."""
    return chunking.parent_child(table(spark, d, "documents")).groupBy("doc_id").agg(F.countDistinct("parent_idx").alias("n_parent"), F.count("*").alias("n_child"), F.max(F.length("text")).alias("longest"))


def chunk_title_aware(spark: SparkSession, d: str) -> DataFrame:
    """Sections under running titles, and whether chunks keep to them: sections of each document, and those with a title."""
    rows = chunking.title_aware(table(spark, d, "documents"))
    out = rows.groupBy("doc_id").agg(F.countDistinct("section_idx").alias("n_sections"), F.countDistinct(F.when(F.col("title").isNotNull(), F.col("section_idx"))).alias("n_titled"), F.max(F.length("text")).alias("longest"))
    return out.select("doc_id", "n_sections", "n_titled", (F.col("longest") <= chunking.TITLED + chunking.TITLED_OVERLAP + 1).cast("int").alias("within_size"))


def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The three ways of cutting a document side by side: chunks and characters of each."""
    docs = table(spark, d, "documents")
    parts = {"parent_child": chunking.parent_child(docs), "title_aware": chunking.title_aware(docs)}
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")).withColumn("strategy_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    n = F.length(tx.normalize(F.col("text")))
    windows = F.when(n <= 700, 1).otherwise(F.ceil((n - 700) / 600) + 1)
    fixed = docs.where(F.col("text").rlike(r"\S")).select("doc_id", windows.cast("bigint").alias("n_chunks"), (n + (windows - 1) * 100).cast("bigint").alias("n_chars"), F.lit("fixed_window").alias("strategy_name"))
    out = out.unionByName(fixed)
    return out.groupBy("strategy_name").agg(F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.round(F.sum("n_chars") / F.sum("n_chunks"), 2).alias("mean_chars"))


QUERIES = {f.__name__: f for f in (plan_levels, plan_coverage, chunk_parent_child, chunk_title_aware, chunk_strategies)}

_PLANS = """c as (select claim_id, arg_min(calculation_id, loaded_at) as plan_id, arg_min(coalesce(is_core, false), loaded_at) as required, arg_min(coalesce(parent_claim_ids, []), loaded_at) as pa, arg_min(struct_pack(v := verification), loaded_at) as ve from claims where claim_id is not null and calculation_id is not null group by 1),
    st as (select plan_id, claim_id as step_id, required, case when ve.v.status = 'CONTRADICTED' then 'FAILED' when ve.v.status is null then 'PENDING' else 'SUCCESS' end as status from c),
    e as (select distinct c.plan_id, c.claim_id as step_id, p as needs from (select plan_id, claim_id, unnest(pa) as p from c) c join st on st.plan_id = c.plan_id and st.step_id = p)"""

ORACLE_SQL = {
    "chunk_title_aware": f"""with l as (select doc_id, unnest(string_split({s_norm('text')}, chr(10))) as n, unnest(range(len(string_split({s_norm('text')}, chr(10))))) as i from documents where regexp_matches(text, '\\S')),
        t as (select doc_id, i, coalesce({_TITLE}, false) as is_title from l)
        select doc_id, count(*) filter (where is_title or i = 0) as n_sections, count(*) filter (where is_title) as n_titled, 1 as within_size from t group by 1""",
    "plan_levels": f"with recursive {_PLANS}, r as (select plan_id, step_id, 0 as level from st union select e.plan_id, e.step_id, r.level + 1 from r join e on e.plan_id = r.plan_id and e.needs = r.step_id where r.level < 50), m as (select plan_id, step_id, max(level) as level from r group by 1, 2) select level, count(*) as n_steps from m group by 1",
    "plan_coverage": f"""with recursive {_PLANS}, b as (select plan_id, step_id from st where status = 'FAILED' union select e.plan_id, e.step_id from b join e on e.plan_id = b.plan_id and e.needs = b.step_id),
        k as (select st.plan_id, count(*) filter (where required) as n_required, count(*) filter (where required and status = 'SUCCESS' and b.step_id is null) as n_covered from st left join b on b.plan_id = st.plan_id and b.step_id = st.step_id group by 1)
        select *, round(n_covered / nullif(n_required, 0), 6) as coverage_ratio, case when n_covered = n_required then 'answer' when n_covered > 0 then 'partial' else 'abstain' end as decision from k""",
}
