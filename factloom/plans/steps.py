"""Multi-step plans as tables: steps and dependency edges in, levels, coverage and decisions out.

A plan is a set of steps (plan_id, step_id, required, status) and edges (plan_id, step_id, needs).  Everything is
set-at-a-time over all plans; the loop below runs once per level, never per plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

KEY = ["plan_id", "step_id"]


def levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps with their level (longest chain of needs, 0 without); steps on or behind a cycle have a null level."""
    edges = edges.where("needs is not null").select(*KEY, "needs").distinct()
    done = materialize(steps.select(*KEY).distinct().join(edges.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    level = 0
    while True:
        ready = done.select("plan_id", F.col("step_id").alias("needs"), F.lit(True).alias("ok"))
        open_ = edges.join(done.select(*KEY), KEY, "left_anti").join(ready, ["plan_id", "needs"], "left")
        next_ = open_.groupBy(*KEY).agg(F.every(F.coalesce("ok", F.lit(False))).alias("all")).where("all")
        level += 1
        next_ = materialize(next_.select(*KEY, F.lit(level).alias("level")), "levels")
        if next_.isEmpty():
            return steps.join(done, KEY, "left")
        done = done.unionByName(next_)


def failed_through(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that failed themselves or need, at any distance, one that did."""
    hit = materialize(steps.where("status = 'FAILED'").select(*KEY).distinct(), "failed")
    frontier = hit
    while True:
        more = edges.join(frontier.select("plan_id", F.col("step_id").alias("needs")), ["plan_id", "needs"], "left_semi").select(*KEY).distinct()
        frontier = materialize(more.join(hit, KEY, "left_anti"), "failed")
        if frontier.isEmpty():
            return hit
        hit = hit.unionByName(frontier)


def coverage(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Per plan: required steps, those covered (succeeded, with all they need), ratio and decision."""
    broken = failed_through(steps, edges).withColumn("_bad", F.lit(True))
    rows = steps.join(broken, KEY, "left").withColumn("ok", (F.col("status") == "SUCCESS") & F.col("_bad").isNull())
    out = rows.groupBy("plan_id").agg(F.count_if("required").alias("n_required"), F.count_if(F.col("required") & F.col("ok")).alias("n_covered"))
    ratio = F.round(F.try_divide(F.col("n_covered"), F.col("n_required")), 6)
    return out.withColumn("coverage_ratio", ratio).withColumn("decision", F.when(F.col("n_covered") == F.col("n_required"), "answer").when(F.col("n_covered") > 0, "partial").otherwise("abstain"))
