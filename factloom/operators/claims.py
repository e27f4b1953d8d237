"""Claims: stable ids, types, splitting, verification by tokens and figures, lineage and gating.

One record per `claim_id` (earliest loading); null texts are empty, null arrays have no elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.session import materialize

#: Overlap from which a claim counts as entailed, and below which it has no support.
ENTAILED, SUPPORTED = 0.6, 0.2


def records(claims: DataFrame) -> DataFrame:
    carried = [c for c in claims.columns if c not in ("claim_id", "loaded_at")]
    one = claims.where("claim_id is not null").groupBy("claim_id").agg(F.min_by(F.struct(*carried), "loaded_at").alias("r"), F.min("loaded_at").alias("loaded_at"))
    return one.select("claim_id", "r.*", "loaded_at")


def targets(chunks: DataFrame) -> DataFrame:
    """What a reference may name: every chunk id, and every second name that is not a chunk id; one row each, ids only."""
    a = chunks.select(F.col("chunk_id").alias("ref"), F.lit(0).alias("o"), "chunk_id", "doc_id")
    b = chunks.where("evidence_id is not null").select(F.col("evidence_id").alias("ref"), F.lit(1).alias("o"), "chunk_id", "doc_id")
    return a.unionByName(b).groupBy("ref").agg(F.min(F.struct("o", "chunk_id", "doc_id")).alias("r")).select("ref", "r.chunk_id", "r.doc_id")


def cited(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """`refs` (with `ref`) beside the chunk each names, and its text: ids are resolved first, then texts of cited chunks fetched."""
    found = refs.join(targets(chunks), "ref")
    one = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id", "doc_id").agg(F.min("text").alias("text"))
    return found.join(one, ["chunk_id", "doc_id"])


def evidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per claim and distinct chunk it cites."""
    refs = claims.select("claim_id", F.explode("evidence_ids").alias("ref")).where("ref is not null")
    return cited(refs, chunks).select("claim_id", "chunk_id", "doc_id", F.col("text").alias("evidence_text")).dropDuplicates(["claim_id", "chunk_id"])


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[。！？!?；;]"), tx.strip), lambda x: x != "")


def split(claims: DataFrame) -> DataFrame:
    """Atomic claims of each text: its sentences, with their stable ids."""
    rows = claims.where("text is not null").select("claim_id", F.posexplode(sentences(F.col("text"))).alias("claim_idx", "piece"))
    return rows.withColumn("atomic_id", tx.claim_id(F.concat("piece", F.lit("。"))))


def figures(c: Column) -> Column:
    """Distinct plain figures of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0)))


def verify(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best overlap with any cited chunk, figures found there, and the verdict.

    A claim without evidence is INSUFFICIENT; one whose figures all stand in its evidence and whose overlap is high is
    ENTAILED; one that overlaps but negates what the evidence does not (or the reverse) is CONTRADICTED.
    """
    pairs = evidence(claims, chunks).join(claims.select("claim_id", F.coalesce("text", F.lit("")).alias("text")), "claim_id")
    a, b = tx.words(F.col("text")), tx.words(F.col("evidence_text"))
    pairs = pairs.withColumns({
        "score": F.round(tx.overlap(a, b), 6), "missing": F.size(F.array_except(figures(F.col("text")), figures(F.col("evidence_text")))),
        "flips": (F.col("text").rlike(tx.NEGATION) != F.col("evidence_text").rlike(tx.NEGATION)).cast("int"),
    })
    top = pairs.groupBy("claim_id").agg(F.max(F.struct("score", (-F.col("missing")).alias("m"), (-F.col("flips")).alias("f"))).alias("t"), F.count("*").alias("n_evidence"))
    out = claims.select("claim_id").join(top, "claim_id", "left")
    score, missing, flips = F.coalesce(F.col("t.score"), F.lit(0.0)), -F.col("t.m"), -F.col("t.f")
    status = F.when(F.col("n_evidence").isNull() | (score < SUPPORTED), "INSUFFICIENT").when(flips == 1, "CONTRADICTED").when((missing == 0) & (score >= ENTAILED), "ENTAILED").otherwise("INSUFFICIENT")
    return out.select("claim_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), score.alias("score"), F.coalesce(missing, F.lit(0)).alias("missing_figures"), status.alias("status"))


def lineage(claims: DataFrame) -> DataFrame:
    """(claim_id, error): ids that do not fit their text, missing parents, and claims on a cycle of parents.

    Cycles are what is left when edges whose parent has no parent, or whose claim is nobody's parent, leave round after
    round until nothing changes.  A round is two semi-joins on ids, its result written to the shared folder.
    """
    unstable = claims.where(tx.claim_id(F.coalesce("text", F.lit(""))) != F.col("claim_id")).select("claim_id", F.lit("unstable_claim_id").alias("error"))
    edges = claims.select("claim_id", F.explode("parent_claim_ids").alias("parent")).where("parent is not null").distinct()
    missing = edges.join(claims.select(F.col("claim_id").alias("parent")), "parent", "left_anti").select("claim_id", F.lit("parent_claim_missing").alias("error")).distinct()
    live, n = materialize(edges, "lineage"), -1
    while (left := live.count()) not in (n, 0):
        n = left
        ups, downs = live.select(F.col("claim_id").alias("parent")).distinct(), live.select(F.col("parent").alias("claim_id")).distinct()
        live = materialize(live.join(ups, "parent", "left_semi").join(downs, "claim_id", "left_semi").select("claim_id", "parent"), "lineage")
    cycle = live.select("claim_id", F.lit("parent_claim_cycle").alias("error")).distinct()
    return unstable.unionByName(missing).unionByName(cycle)


def gate(verified: DataFrame, claims: DataFrame) -> DataFrame:
    """Per group of claims (one calculation): publish if every core claim is entailed, in part if any claim is."""
    rows = claims.select("claim_id", "calculation_id", "is_core").where("calculation_id is not null").join(verified, "claim_id")
    core, good = F.coalesce("is_core", F.lit(False)), F.col("status") == "ENTAILED"
    out = rows.groupBy("calculation_id").agg(F.count("*").alias("n_claims"), F.count_if(good).alias("n_entailed"), F.count_if(core & ~good).alias("n_core_open"))
    return out.withColumn("decision", F.when((F.col("n_core_open") == 0) & (F.col("n_entailed") == F.col("n_claims")), "publish").when(F.col("n_entailed") > 0, "partial").otherwise("withhold"))
