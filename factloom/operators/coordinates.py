"""Numeric statements read by their coordinates: extraction with reasons, stable keys, verdicts against records.

A statement has a company, metric, period, value type and quantity, and may have a scope and a revision.  A record
supports it if all these agree and the quantity is equal; it conflicts if all agree, both name scope and revision, and
the quantity differs; it stays unresolved if the quantity differs but scope or revision are not named on both sides.
A conflict outweighs support, and what is unresolved withholds a verdict.

Statements are never paired with records.  Records are counted per coordinate under each of the four choices of scope
and revision (named or left open), with and without their quantity; a statement reads its own choice by equi-joins.
Nulls in a mandatory coordinate make a statement incomplete and a record no evidence; repeated rows of one record count
once; empty tables give no verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx

BASE = ["company", "metric", "kind", "year", "value_type", "dimension"]
MANDATORY = ["company", "metric", "kind", "year", "value_type", "quantity"]
# Scales of the units a statement may be written in, with their dimension.
SCALES = {"元": ("currency", "1"), "千元": ("currency", "1000"), "万": ("currency", "10000"), "万元": ("currency", "10000"), "亿": ("currency", "100000000"), "亿元": ("currency", "100000000"), "%": ("percentage", "1"), "元/股": ("per_share", "1")}


def scaled(value: Column, unit: Column) -> tuple[Column, Column]:
    """(dimension, quantity) of a value with a unit of SCALES; null for any other unit."""
    name = F.lower(F.trim(unit))
    dimension = quantity = F.lit(None)
    for u, (kind, factor) in SCALES.items():
        dimension = F.when(name == u, kind).otherwise(dimension)
        quantity = F.when(name == u, F.try_multiply(value.cast("decimal(28,6)"), F.lit(factor).cast("decimal(9,0)"))).otherwise(quantity)
    return dimension.cast("string"), quantity.try_cast("decimal(38,6)")


def missing(names: list[str] = MANDATORY) -> Column:
    """Names of the coordinates a statement lacks, in order."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def _choices(rows: DataFrame) -> DataFrame:
    """Each record under every choice of coordinates it can answer: scope and revision named, or left open."""
    both = [(0, None, None), (1, "scope", None), (2, None, "revision"), (3, "scope", "revision")]
    each = [
        F.when(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in (s, r) if n], F.lit(True)), F.struct(F.lit(m).alias("choice"), (F.col(s) if s else F.lit("")).alias("s"), (F.col(r) if r else F.lit("")).alias("r")))
        for m, s, r in both
    ]
    return rows.select(*BASE, "quantity", F.explode(F.array_compact(F.array(*each))).alias("c")).select(*BASE, "quantity", "c.*")


def verdicts(statements: DataFrame, records: DataFrame, key: str, own: bool = False) -> DataFrame:
    """`key`, n_support, n_conflict, n_unresolved, status and reason of every statement.

    Both sides have BASE, `quantity`, `scope` and `revision`; with `own` each statement is itself among the records and
    does not count.
    """
    lacks = missing()
    complete = statements.where(F.size(lacks) == 0)
    side = [*BASE, "choice", "s", "r"]
    known = _choices(records.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in [*MANDATORY, "dimension"]])))
    equal = known.groupBy(*side, "quantity").agg(F.count("*").alias("n_equal"))
    whole = equal.groupBy(*side).agg(F.sum("n_equal").alias("n_all"))
    choice = F.when(F.col("scope").isNotNull(), 1).otherwise(0) + F.when(F.col("revision").isNotNull(), 2).otherwise(0)
    asked = complete.select(key, *BASE, "quantity", choice.alias("choice"), F.coalesce("scope", F.lit("")).alias("s"), F.coalesce("revision", F.lit("")).alias("r"))
    out = asked.join(equal, [*side, "quantity"], "left").join(whole, side, "left")
    less = 1 if own else 0
    n_equal, n_all = F.coalesce("n_equal", F.lit(0)), F.coalesce("n_all", F.lit(0))
    differ = n_all - n_equal
    out = out.select(key, (n_equal - less).alias("n_support"), F.when(F.col("choice") == 3, differ).otherwise(0).alias("n_conflict"), F.when(F.col("choice") == 3, 0).otherwise(differ).alias("n_unresolved"), F.lit("").alias("lacks"))
    zero = F.lit(0).cast("bigint")
    rest = statements.where(F.size(lacks) > 0).select(key, zero.alias("n_support"), zero.alias("n_conflict"), zero.alias("n_unresolved"), F.array_join(lacks, ",").alias("lacks"))
    out = out.unionByName(rest)
    s, c, u = F.col("n_support") > 0, F.col("n_conflict") > 0, F.col("n_unresolved") > 0
    status = F.when(c, "CONTRADICTED").when(~u & s, "ENTAILED").otherwise("INSUFFICIENT")
    reason = (
        F.when(F.col("lacks") != "", F.concat(F.lit("missing:"), F.col("lacks"))).when(c & s, "support_and_conflict").when(c, "numeric_value_conflict")
        .when(u, "numeric_conflict_dimensions_incomplete").when(s, "all_numeric_constraints_match").otherwise("no_evidence_matches_all_numeric_constraints")
    )
    return out.select(key, "n_support", "n_conflict", "n_unresolved", status.alias("status"), reason.alias("reason"))


def longest_alias(text: Column, names: list[tuple[str, str]]) -> Column:
    """The name whose longest alias a text holds (names of a small fixed table, written into the expression)."""
    hits = [F.when(F.contains(text, F.lit(a)), F.struct(F.lit(-len(a)).alias("l"), F.lit(n).alias("n"))) for n, a in sorted(set(names)) if a]
    return F.array_min(F.array(*hits))["n"] if hits else F.lit(None).cast("string")


def clean_value(raw: Column) -> Column:
    """A printed value without blanks and without a leading about, nearly or above."""
    return F.regexp_replace(F.regexp_replace(raw, rf"{tx.WS}+", ""), "^(大约|约|近|逾|超)(?=[0-9])", "")


def extract(candidates: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Candidates with the coordinates their span states, and the first reason to reject one (null: a fact).

    `candidates` has source_span, raw_value, period_basis, company_known; `names` are (metric, alias) pairs.
    """
    span, raw = F.coalesce("source_span", F.lit("")), clean_value(F.coalesce("raw_value", F.lit("")))
    out = candidates.withColumns({"x_metric": longest_alias(F.lower(span), names), "x_period": tx.period(span), "x_type": tx.value_type(span), "x_raw": raw})
    inside = F.contains(F.regexp_replace(span, rf"{tx.WS}+", ""), F.regexp_replace(F.coalesce("raw_value", F.lit("")), rf"{tx.WS}+", ""))
    reason = (
        F.when(F.col("x_metric").isNull(), "metric").when(F.col("x_period").isNull(), "period").when((F.col("x_period.kind") == "Q2") & (F.coalesce("period_basis", F.lit("")) == ""), "basis")
        .when(~F.col("x_raw").rlike("[0-9一二三四五六七八九十]"), "value").when(~inside, "span").when(~F.coalesce("company_known", F.lit(False)), "company")
    )
    return out.withColumn("reject", reason)


def fact_key(coordinates: list[Column], later: list[Column]) -> Column:
    """Stable id of a fact: a hash of its coordinates; later coordinates count only if any of them is known."""
    text = lambda cs: F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])
    known = reduce(lambda a, b: a | b, [c.isNotNull() for c in later])
    return F.concat(F.lit("F"), F.substring(F.sha1(F.when(known, F.concat_ws("|", text(coordinates), text(later))).otherwise(text(coordinates)).cast("binary")), 1, 12))
