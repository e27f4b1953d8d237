"""Typed fact table: validation, insert-or-ignore, filters, period pairing and decimal calculations.

All functions are plain DataFrame plans.  Rows whose key is null are never paired; a missing operand gives a status,
not an error.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units a metric of each dimension may be stored in.
ALLOWED_UNITS = {"currency": ("元",), "percentage": ("%",), "per_share": ("元/股",)}
VALUE_TYPES, KINDS = ("actual", "forecast", "adjusted", "unknown"), ("FY", "Q1", "Q2", "H1", "Q3")
PROVENANCE = ("doc_id", "page", "evidence_id", "raw_value", "source_span")
COORDS = ["company", "metric", "kind"]


def flat(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"kind": F.col("period.kind"), "year": F.col("period.year")}).drop("period")


def missing_provenance(names=PROVENANCE) -> Column:
    """Names of mandatory columns that are null or blank, in order."""
    blank = [F.when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == ""), F.lit(n)) for n in names]
    return F.array_compact(F.array(*blank))


def problems(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """`facts` with the list of rules each row breaks (`problems`, empty where it is valid)."""
    known = metrics.select(F.col("metric").alias("_m"), "dimension").dropDuplicates(["_m"])
    rows = facts.join(known, F.col("metric") == F.col("_m"), "left")
    fits = reduce(lambda a, b: a | b, [(F.col("dimension") == k) & F.col("unit").isin(*v) for k, v in ALLOWED_UNITS.items()])
    rules = {
        "unknown_metric": F.col("dimension").isNull(),
        "bad_unit": F.col("dimension").isNotNull() & ~F.coalesce(fits, F.lit(False)),
        "bad_value_type": ~F.coalesce(F.col("value_type").isin(*VALUE_TYPES), F.lit(False)),
        "bad_period": ~F.coalesce(F.col("kind").isin(*KINDS) & F.col("year").between(1990, 2100), F.lit(False)),
        "no_value": F.col("value").isNull(),
        "bad_page": ~F.coalesce(F.col("page") >= 0, F.lit(False)),
        "no_company": F.coalesce(F.trim("company"), F.lit("")) == "",
        "no_provenance": F.size(missing_provenance()) > 0,
    }
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).drop("_m")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of `incoming` whose `fact_id` is new, one per id (earliest loading, then smallest document)."""
    fresh = incoming.where("fact_id is not null").join(stored.select("fact_id").distinct(), "fact_id", "left_anti")
    carried = [c for c in fresh.columns if c != "fact_id"]
    one = fresh.groupBy("fact_id").agg(F.min_by(F.struct(*carried), F.struct("loaded_at", "doc_id")).alias("r"))
    return one.select("fact_id", "r.*")


def one_per_coordinate(facts: DataFrame) -> DataFrame:
    """Earliest recorded value (then smallest id) of each company, metric, period and value type."""
    key = [*COORDS, "year", "value_type"]
    rows = facts.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    first = F.struct("loaded_at", "fact_id")
    return rows.groupBy(*key).agg(F.min_by("value", first).alias("value"), F.min_by("unit", first).alias("unit"), F.min_by("fact_id", first).alias("fact_id"), F.count("*").alias("n_facts"))


def with_prior(rows: DataFrame, shift: int = 1) -> DataFrame:
    """Each row with the value, unit and id of the same coordinates `shift` years before: an equi-join, no window."""
    key = [*COORDS, "value_type", "year"]
    prior = rows.select(*COORDS, "value_type", (F.col("year") + shift).alias("year"), F.col("value").alias("prior_value"), F.col("unit").alias("prior_unit"), F.col("fact_id").alias("prior_id"))
    return rows.join(prior, key, "left")


def with_metric(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of metric `left` beside those of metric `right` at the same company, period and value type."""
    key = ["company", "kind", "year", "value_type"]
    b = rows.where(F.col("metric") == right).select(*key, F.col("value").alias("right_value"), F.col("unit").alias("right_unit"))
    return rows.where(F.col("metric") == left).select(*key, F.col("value").alias("left_value"), F.col("unit").alias("left_unit")).join(b, key)


def percent(unit: Column) -> Column:
    return F.coalesce(F.trim(unit) == "%", F.lit(False))


def fraction(numerator: Column, denominator: Column) -> Column:
    """Ratio as a double to 6 places; null where the denominator is 0."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def growth(start: Column, end: Column) -> Column:
    return F.round(F.try_divide(end.cast("double") - start.cast("double"), start.cast("double")), 6)


def growth_status(start: Column, start_unit: Column, end_unit: Column) -> Column:
    return F.when(start.isNull(), "MISSING_OPERAND").when(percent(start_unit) != percent(end_unit), "UNIT_MISMATCH").when(start == 0, "DIVIDE_BY_ZERO").otherwise("SUCCESS")


def cagr(start: Column, end: Column, years: Column) -> Column:
    ok = (start > 0) & (end > 0) & (years > 0)
    return F.when(ok, F.round(F.pow(end.cast("double") / start.cast("double"), 1.0 / years) - 1, 6))


def display(value: Column, unit: Column) -> Column:
    """元 amounts from 1e8 as 亿元, from 1e4 as 万元, to two places; other units as they are."""
    v = value.try_cast("decimal(26,6)")

    def shown(scale: str, name: Column | str) -> Column:
        return F.concat(F.round(v * F.lit(scale).cast("decimal(9,8)"), 2).cast("decimal(30,2)").cast("string"), F.lit(name) if isinstance(name, str) else name)

    money = F.when(F.abs(v) >= 10**8, shown("0.00000001", "亿元")).when(F.abs(v) >= 10**4, shown("0.0001", "万元")).otherwise(shown("1", "元"))
    return F.when(F.trim(unit) == "元", money).otherwise(shown("1", F.coalesce(F.trim(unit), F.lit(""))))


def longest_name(spans: DataFrame, key: str, text: str, names: list[tuple[str, str]]) -> DataFrame:
    """`key`, `company`, `alias_length`: the longest of the given (name, alias) pairs that occurs in a text.

    `names` is a fixed table.  Aliases are looked up by their first character at every position, batch by batch.
    """
    schema = f"{key} {dict(spans.dtypes)[key]}, company string, alias_length int"
    first: dict[str, list[tuple[str, str]]] = {}
    for name, alias in sorted(set(names), key=lambda x: (-len(x[1]), x[0])):
        if alias:
            first.setdefault(alias[0], []).append((alias, name))

    def find(batches):
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text], strict=True):
                best = None
                for i, c in enumerate(t):
                    for alias, name in first.get(c, ()):
                        if best is not None and len(alias) < best[0]:
                            break
                        if t.startswith(alias, i) and (best is None or (-len(alias), name) < (-best[0], best[1])):
                            best = (len(alias), name)
                if best is not None:
                    out.append((k, best[1], best[0]))
            if out:
                yield pd.DataFrame(out, columns=[key, "company", "alias_length"])

    return spans.where(F.col(text).isNotNull()).select(key, text).mapInPandas(find, schema)
