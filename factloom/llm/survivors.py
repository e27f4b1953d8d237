"""Best representative of each duplicate group: Bayesian fusion with copy detection.

A group holds the records of one observation.  The data do not name who wrote a record; its writing conventions stand
for that: kind of evidence key, period basis and style of the printed value make at most SOURCES classes.
Sources vote for every value a group states: date, status, kind, scope and quantity.  Accuracies of the sources and
their mutual dependence are estimated over all groups, from agreement and from shared false values, until they are
stable; votes of likely copiers are discounted.  The posterior of a value is its prior plus its discounted votes: for
status, kind and scope the prior is LEVEL a level of trust, for the date LEVEL a year.  Each field takes its value of
highest posterior (`fused_...`), and the survivor is the record whose four fields and quantity have the highest sum.
A record that is best in all four fields has the last word, whatever the votes; that is the exact check (`sure`).

Pairs of records are never formed: votes are bit sets of sources, united per group and value before the shuffle, and
dependence comes from products of one-hot matrices whose side is SOURCES.  A group of any size is reduced by partial
aggregates.  Redelivered records count once, at their earliest loading.  Records whose document, metric or period is
null, or whose company no row of `companies` names, are in no group; a null, blank or unlisted trust value and a null
or later-than-loading date rank lowest; equal records are settled by the smallest `fact_id`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.form import form
from factloom.operators import units
from factloom.session import materialize

FIELDS = ("revision_status", "value_type", "accounting_scope")
GROUP = ["g1", "g2"]
#: Classes of sources (bits of one word), and log odds of a level of trust or a year of date.
SOURCES, LEVEL = 64, 3.0
#: Styles a value may be printed in, the first that fits; then the plain one.
STYLES, BASES = ("[亿億]", "[万萬]", "[A-Za-z]", "%"), ("standalone", "cumulative")
#: Copying model: prior of dependence, share copied, number of false values; most rounds, and the change that ends them.
ALPHA, COPIED, FALSE_VALUES, ROUNDS, STABLE = 0.1, 0.8, 20, 4, 0.01
#: Fields with values of their own in `votes`.
DAY, QUANTITY = 0, 1


def _listed(trust: DataFrame) -> dict[str, dict[str, tuple[int, int]]]:
    """Trust and a number from 1 for each listed value of each field; the table is fixed and holds a few rows."""
    out: dict[str, dict[str, tuple[int, int]]] = {f: {} for f in FIELDS}
    for r in sorted(trust.where(F.col("field_value").isNotNull()).collect()):
        value = r["field_value"].strip().lower()
        if r["field_name"] in out and value:
            known = out[r["field_name"]].get(value, (-1, len(out[r["field_name"]]) + 1))
            out[r["field_name"]][value] = (max(known[0], r["trust"]), known[1])
    return out


def source() -> Column:
    """Class of a record's source, from its writing conventions: 3 kinds of evidence key, 4 bases, 5 styles."""
    basis = F.coalesce(F.lower(F.trim("period_basis")), F.lit(""))
    key = F.when(F.col("evidence_id").isNull(), 0).when(F.col("evidence_id").startswith("EV"), 1).otherwise(2)
    base = F.when(basis == "", 0).when(basis == BASES[0], 1).when(basis == BASES[1], 2).otherwise(3)
    style = F.lit(len(STYLES))
    for i, p in reversed(list(enumerate(STYLES))):
        style = F.when(F.col("raw_value").rlike(p), i).otherwise(style)
    return ((key * 4 + base) * 5 + style).cast("int")


def records(facts: DataFrame, companies: DataFrame, listed: dict) -> DataFrame:
    """One row per grouped record: hashed group, number and trust of each field's value, usable date, bits of its source."""
    names = companies.select("company_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("_name"))
    names = names.where(F.col("_name").isNotNull()).groupBy("_name").agg(F.min("company_id").alias("_cid"))
    rows = facts.withColumn("_name", F.trim(form(F.col("company")))).join(names, "_name")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("metric").isNotNull() & F.col("period").isNotNull())
    key = [F.col("doc_id"), F.col("_cid"), F.col("metric"), F.col("period.kind"), F.col("period.year")]
    made = []
    for f, values in listed.items():
        said, number, level = F.coalesce(F.lower(F.trim(f)), F.lit("")), F.lit(0), F.lit(-1)
        for v, (t, k) in values.items():
            number, level = F.when(said == v, k).otherwise(number), F.when(said == v, t).otherwise(level)
        made += [number.cast("int").alias(f"n_{f}"), level.cast("int").alias(f"t_{f}")]
    rows = rows.select(
        F.xxhash64(*key).alias("g1"), F.xxhash64(F.lit(31), *key).alias("g2"), "fact_id", "loaded_at", "source_date", "metric", "value", "raw_value", "unit",
        *made, source().alias("source"),
    )
    carried = ["source_date", "metric", "value", "raw_value", "unit", *[f"{x}_{f}" for f in FIELDS for x in "nt"], "source"]
    rows = rows.groupBy(*GROUP, "fact_id").agg(F.min("loaded_at").alias("loaded_at"), F.max(F.struct(*carried)).alias("_r")).select(*GROUP, "fact_id", "loaded_at", "_r.*")
    usable = F.when(F.col("source_date") <= F.to_date("loaded_at"), F.col("source_date"))
    return rows.withColumns({"day": F.coalesce(F.datediff(usable, F.lit("1900-01-01").cast("date")), F.lit(-1)), "by": F.expr("shiftleft(1L, source)")}).drop("loaded_at", "source_date", "source")


def _cells(listed: dict) -> list[tuple[str, int]]:
    """Every value (field, number) a trust field can take; number 0 stands for null, blank and unlisted ones."""
    return [(f, k) for f, values in listed.items() for k in range(len(values) + 1)]


def groups(rows: DataFrame, listed: dict) -> DataFrame:
    """Groups of at least two records: size, best of each field, and the sources behind every value of the trust fields."""
    cells = [F.coalesce(F.bit_or(F.when(F.col(f"n_{f}") == k, F.col("by"))), F.lit(0)).cast("bigint").alias(f"by_{f}_{k}") for f, k in _cells(listed)]
    best = [F.max("day").alias("best_day"), *[F.max(f"t_{f}").alias(f"best_t_{f}") for f in FIELDS]]
    return rows.groupBy(*GROUP).agg(F.count("*").alias("n_records"), F.min("fact_id").alias("group_id"), F.bit_or("by").alias("said"), *best, *cells).where("n_records > 1")


@dataclass
class Model:
    """Estimates per source (a bounded set): accuracy, and the probability that one copies from the other."""

    accuracy: np.ndarray
    dependence: np.ndarray

    def mass(self, by: np.ndarray) -> np.ndarray:
        """Vote mass of each set of sources, every source discounted by what it may have copied from better ones."""
        sets, place = np.unique(by, return_inverse=True)
        weight = np.log(FALSE_VALUES * self.accuracy / (1 - self.accuracy))
        order = np.lexsort((np.arange(len(weight)), -weight))
        kept = np.triu(np.log(1 - COPIED * self.dependence[np.ix_(order, order)]), 1)
        hot = one_hot(sets)[:, order]
        return (hot * weight[order] * np.exp(hot @ kept)).sum(axis=1)[place]


def one_hot(by: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(by, dtype=np.int64)[:, None]
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def _products(rows: DataFrame, masks: list[str]) -> np.ndarray:
    """For each column of source sets, how often every two sources stand together, from one-hot products per batch."""
    n = SOURCES

    def partial(batches):
        total = np.zeros((len(masks), n, n), dtype=np.float64)
        for b in batches:
            for k, m in enumerate(masks):
                by = b[m].to_numpy()
                hot = one_hot(by[by != 0])
                total[k] += hot.T @ hot
        k, i, j = np.nonzero(total)
        yield pd.DataFrame({"k": k, "i": i, "j": j, "x": total[k, i, j]})

    sums = rows.select(*masks).mapInPandas(partial, "k int, i int, j int, x double").groupBy("k", "i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((len(masks), n, n))
    rows = sums.toPandas()  # at most SOURCES**2 numbers a column, whatever the data
    out[rows.k, rows.i, rows.j] = rows.x
    return out


def _dependence(accuracy: np.ndarray, true: np.ndarray, false: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Posterior that two sources depend on each other, from shared true, shared false and differing votes."""
    a, b = accuracy[:, None], accuracy[None, :]
    pt, pf = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    pd_ = np.clip(1 - pt - pf, 1e-9, 1)
    mean = (a + b) / 2
    differ = np.clip(both - true - false, 0, None)
    alone = true * np.log(pt) + false * np.log(pf) + differ * np.log(pd_)
    copied = true * np.log(mean * COPIED + pt * (1 - COPIED)) + false * np.log((1 - mean) * COPIED + pf * (1 - COPIED)) + differ * np.log(pd_ * (1 - COPIED))
    out = 1 / (1 + np.exp(np.clip(alone - copied + np.log((1 - ALPHA) / ALPHA), -60, 60)))
    np.fill_diagonal(out, 0)
    return out


def _mass(model: Model):
    @F.pandas_udf(T.DoubleType())
    def mass(by: pd.Series) -> pd.Series:
        return pd.Series(model.mass(by.to_numpy()))

    return mass


def with_quantity(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """`rows` with the stated quantity in common units (the stored value where none can be read) and `v`, its hash."""
    q = units.convert(rows, metrics)
    stated, stored = F.col("quantity"), F.col("value").try_cast("decimal(38,12)")
    # a stored value too long for the common column is hashed as it is
    v = F.when(stated.isNotNull(), F.xxhash64(stated)).when(stored.isNotNull(), F.xxhash64(stored)).otherwise(F.xxhash64(F.lit(1), F.col("value")))
    return q.select(*[c for c in rows.columns if c not in ("raw_value", "unit", "value", "metric")], v.alias("v"), F.coalesce(stated.cast("string"), stored.cast("string"), F.col("value").cast("string")).alias("stated"))


def votes_of(rows: DataFrame) -> DataFrame:
    """Per group and value of date and quantity: who states it, and its prior."""
    of = lambda field, value, prior, shown: F.struct(F.lit(field).alias("field"), value.cast("bigint").alias("value"), prior.cast("double").alias("prior"), shown.alias("shown"))
    day = of(DAY, F.col("day"), F.col("day") * (LEVEL / 365.0), F.lit(None).cast("string"))
    each = rows.select(*GROUP, "by", F.explode(F.array(day, of(QUANTITY, F.col("v"), F.lit(0.0), F.col("stated")))).alias("e")).select(*GROUP, "by", "e.*")
    return each.groupBy(*GROUP, "field", "value").agg(F.bit_or("by").alias("by"), F.max("prior").alias("prior"), F.min("shown").alias("shown"), F.count("*").alias("n"))


def estimate(votes: DataFrame, grouped: DataFrame) -> Model:
    """Accuracy and dependence of the sources, alternated with the truth they imply until they are stable."""
    model = Model(np.full(SOURCES, 0.8), np.zeros((SOURCES, SOURCES)))
    both = 2 * _products(grouped, ["said"])[0]  # every record states both a date and a quantity
    best = F.max(F.struct("post", "n", "value")).over(Window.partitionBy(*GROUP, "field"))["value"]
    zero = F.lit(0).cast("bigint")
    for _ in range(ROUNDS):
        scored = votes.select(*GROUP, "field", "value", "by", "n", (F.col("prior") + _mass(model)("by")).alias("post")).withColumn("right", F.col("value") == best)
        true, false = _products(scored.select(F.when(F.col("right"), F.col("by")).otherwise(zero).alias("true"), F.when(F.col("right"), zero).otherwise(F.col("by")).alias("false")), ["true", "false"])
        right, wrong = np.diag(true), np.diag(false)
        accuracy = np.clip((right + 8) / (right + wrong + 10), 0.05, 0.99)
        moved = np.abs(accuracy - model.accuracy).max()
        model = Model(accuracy, _dependence(accuracy, true, false, both))
        if moved < STABLE:
            break
    return model


def choose(rows: DataFrame, grouped: DataFrame, votes: DataFrame, model: Model, listed: dict) -> DataFrame:
    """One survivor per group with its score, the fused value of each field, and `sure`.

    `sure` is the exact check: the survivor is nowhere worse than any other record and somewhere better than each.
    """
    mass, number = _mass(model), {f: len(v) + 1 for f, v in listed.items()}
    at, level = {}, {f: {k: t for t, k in [(-1, 0), *v.values()]} for f, v in listed.items()}
    posts = {}
    for f, k in _cells(listed):
        at[f, k] = F.when(F.col(f"by_{f}_{k}") != 0, mass(F.col(f"by_{f}_{k}")) + LEVEL * level[f][k])
    for f in FIELDS:
        posts[f"p_{f}"] = F.array(*[at[f, k] for k in range(number[f])])
    kept = ["n_records", "group_id", "best_day", *[f"best_t_{f}" for f in FIELDS]]
    sides = grouped.select(*GROUP, *kept, *[c.alias(n) for n, c in posts.items()])
    trust = [f"t_{f}" for f in FIELDS]
    shapes = rows.groupBy(*GROUP, "v", "day", *[f"n_{f}" for f in FIELDS], *trust).agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("n"))
    post = votes.withColumn("post", F.col("prior") + mass("by")).select(*GROUP, "field", "value", "post", "n", "shown")
    post = materialize(post, "posteriors")
    for field, column in ((DAY, "day"), (QUANTITY, "v")):
        shapes = shapes.join(post.where(F.col("field") == field).select(*GROUP, F.col("value").alias(column), F.col("post").alias(f"post_{column}")), [*GROUP, column])
    shapes = shapes.join(sides, GROUP)
    score = reduce(lambda a, b: a + b, [F.element_at(f"p_{f}", F.col(f"n_{f}") + 1) for f in FIELDS], F.col("post_day") + F.col("post_v"))
    top = reduce(lambda a, b: a & b, [F.col(t) == F.col(f"best_{t}") for t in trust], F.col("day") == F.col("best_day"))
    shapes = shapes.withColumns({"score": F.round(score, 6), "top": top})
    first = F.min_by(F.struct("fact_id", "score"), F.struct(~F.col("top"), -F.col("score"), F.col("fact_id")))
    fused = [F.first(F.array_position(f"p_{f}", F.array_max(f"p_{f}")) - 1).alias(f"k_{f}") for f in FIELDS]
    out = shapes.groupBy(*GROUP).agg(F.first("group_id").alias("group_id"), F.first("n_records").alias("n_records"), first.alias("s"), F.sum(F.when(F.col("top"), F.col("n"))).alias("n_top"), *fused)
    said = post.groupBy(*GROUP).agg(F.max(F.when(F.col("field") == DAY, F.struct("post", "value")))["value"].alias("day"), F.max(F.when(F.col("field") == QUANTITY, F.struct("post", "n", "shown")))["shown"].alias("fused_quantity"))
    out = out.join(said, GROUP)

    def spelt(f: str) -> Column:
        words = {k: v for v, (_, k) in listed[f].items()}
        return F.get(F.array(F.lit(None).cast("string"), *[F.lit(words[k]) for k in sorted(words)]), F.col(f"k_{f}").cast("int")).alias(f"fused_{f}")

    date = F.when(F.col("day") >= 0, F.date_add(F.lit("1900-01-01").cast("date"), F.col("day").cast("int")))
    return out.select("group_id", "s.fact_id", "n_records", "s.score", date.alias("fused_source_date"), *[spelt(f) for f in FIELDS], "fused_quantity", F.coalesce(F.col("n_top") == 1, F.lit(False)).alias("sure"))


def survivors(facts: DataFrame, companies: DataFrame, trust: DataFrame, metrics: DataFrame) -> DataFrame:
    """The surviving record of every group of at least two records, and the fused values of its fields."""
    listed = _listed(trust)
    rows = materialize(records(facts, companies, listed), "records")
    several = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1").select(*GROUP)
    rows = materialize(with_quantity(rows.join(several, GROUP, "left_semi"), metrics), "repeated")
    grouped = materialize(groups(rows, listed), "groups")
    votes = materialize(votes_of(rows), "votes")
    return choose(rows, grouped, votes, estimate(votes, grouped), listed)
