"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A mix has a size: a budget, or the largest one at which the shares miss their targets by SHORTFALL in all, because sources
are at their repetition limit and others stand in for them (found by bisection).  Every source is planned at its target share of it, up to its
limit.  What sources at their limit cannot supply is supplied by the others at tempered shares: their token shares to an
exponent, which is bisected to the entropy that the targets of these others have (its sign says whether small or large
sources are favoured); whoever reaches the limit by this is held at it, and the rest is tempered anew.  So shares come
first, the size is kept, and the exponent decides who stands in for what is missing.  Targets alone cannot be met by an
exponent, since they are one number per source.

A source's plan is then drawn: whole passes over all its documents, and in the last pass whole random blocks while they
fit the budget, then single documents of the one block that straddles it.  Blocks hold a bounded number of documents, so
a source with a third of all documents is never ordered in one task.

Documents of null source or without tokens cannot be drawn; spellings of a source are one after trimming and
lower-casing; a wanted source without documents gets share 0 and is reported; null or negative targets count as 0; a
null repetition limit is 1.  If all sources are at their limit, the mix is smaller than its budget.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents per block: bounds the one ordered piece of each source and pass.
BLOCK_DOCS = 2_000
#: By how much the shares of a mix may miss their targets in all, where no budget is given: what sources at their
#: repetition limit lack, and what others supply for them.
SHORTFALL = 0.02
PLAN = "mix_id string, source string, target_share double, max_repeats int, available bigint, exponent double, tempered_share double, planned_tokens double, passes int, remainder double, blocks int, at_limit boolean"


def _bisect(f, low: float, high: float) -> float:
    """Where the growing function f crosses 0, within [low, high]."""
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _shares(natural: dict[str, float], exponent: float) -> dict[str, float]:
    logs = {s: exponent * math.log(x) for s, x in natural.items()}
    top = max(logs.values())
    total = sum(math.exp(v - top) for v in logs.values())
    return {s: math.exp(v - top) / total for s, v in logs.items()}


def _entropy(p) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def exponent_for(natural: dict[str, float], target: dict[str, float]) -> float:
    """Exponent at which the tempered shares have the target's entropy, on the side the target leans to."""
    mean = sum(math.log(x) for x in natural.values()) / len(natural)
    lean = sum((math.log(natural[s]) - mean) * target[s] for s in natural)
    side, wanted = (1 if lean >= 0 else -1), _entropy(target.values())
    return side * _bisect(lambda t: wanted - _entropy(_shares(natural, side * t).values()), 0.0, 16.0)


def stand_in(planned: dict[str, float], most: dict[str, float], weight: dict[str, float], have: dict[str, int], size: float) -> tuple[float, dict[str, float]]:
    """Fill what `planned` lacks of `size` from sources below their limit, at tempered shares; changes `planned`.

    Returns the exponent and shares of the first filling (0 and none if nothing lacks).  Each further one has a source less.
    """
    first: tuple[float, dict[str, float]] = (0.0, {})
    while (lacks := size - sum(planned.values())) > 1e-6 * size:
        free = [s for s in planned if planned[s] < most[s] * (1 - 1e-9)]
        if not free:
            break
        natural = {s: have[s] / sum(have[x] for x in free) for s in free}
        exponent = exponent_for(natural, {s: weight[s] / sum(weight[x] for x in free) for s in free})
        shares = _shares(natural, exponent)
        first = first if first[1] else (exponent, shares)
        for s in free:
            planned[s] = min(most[s], planned[s] + lacks * shares[s])
    return first


def plan(targets: list[dict], available: dict[str, tuple[int, int]], budget: int | None = None) -> list[tuple]:
    """Tokens, passes and remainder of every wanted source; `available` has (tokens, documents) per source.

    Without a budget, each mix takes the largest one that SHORTFALL allows.
    """
    mixes: dict[str, list[dict]] = defaultdict(list)
    for t in targets:
        if t["mix_id"] is not None and t["source"] is not None:
            mixes[t["mix_id"]].append(t)
    out = []
    for mix, rows in sorted(mixes.items()):
        want = {r["source"]: max(0.0, r["target_share"] or 0.0) for r in rows}
        limit = {r["source"]: max(0, 1 if r["max_repeats"] is None else r["max_repeats"]) for r in rows}
        have = {s: available[s][0] for s in want if available.get(s, (0, 0))[0] > 0}
        total = sum(want[s] for s in have)
        exponent, tempered, planned = 0.0, {}, {}
        if have and total > 0:
            weight = {s: want[s] / total for s in have if want[s] > 0}
            most = {s: float(limit[s] * have[s]) for s in weight}

            def short(size: float, weight=weight, most=most) -> float:
                return 2 * sum(max(0.0, w - most[s] / size) for s, w in weight.items()) - SHORTFALL

            top = sum(most.values())
            size = float(budget) if budget is not None else top if top == 0 or short(top) <= 0 else _bisect(short, 1e-6, top)
            planned = {s: min(w * size, most[s]) for s, w in weight.items()}
            exponent, tempered = stand_in(planned, most, weight, have, size)
        for s in sorted(want):
            tokens, docs = available.get(s, (0, 0))
            use = planned.get(s, 0.0)
            passes = min(limit[s], int(use / tokens + 1e-9)) if tokens else 0
            rest = max(0.0, float(use - passes * tokens)) if passes < limit[s] else 0.0
            at_limit = tokens == 0 or use >= limit[s] * tokens * (1 - 1e-9)
            out.append((mix, s, float(want[s]), limit[s], tokens, exponent, tempered.get(s, 0.0), float(use), passes, rest, max(1, -(-docs // BLOCK_DOCS)), at_limit))
    return out


def draw(sized: DataFrame, targets: DataFrame, cut, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with `times` used per mix, the plan).  `sized` has doc_id, source and tokens.

    Targets and token sums per source are small by nature (one row per wanted source) and go through the driver.
    """
    spark = sized.sparkSession
    docs = sized.select("doc_id", F.lower(F.trim("source")).alias("source"), "tokens").where("source is not null and tokens > 0")
    wanted = targets.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    names = wanted.select("source").distinct()
    sums = docs.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    available = {r["source"]: (r["t"], r["n"]) for r in sums.collect()}
    plans = spark.createDataFrame(plan([r.asDict() for r in wanted.collect()], available, budget), PLAN)
    order = F.xxhash64("mix_id", "source", "passes", "doc_id")
    rows = docs.join(F.broadcast(plans.select("mix_id", "source", "passes", "remainder", "blocks")), "source")
    rows = rows.withColumn("block", F.pmod(order, F.col("blocks")).cast("int"))
    whole = rows.where("remainder > 0").groupBy("mix_id", "source", "block").agg(F.sum("tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("mix_id", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    whole = cut(whole.withColumn("before", F.coalesce(before, F.lit(0))), "mix-blocks")  # one row per block
    rows = rows.join(whole, ["mix_id", "source", "block"], "left")
    left = F.col("remainder") - F.col("before")
    state = F.when(F.col("held").isNull() | (left <= 0), "out").when(F.col("held") <= left, "in").otherwise("edge")
    rows = rows.withColumns({"state": state, "left": left})
    edge = rows.where("state = 'edge'").withColumn("ord", F.xxhash64(F.lit(7), "mix_id", "doc_id"))
    reached = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (reached - F.col("tokens") / 2 <= F.col("left")).cast("int"))
    cols = ["mix_id", "source", "doc_id", "tokens", "passes"]
    extra = F.when(F.col("state") == "in", 1).otherwise(0)
    out = rows.where("state <> 'edge'").select(*cols, extra.alias("extra")).unionByName(edge.select(*cols, "extra"))
    out = out.select("mix_id", "source", "doc_id", "tokens", (F.col("passes") + F.col("extra")).alias("times"))
    return out.where("times > 0"), plans


def report(drawn: DataFrame, plans: DataFrame) -> DataFrame:
    """Target and reached share, tokens and greatest repetition of every wanted source of every mix.

    `mix_tokens` beside `mix_allowed_tokens` shows how much of what the repetition limits allow a mix leaves out.
    """
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    out = plans.join(got, ["mix_id", "source"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    mix = Window.partitionBy("mix_id")
    total = F.sum("reached_tokens").over(mix)
    out = out.withColumn("allowed_tokens", F.when(F.col("target_share") > 0, F.col("max_repeats") * F.col("available")).otherwise(F.lit(0)))
    return out.select(
        "mix_id", "source", "target_share", (F.col("reached_tokens") / total).alias("reached_share"), "reached_tokens", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_times", F.lit(0)).alias("most_times"), "max_repeats", "available", "exponent", "tempered_share", "at_limit",
        "allowed_tokens", total.alias("mix_tokens"), F.sum("allowed_tokens").over(mix).alias("mix_allowed_tokens"),
    )
