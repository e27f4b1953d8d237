"""Evaluation measures as plain aggregates: rates, percentiles, calibration, failure attribution, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(condition: Column, digits: int = 6) -> Column:
    """Share of rows that fulfil a condition; null conditions count as not fulfilled."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), digits)


def exact_sum(c: Column) -> Column:
    """Sum of doubles at six places, the same in any order of rows."""
    return F.round(F.sum(c.cast("decimal(18,6)")), 4).cast("double")


def confusion(rows: DataFrame, score: str, label: Column, thresholds: list[float]) -> DataFrame:
    """Confusion counts and measures of `score >= threshold` for every threshold, in one pass.

    Rows fall into the bucket below which thresholds pass them; cumulative counts over the few buckets do the rest.
    """
    bucket = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    counted = rows.where(F.col(score).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds))]))
    out = counted.select("bucket", "p", "q", each.alias("t")).select("bucket", "p", "q", "t.i", "t.threshold")
    hit = F.col("bucket") >= F.col("i")
    out = out.groupBy("threshold").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("q"))).alias("tn"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.select("threshold", "tp", "fp", "tn", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def calibrate(swept: DataFrame, least_precision: float) -> DataFrame:
    """The feasible threshold of best F1 (the higher one of equals); no row if none is feasible."""
    return swept.where(F.col("precision") >= least_precision).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def micro_macro(rows: DataFrame, category: str, num: str, den: str) -> DataFrame:
    """Summed and averaged ratios, per category and overall (null category)."""
    ratio = F.try_divide(F.col(num), F.col(den))
    out = rows.withColumn("_r", ratio).rollup(category).agg(F.sum(num).alias("numerator"), F.sum(den).alias("denominator"), F.avg("_r").alias("macro"), F.grouping(category).alias("overall"))
    return out.select(category, "overall", "numerator", "denominator", F.round(F.try_divide(F.col("numerator"), F.col("denominator")), 6).alias("micro"), F.round("macro", 6).alias("macro"))


def attribution(events: DataFrame, run: str, order: list[str], failed: Column, cost: str) -> DataFrame:
    """First, root and last failure of each run, whether it recovered, and what had been spent before the first one.

    The root is the first failure of the last unbroken streak of failures; a success after it means recovery.
    """
    w = Window.partitionBy(run).orderBy(*order)
    rows = events.withColumn("_f", failed).withColumn("_step", F.row_number().over(w))
    rows = rows.withColumn("_new", F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)))
    first = F.min(F.when(F.col("_f"), F.col("_step"))).over(Window.partitionBy(run))
    rows = rows.withColumn("_first", first)
    out = rows.groupBy(run).agg(
        F.count("*").alias("n_steps"), F.count_if("_f").alias("n_failures"), F.first("_first").alias("first_failure"), F.max(F.when(F.col("_new"), F.col("_step"))).alias("root_failure"),
        F.max(F.when(F.col("_f"), F.col("_step"))).alias("last_failure"), exact_sum(F.when(F.col("_step") < F.col("_first"), F.col(cost))).alias("cost_before"),
    )
    return out.withColumn("recovered", (F.col("last_failure") < F.col("n_steps")).cast("int"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free fingerprint: half of each row's hash, added up in 4 lanes of 32 bits.

    Nothing is collected: sums of hashes combine before the shuffle.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digest = F.sha2(text, 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.agg(F.count("*").alias("n"), *[x.cast("string").alias(f"lane_{i}") for i, x in enumerate(lanes)])


#: Pieces a range of values is cut into on each pass over the data.
PIECES = 1024


def percentiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear between neighbours) of each group, without a group's values ever being gathered.

    Two passes of counting cut each group's range into PIECES x PIECES; only the values of the few pieces that hold a
    wanted rank are ordered, value by value with their counts.  `group` names a column at least (a constant one for all
    rows); its values are not null.  Null values do not count; a group without any has nulls.
    """
    own = rows.groupBy(*group).agg(F.count(value).alias("_n"))
    rows = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    bounds = rows.groupBy(*group).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    cells = rows.join(bounds, group)
    first = F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * PIECES), F.lit(PIECES - 1))
    cells = cells.withColumn("_a", F.coalesce(first, F.lit(0)).cast("int"))
    width = (F.col("_high") - F.col("_low")) / PIECES
    second = F.least(F.greatest(F.floor((F.col("_v") - F.col("_low") - F.col("_a") * width) / F.nullif(width, F.lit(0.0)) * PIECES), F.lit(0)), F.lit(PIECES - 1))
    cells = cells.withColumn("_b", F.coalesce(second, F.lit(0)).cast("int"))
    counted = cells.groupBy(*group, "_a", "_b").agg(F.count("*").alias("_c"))
    by_a = counted.groupBy(*group, "_a").agg(F.sum("_c").alias("_ca"))  # at most PIECES rows a group
    w = Window.partitionBy(*group).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    by_a = by_a.withColumn("_before_a", F.coalesce(F.sum("_ca").over(w), F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in at.items()])).alias("w")
    asked = own.select(*group, "_n", each).select(*group, "_n", F.col("w.name").alias("_name"), (F.col("w.q") * (F.col("_n") - 1)).alias("_r"))
    asked = asked.select(*group, "_name", "_r", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))).alias("_k")).where("_k >= 0")
    inside = lambda before, n: (F.col("_k") >= F.col(before)) & (F.col("_k") < F.col(before) + F.col(n))
    hit = asked.join(by_a, group).where(inside("_before_a", "_ca"))
    in_a = hit.join(counted, [*group, "_a"])  # at most PIECES rows a wanted rank
    w = Window.partitionBy(*group, "_name", "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    in_a = in_a.withColumn("_before", F.col("_before_a") + F.coalesce(F.sum("_c").over(w), F.lit(0))).where(inside("_before", "_c"))
    values = cells.join(in_a.select(*group, "_a", "_b").distinct(), [*group, "_a", "_b"], "left_semi").groupBy(*group, "_a", "_b", "_v").agg(F.count("*").alias("_cv"))
    w = Window.partitionBy(*group, "_name", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = in_a.join(values, [*group, "_a", "_b"]).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_cv").over(w), F.lit(0))).where(inside("_at", "_cv"))
    both = found.groupBy(*group, "_name", "_r").agg(F.min_by("_v", "_k").alias("_x"), F.max_by("_v", "_k").alias("_y"))
    both = both.withColumn("_p", F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_r") - F.floor("_r")))
    out = both.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == n, F.col("_p"))).alias(n) for n in at])
    return own.select(*group).join(out, group, "left")


def ranked_at(rows: DataFrame, group: str, order: str, wanted: DataFrame) -> DataFrame:
    """Rows at given ordinals (from 0) of each group by `order`; `wanted` has the group and `i`.

    Counts per piece of the range of `order` come first, so that only pieces that hold a wanted ordinal are numbered.
    """
    bounds = rows.agg(F.min(order).alias("_low"), F.max(order).alias("_high")).first()  # two numbers
    low, high = bounds["_low"] or 0, bounds["_high"] or 0
    piece = F.floor((F.col(order) - F.lit(low)) / F.lit(max(1.0, (high - low + 1) / PIECES))).cast("int")
    rows = rows.withColumn("_piece", piece)
    counts = rows.groupBy(group, "_piece").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    hit = wanted.join(counts, group).where((F.col("i") >= F.col("_before")) & (F.col("i") < F.col("_before") + F.col("_c")))
    near = rows.join(hit.select(group, "_piece", "_before").distinct(), [group, "_piece"])
    near = near.withColumn("i", F.col("_before") + F.row_number().over(Window.partitionBy(group, "_piece").orderBy(order)) - 1)
    return near.drop("_piece", "_before").join(wanted, [group, "i"])
