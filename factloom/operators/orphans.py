"""References to records that do not exist, tracked as keyed state over time.

State is two tables: `moments` (by how much the number of live parent rows of a key changes at a moment) and `refs`
(every distinct reference at its earliest time, with its verdict at birth and whether it is open now).  `advance` folds
one batch of parent events and references in.  Only the keys that the batch touches are looked at: new references probe
the moments of their key, arriving parents resolve waiting orphans, deletions reopen them, and events or references
that come late re-judge what is known of their key.  Any cut of the history into batches, in any order, with any
redelivery of references, ends in the same state.

Keys travel as two 64-bit hashes, of target and key.  A key's references and events meet in one shuffle, where repeated
references fall together and the key is swept in the order of time.  Keys with more than HOT rows are split: equal
moments become one row first, the net change per hour gives what is alive as each hour begins, every key-hour is swept
on its own, and references read the verdict of their moment.  Nothing is collected and no rows of a key are paired.

Nulls: references without a letter or digit refer to nothing and are dropped; parents without key or `loaded_at`
are dropped; a reference without time (`born`) is dropped, since it cannot be judged.  Ties: an arrival at the very
moment of the reference counts as present, a deletion at that moment as gone.  Empty tables give empty states.  A parent
event counts as often as it is given: batches of parent rows must not overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.form import blank, match_key
from factloom.session import materialize

REF = ["src_table", "src_key", "ref_field", "ref_key"]
KEY = ["k1", "k2"]
REF_COLS = [*REF, *KEY, "born"]
REF_SCHEMA = "src_table string, src_key string, ref_field string, ref_key string, k1 bigint, k2 bigint, born timestamp, dead_at_birth boolean, open boolean"
#: References and events from which a key is split; there are at most rows / HOT such keys.
HOT = 500_000
MOMENT_SCHEMA = "k1 bigint, k2 bigint, ts timestamp, delta bigint"


@dataclass
class OrphanState:
    moments: DataFrame
    refs: DataFrame
    first: bool = False

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(spark.createDataFrame([], MOMENT_SCHEMA), spark.createDataFrame([], REF_SCHEMA), True)

    def save(self, name: str) -> OrphanState:
        """Write both tables to the shared folder, so that the next batch starts from files."""
        return OrphanState(materialize(self.moments, name + "-moments"), materialize(self.refs, name + "-refs"))


def _hashed(*parts) -> list:
    """Two independent 64-bit hashes of some columns."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(17), *parts)]


def references(df: DataFrame, src_table: str, key: str, field: str, target: str) -> DataFrame:
    """The references of `df.field` (a string or an array of strings) with their keys; `advance` makes them distinct."""
    value = F.explode(field) if dict(df.dtypes)[field].startswith("array") else F.col(field)
    refs = df.select(F.col(key).alias("src_key"), value.alias("ref_key"), F.col("loaded_at").alias("born"))
    refs = refs.where(~blank(F.col("ref_key")) & F.col("born").isNotNull())
    refs = refs.withColumns({"src_table": F.lit(src_table), "ref_field": F.lit(f"{src_table}.{field}"), "_k": match_key(F.col("ref_key"))})
    k1, k2 = _hashed(F.lit(target), "_k")
    return refs.select(*REF, k1.alias("k1"), k2.alias("k2"), "born")


def parent_events(df: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Arrivals (+1) and deletions (-1) of the rows of `df` under each key column, for the targets it serves.

    Rows deleted before they came never lived.
    """
    out = None
    for key, targets in keys.items():
        rows = df.select(F.col(key).alias("key"), "loaded_at", "deleted_at").where(~blank(F.col("key")) & F.col("loaded_at").isNotNull())
        rows = rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))).withColumn("_k", match_key(F.col("key")))
        moves = []
        for t in targets:
            k1, k2 = _hashed(F.lit(t), "_k")
            moves += [F.struct(k1.alias("k1"), k2.alias("k2"), F.col(at).alias("ts"), F.lit(n).cast("bigint").alias("delta")) for at, n in (("loaded_at", 1), ("deleted_at", -1))]
        one = rows.select(F.explode(F.array(*moves)).alias("e")).select("e.*").where(F.col("ts").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def judge(refs: DataFrame, moments: DataFrame) -> DataFrame:
    """Distinct `refs` at their earliest time, with `dead` (no parent row of the key lives then) and `open` (none at the end)."""
    rows = refs.select(*KEY).unionByName(moments.select(*KEY)).groupBy(*KEY).agg(F.count("*").alias("n"))
    hot = F.broadcast(materialize(rows.where(F.col("n") > HOT).select(*KEY), "hot-keys"))  # at most rows / HOT keys
    cold = _sweep_keys(refs.join(hot, KEY, "left_anti"), moments.join(hot, KEY, "left_anti"))
    return cold.unionByName(_sweep_hours(refs.join(hot, KEY, "left_semi"), moments.join(hot, KEY, "left_semi")))


def _sweep_keys(refs: DataFrame, moments: DataFrame) -> DataFrame:
    """One shuffle by key: references made distinct, moments added up, and the number alive run over them."""
    none = [F.lit(None).cast("string").alias(c) for c in REF]
    rows = moments.select(*KEY, F.col("ts").alias("at"), *none, "ts", "delta").unionByName(refs.select(*KEY, F.lit(None).cast("timestamp").alias("at"), *REF, F.col("born").alias("ts"), F.lit(0).cast("bigint").alias("delta")))
    rows = rows.repartition(*KEY).groupBy(*KEY, "at", *REF).agg(F.min("ts").alias("ts"), F.sum("delta").alias("delta"))
    order = Window.partitionBy(*KEY).orderBy("ts", F.col("at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"alive": F.sum("delta").over(order), "in_all": F.sum("delta").over(Window.partitionBy(*KEY))}).where("at is null")
    return rows.select(*REF, *KEY, F.col("ts").alias("born"), (F.col("alive") <= 0).alias("dead"), (F.col("in_all") <= 0).alias("open"))


def _sweep_hours(refs: DataFrame, moments: DataFrame) -> DataFrame:
    """Keys split by hour; references read the verdict of their moment by an equi-join."""
    refs = refs.groupBy(*REF, *KEY).agg(F.min("born").alias("born"))
    marks = moments.select(*KEY, "ts", "delta", F.lit(False).alias("asked")).unionByName(refs.select(*KEY, F.col("born").alias("ts"), F.lit(0).cast("bigint").alias("delta"), F.lit(True).alias("asked")))
    marks = marks.groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked")).withColumn("hour", F.date_trunc("hour", "ts"))
    hours = marks.groupBy(*KEY, "hour").agg(F.sum("delta").alias("delta"), F.bool_or("asked").alias("asked"))
    each, whole = Window.partitionBy(*KEY).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*KEY)
    start = hours.select(*KEY, "hour", F.coalesce(F.sum("delta").over(each), F.lit(0)).cast("bigint").alias("delta"), F.sum("delta").over(whole).alias("in_all"), "asked").where("asked")
    start = start.select(*KEY, "hour", F.lit(None).cast("timestamp").alias("ts"), "delta", "in_all", F.lit(False).alias("asked"))
    rows = start.unionByName(marks.withColumn("in_all", F.lit(None).cast("bigint")))
    sweep = Window.partitionBy(*KEY, "hour").orderBy(F.col("ts").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"alive": F.sum("delta").over(sweep), "in_all": F.first("in_all").over(sweep)}).where("asked")
    verdicts = rows.select(*KEY, F.col("ts").alias("born"), (F.col("alive") <= 0).alias("dead"), (F.col("in_all") <= 0).alias("open"))
    return refs.join(verdicts, [*KEY, "born"]).select(*REF_COLS, "dead", "open")


def advance(state: OrphanState, refs: DataFrame, events: DataFrame) -> tuple[OrphanState, DataFrame]:
    """Fold one batch in; returns the new state and the transitions (resolved, reopened, rejudged) of known references."""
    if state.first:
        new, moments = refs.select(*REF_COLS), events
    else:
        touched = materialize(refs.select(*KEY).unionByName(events.select(*KEY)).distinct(), "touched")
        new = refs.select(*REF_COLS).unionByName(state.refs.join(touched, KEY, "left_semi").select(*REF_COLS))
        moments = events.unionByName(state.moments.join(touched, KEY, "left_semi"))
    judged = judge(new, moments).withColumnRenamed("dead", "dead_at_birth").select(*REF_COLS, "dead_at_birth", "open")
    if state.first:
        none = judged.where(F.lit(False)).select(*REF_COLS, F.lit(None).cast("string").alias("transition"))
        return OrphanState(events.groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta")), judged), none
    judged = materialize(judged, "judged")
    known = state.refs.join(touched, KEY, "left_semi").select(*REF, F.col("open").alias("was_open"), F.col("dead_at_birth").alias("was_dead"))
    how = F.when(F.col("was_open") & ~F.col("open"), "resolved").when(~F.col("was_open") & F.col("open"), "reopened").when(F.col("was_dead") != F.col("dead_at_birth"), "rejudged")
    moved = judged.join(known, REF).withColumn("transition", how).where("transition is not null").select(*REF_COLS, "transition")
    kept = state.moments.unionByName(events).groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta"))
    return OrphanState(kept, state.refs.join(touched, KEY, "left_anti").unionByName(judged)), moved


def snapshot(state: OrphanState) -> DataFrame:
    """Counts per table, field and month of loading: references, dead when they came, open now."""
    month = F.date_format("born", "yyyy-MM").alias("month")
    return state.refs.groupBy("src_table", "ref_field", month).agg(
        F.count("*").alias("n_refs"),
        F.sum(F.col("dead_at_birth").cast("bigint")).alias("n_dead"),
        F.sum(F.col("open").cast("bigint")).alias("n_open"),
    )
