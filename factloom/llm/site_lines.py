"""Lines repeated across one site's documents, kept as incremental per-source counts.

State: `postings` (which document of which source holds which line, hashed), `counts` (documents per source and line),
`docs` (documents of each source) and `sizes` (how many).  `merge` adds only what the state lacks and reports the lines
that crossed the threshold in either direction: candidates are lines with a new posting and lines of sources that grew.
`affected` names the documents to rebuild, `rebuild` makes their texts anew and leaves all others as they were.

A line's key is its project's form without blanks and digits, hashed to 128 bits.  A source is (site, kind); nulls in
either are one source of their own.  Null texts have no lines; an empty text has one empty line; lines of equal key
count once per document, so repeated rows and redeliveries change nothing.  All aggregates combine before the shuffle
and no source's lines are ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.form import form
from factloom.session import materialize

LINE = ["src", "h1", "h2"]
MIN_DOCS, MIN_SHARE = 5, 0.1
# In the project's form blanks and digits are ordinary ones.
BLANKS_DIGITS = r"[\s0-9]+"
#: The excessive lines are broadcast only below this number (about 40 bytes each); beyond it Spark joins by shuffle.
BROADCAST_LINES = 500_000


def publisher(file_name: Column) -> Column:
    """What stands between the third `_` and the `：` of a file name; null where it has no such part."""
    return F.nullif(F.regexp_extract(file_name, r"^[^_]*_[^_]*_[^_]*_([^：]*)：", 1), F.lit(""))


def lines(df: DataFrame, source: Column, doc: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """One row per line: hashed source, document and key; `line_no` from 1 and the `keep` columns if asked for."""
    keep = keep or []
    rows = df.select(F.xxhash64(source).alias("src"), F.xxhash64(F.col(doc)).alias("doc"), *keep, F.split(form(F.col(text)), "\n").alias("_l"))
    if keep:
        rows = rows.select("src", "doc", *keep, F.posexplode("_l").alias("_p", "_line")).withColumn("line_no", F.col("_p") + 1)
    else:
        rows = rows.select("src", "doc", F.explode("_l").alias("_line"))
    key = F.regexp_replace("_line", BLANKS_DIGITS, "")
    rows = rows.withColumn("_k", key).withColumns({"h1": F.xxhash64("_k"), "h2": F.xxhash64(F.lit(29), "_k")})
    return rows.select(*LINE, "doc", *keep, *(["line_no"] if keep else []))


@dataclass
class LineState:
    postings: DataFrame
    counts: DataFrame
    docs: DataFrame
    sizes: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> LineState:
        key = "src bigint, h1 bigint, h2 bigint"
        return LineState(*(spark.createDataFrame([], x) for x in (key + ", doc bigint", key + ", n bigint", "src bigint, doc bigint", "src bigint, docs bigint")))

    def save(self, name: str) -> LineState:
        return LineState(*(materialize(t, f"{name}-{k}") for k, t in (("postings", self.postings), ("counts", self.counts), ("docs", self.docs), ("sizes", self.sizes))))

    def excessive(self) -> DataFrame:
        """Lines in at least MIN_DOCS documents of their source and in at least MIN_SHARE of them."""
        return _excessive(self.counts, self.sizes)


def _excessive(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    share = F.lit(str(MIN_SHARE)).cast("decimal(10,9)")  # exact: a tenth is a tenth
    return counts.where(F.col("n") >= MIN_DOCS).join(sizes, "src").where(F.col("n") >= F.col("docs") * share).select(*LINE, "n", "docs")


def build(rows: DataFrame, docs: DataFrame) -> LineState:
    """The state of a first load: no earlier postings to compare with.  `docs` are the documents of `source_docs`."""
    postings = rows.select(*LINE, "doc").distinct()
    return LineState(postings, postings.groupBy(*LINE).agg(F.count("*").alias("n")), docs, docs.groupBy("src").agg(F.count("*").alias("docs")))


def source_docs(df: DataFrame, source: Column, doc: str) -> DataFrame:
    return df.select(F.xxhash64(source).alias("src"), F.xxhash64(F.col(doc)).alias("doc")).distinct()


def _added(old: DataFrame, fresh: DataFrame, key: list[str], n: str) -> DataFrame:
    return old.unionByName(fresh).groupBy(*key).agg(F.sum(n).alias(n))


def merge(state: LineState, rows: DataFrame, docs: DataFrame) -> tuple[LineState, DataFrame]:
    """Fold a partition's lines and documents in; only what the state lacks counts.

    Also returns the lines whose standing changed (`now` true: newly excessive).
    """
    fresh = rows.select(*LINE, "doc").distinct().join(state.postings, [*LINE, "doc"], "left_anti")
    fresh_docs = docs.select("src", "doc").distinct().join(state.docs, ["src", "doc"], "left_anti")
    delta, grown = fresh.groupBy(*LINE).agg(F.count("*").alias("n")), fresh_docs.groupBy("src").agg(F.count("*").alias("docs"))
    counts, sizes = _added(state.counts, delta, LINE, "n"), _added(state.sizes, grown, ["src"], "docs")
    new = LineState(state.postings.unionByName(fresh), counts, state.docs.unionByName(fresh_docs), sizes)
    # only lines with a new posting, or of a source that grew, can have changed their standing
    often = counts.where(F.col("n") >= MIN_DOCS)
    touched = often.join(delta.select(*LINE), LINE, "left_semi").unionByName(often.join(grown.select("src"), "src", "left_semi")).select(*LINE, "n").distinct()
    was = _excessive(state.counts.join(touched.select(*LINE), LINE, "left_semi"), state.sizes).select(*LINE)
    now = _excessive(touched, sizes).select(*LINE)
    crossed = now.join(was, LINE, "left_anti").withColumn("now", F.lit(True)).unionByName(was.join(now, LINE, "left_anti").withColumn("now", F.lit(False)))
    return new, crossed


def affected(state: LineState, crossed: DataFrame) -> DataFrame:
    """Documents (hashed, with their source) that hold a line whose standing changed: only these are rebuilt."""
    return state.postings.join(crossed.select(*LINE), LINE, "left_semi").select("src", "doc").distinct()


def rebuild(built: DataFrame | None, seen: DataFrame, part: DataFrame, changed: DataFrame, source: Column, doc: str, text: str, state: LineState) -> DataFrame:
    """Texts after a partition: the documents of `changed` and of `part` made anew from all rows `seen`, others as built."""
    key = {"_s": F.xxhash64(source), "_d": F.xxhash64(F.col(doc))}
    todo = changed.select(F.col("src").alias("_s"), F.col("doc").alias("_d")).unionByName(part.withColumns(key).select("_s", "_d")).distinct()
    anew = strip(seen.withColumns(key).join(todo, ["_s", "_d"], "left_semi").drop("_s", "_d"), source, text, state.excessive())
    if built is None:
        return anew
    return anew.unionByName(built.withColumns(key).join(todo, ["_s", "_d"], "left_anti").drop("_s", "_d"))


def mark(rows: DataFrame, excessive: DataFrame) -> DataFrame:
    """Rows of `lines` that are excessive; the list is broadcast only if counting shows it small."""
    bad = materialize(excessive.select(*LINE), "site-lines")
    if bad.count() <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    return rows.join(bad, LINE, "left_semi")


def strip(df: DataFrame, source: Column, text: str, excessive: DataFrame) -> DataFrame:
    """`df` with its excessive lines taken out of `text`, `lines_removed` counting them; other lines as they were.

    Lines are looked up per distinct text of a source; only the positions to drop come back to the rows.
    """
    ident = ["_src", "_t1", "_t2"]
    rows = df.withColumns({"_src": F.xxhash64(source), "_t1": F.xxhash64(F.col(text)), "_t2": F.xxhash64(F.lit(29), F.col(text))})
    each = lines(rows.select(*ident, text).where(F.col(text).isNotNull()).withColumn("_doc", F.lit(0)), F.lit(0), "_doc", text, keep=ident)
    each = each.withColumn("src", F.col("_src"))
    drop = mark(each, excessive).groupBy(*ident).agg(F.collect_set("line_no").alias("_drop"))
    out = rows.join(drop, ident, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_drop", i + 1))
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.withColumns({text: cleaned, "lines_removed": F.coalesce(F.size("_drop"), F.lit(0))}).drop(*ident, "_drop")
