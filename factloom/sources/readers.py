"""Sources and sinks: JSON lines (strict and tolerant), Parquet with additive columns, snapshots that validate.

Missing optional columns become typed nulls, missing required ones are an error; malformed lines are rows of an issue
table, never dropped silently.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.measures import fingerprint


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict scan: the first malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): malformed lines come out as issues with their text; blank lines are neither."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return rows.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), rows.where(bad).select(F.lit("INVALID_JSON").alias("code"), F.col("value").alias("line"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`: casts, typed nulls for absent optional ones, an error for required ones."""
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if required := [n for n in absent if not schema[n].nullable]:
        raise ValueError(f"missing required columns: {', '.join(required)}")
    return df.select(*[(F.lit(None) if f.name in absent else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return conform(spark.read.parquet(path), schema)


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By suffix: Parquet, ORC, CSV with header, JSON lines."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return read_parquet(spark, path, schema)
    if kind == "orc":
        return conform(spark.read.orc(path), schema)
    if kind == "csv":
        return conform(spark.read.option("header", True).csv(path), schema)
    return read_jsonl(spark, path, schema)


def write_snapshot(df: DataFrame, folder: str, key: str) -> str:
    """Write to a fresh subfolder, read it back, and only then add a pointer to it.

    The count and the fingerprint of what was read must equal what was meant.  Pointers are only ever added, so a reader
    always finds the newest whole snapshot.
    """
    spark = df.sparkSession
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    path = os.path.join(folder, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if back.count() != back.select(key).distinct().count():
        raise ValueError(f"{key} is not unique")
    if fingerprint(back, df.columns).first() != fingerprint(df, df.columns).first():
        raise ValueError("the snapshot differs from its source")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("append").text(os.path.join(folder, "POINTERS"))
    return path


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot: names carry their time."""
    name = spark.read.text(os.path.join(folder, "POINTERS")).agg(F.max("value")).first()[0]
    return spark.read.parquet(os.path.join(folder, name))
