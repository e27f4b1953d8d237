"""Visually identical text with different characters, brought to the project's form.

Each token's letters have resolved script sets (their own script and those in which they have a double).  Their
intersection tells mixed-script and whole-script confusables; the token is spelt in the one script that fits all its
letters, and the remaining forms (width, radicals, marks, spaces, invisible characters) are normalised.  The character
work lives in `factloom.functions.form`; only values that a JVM-side character class marks as suspect reach Python.

Null values have no form and are never found; the empty text is in form; texts of any length are read whole; repeated
rows of one record give one finding; extra columns are carried along untouched by `normalize`.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.form import form, suspect, to_form

_KINDS = (
    ("invisible", regex.compile(r"[\p{Cf}\p{Cc}\p{Variation_Selector}--\n]", regex.V1)),
    ("space", regex.compile(r"[\p{Z}--\ ]", regex.V1)),
    ("width", regex.compile(r"[％．／＋－０-９Ａ-Ｚａ-ｚ]")),
    ("radical", regex.compile(r"[⺀-⿟豈-﫿]")),
    ("hyphen", regex.compile(r"[‐-–⁃−﹣]")),
    ("mark", regex.compile(r"\p{M}")),
    ("script", regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}]")),
)


def normalize(df: DataFrame, *fields: str) -> DataFrame:
    """`df` with the named text fields in the project's form; all other columns as they are."""
    return df.withColumns({f: form(F.col(f)) for f in fields})


def find(df: DataFrame, src_table: str, key: str, field: str) -> DataFrame:
    """One row per record whose `field` is not in the project's form."""
    odd = df.select(F.col(key).alias("src_key"), F.col(field).alias("_v")).where(suspect(F.col("_v")))
    return odd.where(F.col("_v") != form(F.col("_v"))).select(F.lit(src_table).alias("src_table"), "src_key", F.lit(f"{src_table}.{field}").alias("field_name")).distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _kinds(values: pd.Series) -> pd.Series:
    def of(text: str) -> list[str]:
        done = to_form(text)
        seen = {c: 0 for c in done}
        left = "".join(c for c in text if c not in seen)
        kinds = [name for name, p in _KINDS if p.search(left)]
        return kinds or ["script" if done != text else "none"]

    return values.map(of, na_action="ignore").astype(object)


def kinds(df: DataFrame, key: str, field: str) -> DataFrame:
    """Records whose `field` is not in form, with the kinds of characters that the form replaces."""
    odd = df.select(F.col(key).alias("src_key"), F.col(field).alias("_v")).where(suspect(F.col("_v"))).distinct()
    return odd.withColumn("kind", F.explode(_kinds("_v"))).where("kind <> 'none'").select("src_key", "kind")
