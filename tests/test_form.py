import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions.form import form, match_key, scripts_of, suspect, to_form

CASES = [
    ("Ｃοpyright", "Copyright"), ("СNY ＣΝＹ RΜB", "CNY CNY RMB"), ("μm μｍ Δ Ω β", "μm μm Δ Ω β"), ("“Луна”，“Заря”。", "“Луна”，“Заря”。"), ("⼭垚精⼯⻛", "山垚精工风"),
    ("café", "café"), ("２．５％ －３ −4 a‑b", "2.5% -3 -4 a-b"), ("a​b c­d︀", "ab cd"), ("TNFα", "TNFα"), ("Сахар", "Сахар"), ("Gaoqiao Со", "Gaoqiao Co"),
    ("a\nb", "a\nb"), ("，。；：！？、（）“”……℃㎡‰①", "，。；：！？、（）“”……℃㎡‰①"), ("", ""), ("　x y", " x y"), ("體 億", "體 億"), ("ё е́x", "ё éx"), ("豈", "豈"),
    ("Мoсква", "Москва"), ("ꓐANK Ꭺpple ⲟil", "BANK Apple oil"), ("ΔT MΩ Hα 5kΩ", "ΔT MΩ Hα 5kΩ"), ("нadh", "нadh"), ("x" + "\u0316" * 30 + " Со", "x" + "\u0316" * 30 + " Co"),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_cases(text, expected):
    assert to_form(text) == expected


def test_null():
    assert to_form(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_idempotent_and_clean(text):
    once = to_form(text)
    assert to_form(once) == once
    assert not any(unicodedata.category(c) == "Cf" or 0xFF10 <= ord(c) <= 0xFF19 for c in once)


def test_column_equals_scalar(spark):
    values = [a for a, _ in CASES] + [None, "plain", "长" * 50_000 + "Ａ"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", form(F.col("v")).alias("f"), suspect(F.col("v")).alias("s"), match_key(F.concat(F.lit("  "), F.col("v"), F.lit(" "))).alias("k")).collect()
    for r in rows:
        v = values[r.i]
        assert r.f == to_form(v)
        assert r.s or v is None or to_form(v) == v  # what is not suspect is in form
        assert v is None or r.k == to_form(v).strip().lower()


def test_scripts():
    assert scripts_of("о") == {"Cyrillic", "Latin", "Greek", "Armenian", "Coptic"}
    assert scripts_of("o") == scripts_of("о")  # whatever script it is written in
    assert scripts_of("Л") == {"Cyrillic"}
    assert "Greek" in scripts_of("́")
