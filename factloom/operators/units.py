"""Quantities recorded in different units, brought to one common unit per metric.

A printed value is cut into numbers and unit text.  The unit text is segmented by dynamic programming over a trie
of prefixes (scales), roots (money, percentages, shares) and exponents (per, each, in all), each possible cut scored
with the prior of the metric's dimension, and the cheapest one is read as a linear conversion.  Spark partitions the
rows; the helper below works on one value at a time and keeps the cuts of unit texts it has met.

Null or unreadable values, unknown metrics and units that do not fit the metric give a null quantity.  If the value
prints a unit, `unit` is not consulted; if neither gives one, the quantity is null.  Very long texts are read whole.
A quantity has at most 26 digits before the point, as its column holds; a larger one is null.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation, localcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.form import to_form

# Unit vocabulary.  kind -> {spelling: factor}
PREFIXES = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8, "兆": 10**12, "k": 1000, "thousand": 1000, "m": 10**6, "mn": 10**6, "mln": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "billion": 10**9, "tn": 10**12, "trillion": 10**12}
MONEY = {"元": "1", "圆": "1", "yuan": "1", "rmb": "1", "cny": "1", "人民币": "1", "人民幣": "1", "¥": "1", "￥": "1", "角": "0.1", "分": "0.01", "fen": "0.01", "jiao": "0.1"}
PERCENT = {"%": "1", "percent": "1", "pct": "1", "百分之": "1", "百分点": "1", "个百分点": "1", "‰": "0.1", "千分之": "0.1", "万分之": "0.01", "bp": "0.01", "bps": "0.01", "基点": "0.01", "个基点": "0.01", "ratio": "100"}
SHARES = {"股": "1", "share": "1", "shares": "1"}
EXPONENTS = {"/": -1, "每": -1, "per": -1, "合计": 1, "共": 1, "a": -1}
SILENT = ("约", "近似", "大约", "近", "左右", "亏损", "净亏损", "负", "-", "+", "(", ")", "（", "）", " ", "approx", "approx.", "about", "~", "≈", "loss", "of", ",", "，", "。")
DIGITS, POWERS = dict(zip("零〇一二三四五六七八九两", (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2), strict=True)), {"十": 10, "百": 100, "千": 1000}
PRIOR = {"currency": {"money": 0.0, "percent": 4.0, "share": 4.0}, "percentage": {"money": 4.0, "percent": 0.0, "share": 4.0}, "per_share": {"money": 0.0, "percent": 4.0, "share": 0.0}}

_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?:e[+-]?\d{1,2}(?![\d.,]))?|\.\d+")
#: Two numbers with nothing but a dash between them are a range, and no quantity.
_RANGE = re.compile(r"#\s*(?:-|~|—|–|至|到)\s*#")
_HAN_NUMBER = re.compile(r"[零〇一二三四五六七八九两十百千]*[零〇一二三四五六七八九两十][零〇一二三四五六七八九两十百千]*(?:点[零〇一二三四五六七八九]+)?")
_NEGATIVE = re.compile(r"亏损|负|\bloss\b|[(（]\s*#|(?:^|[\s约似a-z])-\s*(?:rmb|cny|¥|￥)?\s*#|^[^#]*-\s*#|股\s*-\s*#")


@lru_cache(None)
def _trie() -> dict:
    root: dict = {}
    words = [(w, "prefix", Decimal(f)) for w, f in PREFIXES.items()] + [(w, "money", Decimal(f)) for w, f in MONEY.items()] + [(w, "percent", Decimal(f)) for w, f in PERCENT.items()]
    words += [(w, "share", Decimal(f)) for w, f in SHARES.items()] + [(w, "exponent", Decimal(f)) for w, f in EXPONENTS.items()] + [(w, "silent", Decimal(1)) for w in SILENT] + [("#", "number", Decimal(1))]
    for word, kind, factor in words:
        at = root
        for c in word:
            at = at.setdefault(c, {})
        at.setdefault("", []).append((word, kind, factor))
    return root


@lru_cache(65536)
def segment(text: str, dimension: str) -> tuple[tuple[str, str, Decimal], ...]:
    """Cheapest cut of a unit text: one per token, less for known long ones, more for what the dimension makes unlikely."""
    prior, trie = PRIOR[dimension], _trie()
    best: list[tuple[float, tuple]] = [(0.0, ())] + [(float("inf"), ())] * len(text)
    for i in range(len(text)):
        cost, path = best[i]
        if cost == float("inf"):
            continue
        at, j = trie, i
        while j < len(text) and text[j] in at:
            at, j = at[text[j]], j + 1
            for word, kind, factor in at.get("", ()):
                c = cost + 1 + prior.get(kind, 0.0) - 0.01 * len(word)
                if c < best[j][0]:
                    best[j] = (c, (*path, (word, kind, factor)))
        if cost + 8 < best[i + 1][0]:
            best[i + 1] = (cost + 8, (*path, (text[i], "unknown", Decimal(1))))
    return best[-1][1]


@lru_cache(65536)
def read(skeleton: str, dimension: str) -> tuple[str, tuple[Decimal | None, ...], str] | None:
    """How to convert a value of this shape: (unit text, factor of each number or None for share counts, state).

    State is `ok`, `bare` (no unit printed) or `unfit` (a unit of another dimension).
    """
    tokens = [t for t in segment(skeleton, dimension) if t[1] != "silent"]
    if any(t[1] == "unknown" for t in tokens) or _RANGE.search(skeleton):
        return None
    factors: list[Decimal] = []
    roots: list[Decimal | None] = []
    shares: set[int] = set()
    kinds, default, lead = set(), Decimal(1), Decimal(1)
    for n, (_, kind, factor) in enumerate(tokens):
        if kind == "number":
            factors.append(lead)
            roots.append(None)
            lead = Decimal(1)
        elif kind == "prefix":
            if not factors:
                lead *= factor
            else:
                factors[-1] *= factor
        elif kind in ("money", "percent"):
            kinds.add(kind)
            if factors and roots[-1] is None and len(factors) - 1 not in shares:
                roots[-1] = factor
            elif not factors:
                default = factor
            if factors and factor != 1:
                default = factor if len(factors) == 1 else default
        elif kind == "share":
            kinds.add("share")
            if n and tokens[n - 1][1] in ("number", "prefix") and factors:
                shares.add(len(factors) - 1)
    if "share" in kinds and not shares and not any(k == "exponent" and f < 0 for _, k, f in tokens):
        return None  # money times shares, which is no unit of any dimension
    used = tuple(w for w, k, _ in tokens if k not in ("number", "exponent"))
    if not kinds and not any(k == "prefix" for _, k, _ in tokens):
        return "", (), "bare"
    fits = {"currency": "percent" not in kinds and "share" not in kinds, "percentage": "money" not in kinds and "share" not in kinds and "percent" in kinds, "per_share": "percent" not in kinds}[dimension]
    if not fits:
        return " ".join(used), (), "unfit"
    return " ".join(used), tuple(None if i in shares else f * (roots[i] if roots[i] is not None else default) for i, f in enumerate(factors)), "ok"


def _han(text: str) -> Decimal:
    """A number written in Han numerals, below ten thousand, with decimals after 点."""
    whole, _, rest = text.partition("点")
    total = digit = 0
    for c in whole:
        if c in POWERS:
            total += (digit or 1) * POWERS[c]
            digit = 0
        else:
            digit = digit * 10 + DIGITS[c] if not any(p in whole for p in POWERS) else DIGITS[c]
    return Decimal(f"{total + digit}" + ("." + "".join(str(DIGITS[c]) for c in rest) if rest else ""))


def _skeleton(text: str) -> tuple[str, list[Decimal]]:
    numbers: list[Decimal] = []

    def take(m: re.Match) -> str:
        numbers.append(Decimal(m.group().replace(",", "")))
        return "#"

    out = _NUMBER.sub(take, re.sub(r"'0{3}(?!\d)", " thousand", text))
    if not numbers:
        head = "百分之" if "百分之" in out else "千分之" if "千分之" in out else "万分之" if "万分之" in out else ""
        body = out.replace(head, "", 1) if head else out

        def take_han(m: re.Match) -> str:  # 一万二千 is two numbers with a scale between them
            numbers.append(_han(m.group()))
            return (head if len(numbers) == 1 else "") + "#"

        out = _HAN_NUMBER.sub(take_han, body) if _HAN_NUMBER.search(body) else out
    return re.sub(r"\s+", " ", out).strip(), numbers


def quantity(raw: str | None, unit: str | None, dimension: str | None) -> tuple[Decimal | None, str | None, str | None, Decimal | None]:
    """(quantity in the dimension's common unit, unit read, where it stood, factor) of one printed value."""
    none = (None, None, None, None)
    if raw is None or dimension not in PRIOR:
        return none
    try:
        shape, numbers = _skeleton(to_form(raw).strip().lower())
        if not numbers:
            return none
        plan, source = read(shape, dimension), "raw_value"
        if plan is None or plan[2] == "unfit":
            return none
        if plan[2] == "bare":
            if len(numbers) != 1 or unit is None or not (text := to_form(unit).strip().lower()):
                return none
            tail, more = ("ratio", []) if text == "1" and dimension == "percentage" else _skeleton(text)
            plan, source, numbers = read("#" + tail, dimension), "unit", numbers + more
            if plan is None or plan[2] != "ok":
                return none
        name, factors, _ = plan
        if len(factors) != len(numbers):
            return none
        amount = sum((n * f for n, f in zip(numbers, factors, strict=True) if f is not None), Decimal(0))
        for n, f in zip(numbers, factors, strict=True):
            if f is None:
                amount /= n
        if _NEGATIVE.search(shape):
            amount = -amount
        return amount, name, source, next(f for f in factors if f is not None)
    except (InvalidOperation, ZeroDivisionError, StopIteration):
        return none


#: Digits of the exact arithmetic: those of the column, and as many again for products and shares before rounding.
DIGITS_HELD = 76
_NUMERIC, _EXACT = T.DecimalType(34, 12), T.DecimalType(38, 12)
QUANTITY = T.StructType([T.StructField("quantity", _EXACT), T.StructField("unit_used", T.StringType()), T.StructField("unit_from", T.StringType()), T.StructField("factor", _NUMERIC)])


@F.pandas_udf(QUANTITY)
def _quantity(raw: pd.Series, unit: pd.Series, dimension: pd.Series) -> pd.DataFrame:
    step = Decimal(1).scaleb(-12)

    def fit(x: Decimal | None, kind: T.DecimalType) -> Decimal | None:
        return None if x is None or abs(y := x.quantize(step)) >= 10 ** (kind.precision - kind.scale) else y

    def one(a: str | None, b: str | None, c: str | None) -> tuple:
        x, name, source, factor = quantity(a, b, c)
        try:
            return fit(x, _EXACT), name, source, fit(factor, _NUMERIC)
        except InvalidOperation:  # more digits than the context holds
            return None, name, source, None

    with localcontext(prec=DIGITS_HELD):
        rows = [one(a, b, c) for a, b, c in zip(raw, unit, dimension, strict=True)]
    return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(("quantity", "unit_used", "unit_from", "factor"))}, dtype=object)


def convert(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """`facts` with `dimension`, `quantity` (exact, in the metric's common unit), `unit_used`, `unit_from`, `factor`.

    The registry holds one row per metric (a fixed table); Spark decides from its size whether to broadcast it.
    """
    facts = facts.drop("dimension", "quantity", "unit_used", "unit_from", "factor")  # the operator's own columns win
    known = metrics.select(F.col("metric").alias("_metric"), F.col("dimension").alias("_dimension")).dropDuplicates(["_metric"])
    out = facts.join(known, facts["metric"] == known["_metric"], "left")
    q = _quantity(F.col("raw_value"), F.col("unit"), F.col("_dimension"))
    out = out.withColumn("_q", q)
    return out.select(*[facts[c] for c in facts.columns], F.col("_dimension").alias("dimension"), *[F.col(f"_q.{c}").alias(c) for c in ("quantity", "unit_used", "unit_from", "factor")])
