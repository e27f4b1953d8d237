"""Text expressions: every function maps a string column to a column inside whole-stage codegen.

Null in, null out, unless said otherwise; empty texts give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Patterns of numeric mentions.
NUMERIC, YEAR, PERCENT = r"[0-9]+(?:\.[0-9]+)?(?:%|倍|亿元|万元|元|例|家|月|年|季度)?", r"(?:19|20)[0-9]{2}年?", r"[0-9]+(?:\.[0-9]+)?%"
# Portal wording that marks a line as noise.
PORTAL = ("东方财富", "eastmoney", "choice数据", "choice金融终端", "股吧", "天天基金", "扫描下载app", "举报邮箱", "沪icp", "关于我们", "友情链接", "免责声明", "证券开户", "基金交易", "龙虎机单", "全球财经快讯")
# Words that carry no topic.
STOPWORDS = ("根据", "当前", "证据", "无法", "确认", "报告", "行业", "公司", "问题", "主要", "相关", "以及", "其中", "进行", "分别", "哪些", "什么", "情况", "主题", "强调", "指出", "聚焦", "近期", "这些", "显示", "认为", "提到", "围绕", "一个", "没有", "需要", "并且", "可以", "还是")
# Industries by the first part of a file name, then by words in it, in order.
INDUSTRY_PREFIX = {"半导体": "semiconductor", "新能源": "new_energy", "消费": "consumer", "白酒": "liquor"}
INDUSTRY_WORDS = {
    "semiconductor": "半导体|电子|晶圆|芯片|存储|算力|semicon|micron|hynix",
    "new_energy": "新能源|光伏|风电|锂电|储能|电车|固态电池|动力电池",
    "consumer": "消费|商社|美护|家电|零售|食品饮料|饮料|商贸|内需",
    "liquor": "白酒|酒企|茅台|五粮液|汾酒|泸州老窖",
    "agriculture": "农业|农|生猪|猪价|种业|饲料|usda|牧渔|养殖|牛价",
    "healthcare": "医药|医疗|健康|药|临床|肿瘤|肥胖|biotech|who|iqvia",
}
# Wording that makes a question a comparison, an induction, or numeric.
COMPARISON, INDUCTIVE = "比较|对比|区别|差异|相比|相较|高于|低于", "共性|总结|归纳|趋势|共同点|整体来看|主要特征"
NUMERIC_HINTS = "多少|多大|占比|同比|环比|增长|下降|收入|利润|销量|价格|%|亿元|万台|[0-9]"
# Markers of calculated figures, of adjusted, forecast and actual values, and of periods.
DERIVED = "同比|环比|增速|涨幅|跌幅|占比|净额|毛利率|净利率|倍数|较上年|较上期|同比增长|增长率|复合|cagr|yoy|growth|计算结果"
ADJUSTED, FORECAST, ACTUAL = "经调整|调整后|非公认会计准则|non-gaap|non gaap|adjusted", "预计|预期|预测|测算|指引|有望|或达|将实现|将达|计划|展望|目标营收", "实现|录得|达到|完成|同比|环比|累计"
ESTIMATE_YEAR = r"(?:^|[^0-9])(?:20)?[0-9]{2}\s*[eE](?:[^0-9]|$)"
PERIOD_KINDS = (("Q1", "q1|一季度|一季报|1-3月"), ("Q2", "q2|二季度"), ("H1", "h1|上半年|半年报|1-6月"), ("Q3", "q3|三季度|三季报|7-9月"))
PERIOD_OUT = "q4|四季度|1-9月|1-12月"
NEGATION = "不|没有|未|无|not |no "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize(c: Column) -> Column:
    """Uniform line ends and blanks, trimmed lines, no blank lines."""
    c = F.regexp_replace(F.regexp_replace(c, r"\x{A0}", " "), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x{3000}]+", " ")
    return strip(F.regexp_replace(c, rf"{WS}*\n{WS}*", "\n"))


def match_form(c: Column) -> Column:
    """Letters, digits and Han characters only, in lower case."""
    return F.lower(F.regexp_replace(normalize(c), r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]+", ""))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def numeric_tokens(c: Column) -> Column:
    """Distinct numeric mentions in order: numbers with units, then years, then percentages."""
    n = normalize(c)
    return F.array_distinct(F.concat(*(F.regexp_extract_all(n, F.lit(p), F.lit(0)) for p in (NUMERIC, YEAR, PERCENT))))


def first_sentence(c: Column, most: int = 80) -> Column:
    """First piece between sentence ends that is not blank, cut to `most` characters."""
    n = normalize(c)
    parts = F.filter(F.transform(F.split(n, r"[。！？!?;\n]"), strip), lambda x: x != "")
    s = F.coalesce(F.get(parts, F.lit(0)), n)
    return F.concat(F.regexp_replace(F.substring(s, 1, most), "[，,；; ]+$", ""), F.when(F.length(s) > most, "...").otherwise(""))


def is_noise_line(c: Column) -> Column:
    """Blank, a page number, portal wording, a long run of digits, or a run of repeated words."""
    n = normalize(c)
    words = F.filter(F.split(n, rf"{WS}+"), lambda x: x != "")
    page = F.lower(n).rlike(r"^(第?\s*[0-9]+\s*页|page\s*[0-9]+|[0-9]+\s*/\s*[0-9]+)$")
    digits = F.length(F.regexp_replace(n, "[^0-9]", ""))
    return (n == "") | page | F.lower(n).rlike("|".join(PORTAL)) | ((F.length(n) > 120) & (digits > 20)) | ((F.size(words) > 20) & (F.size(F.array_distinct(words)) < F.size(words) * 0.4))


def is_title_like(c: Column) -> Column:
    """A short numbered line with at most one punctuation mark that is not noise."""
    n = normalize(c)
    marks = F.length(F.regexp_replace(n, "[^。；！？,，]", ""))
    return (n != "") & (F.length(n) <= 60) & ~is_noise_line(c) & (marks <= 1) & n.rlike(r"^([0-9]+(\.[0-9]+)*|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十0-9]+[章节部分])")


def _holds(word: str):
    return lambda x: F.contains(x, F.lit(word))


def is_table_like(c: Column) -> Column:
    """Several lines, and many numbers on short lines, or delimiters, or finance words."""
    n = normalize(c)
    ls = lines(n)
    numbers = F.size(F.regexp_extract_all(n, F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0)))
    short = F.size(F.filter(ls, lambda x: F.length(x) <= 40))
    bars = F.size(F.regexp_extract_all(n, F.lit(r" \| "), F.lit(0)))
    words = sum((F.size(F.filter(ls, _holds(w))) for w in ("亿元", "万元", "同比", "环比", "pct", "%", "市盈率", "毛利率")), F.lit(0))
    return (n != "") & (F.size(ls) >= 2) & (((numbers >= 4) & (short * 2 >= F.size(ls))) | (bars >= 2) | (words >= 5))


def support_span(c: Column, most: int = 180) -> Column:
    """What a chunk is quoted by: its first three lines if it is a table, else its first sentence."""
    n = normalize(c)
    rows = F.regexp_replace(F.substring(F.array_join(F.slice(lines(n), 1, 3), " | "), 1, most), r"\s+$", "")
    return F.when(n == "", "").when(is_table_like(c), rows).otherwise(first_sentence(c, most))


def words(c: Column) -> Column:
    """Search tokens as a bag: Latin words and numbers, and Han bigrams (single characters where a run has one)."""
    n = F.lower(c)  # blanks and line ends are no part of tokens
    han = r"[\x{4E00}-\x{9FFF}]"
    pairs = F.regexp_extract_all(n, F.lit(rf"(?=({han}{{2}})){han}"), F.lit(1))  # the look-ahead lets pairs overlap
    lone = F.regexp_extract_all(n, F.lit(rf"(?<!{han}){han}(?!{han})"), F.lit(0))
    return F.concat(F.regexp_extract_all(n, F.lit("[a-z0-9]+"), F.lit(0)), pairs, lone)


def runs(c: Column) -> Column:
    """Latin words and Han runs of two and more characters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{2,}|[\x{4E00}-\x{9FFF}]{2,}"), F.lit(0))


def grams(run: str) -> list[str]:
    """A run as terms: itself, and the 2- and 3-grams of a Han run of more than four characters."""
    if len(run) <= 4 or run[0] < "\u4e00":
        return [run]
    return [run, *(run[i : i + 2] for i in range(len(run) - 1)), *(run[i : i + 3] for i in range(len(run) - 2))]


def industry(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", "")
    prefix = F.regexp_extract(stem, r"^([^_]+)_[0-9]{4}-[0-9]{2}-[0-9]{2}_[A-Za-z0-9]+_.+$", 1)
    out = None
    for k, v in INDUSTRY_PREFIX.items():
        out = F.when(prefix == k, v) if out is None else out.when(prefix == k, v)
    for k, v in INDUSTRY_WORDS.items():
        out = out.when(F.lower(stem).rlike(v), k)
    return out.otherwise("other")


def doc_id(file_name: Column) -> Column:
    """Stable id of a file: a slug of its stem and eight digits of its name's hash."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ""), r"\s+", "-")
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^0-9A-Za-z\x{4E00}-\x{9FFF}_-]+", "-"), "^-+|-+$", ""))
    digest = F.substring(F.sha1(file_name.cast("binary")), 1, 8)
    return F.concat(F.when(slug == "", "doc").otherwise(F.substring(slug, 1, 48)), F.lit("-"), digest)


def claim_id(c: Column) -> Column:
    """Content-stable id of a claim."""
    return F.concat(F.lit("C"), F.substring(F.sha1(F.regexp_replace(strip(c), rf"{WS}+", " ").cast("binary")), 1, 12))


def value_type(c: Column) -> Column:
    """adjusted, forecast, actual or unknown, by the wording around a figure."""
    return F.when(F.lower(c).rlike(ADJUSTED), "adjusted").when(c.rlike(ESTIMATE_YEAR), "forecast").when(c.rlike(FORECAST), "forecast").when(c.rlike(ACTUAL), "actual").otherwise("unknown")


def period(c: Column) -> Column:
    """Fiscal period struct of a mention: exactly one year, first kind that its wording names, FY by default."""
    compact = F.lower(F.regexp_replace(normalize(c), r"\s+", ""))
    four = F.regexp_extract_all(compact, F.lit(r"20[0-9]{2}"), F.lit(0))
    two = F.transform(F.concat(F.regexp_extract_all(compact, F.lit(r"(?:^|[^0-9])([0-9]{2})[qh][0-9]"), F.lit(1)), F.regexp_extract_all(compact, F.lit(r"(?:^|[^0-9])([0-9]{2})年"), F.lit(1))), lambda y: F.concat(F.lit("20"), y))
    years = F.array_distinct(F.concat(four, two))
    kind = None
    for k, p in PERIOD_KINDS:
        kind = F.when(compact.rlike(p), k) if kind is None else kind.when(compact.rlike(p), k)
    known = ~compact.rlike(PERIOD_OUT) & (F.size(years) == 1)
    return F.when(known, F.struct(kind.otherwise("FY").alias("kind"), F.get(years, F.lit(0)).cast("int").alias("year")))


def claim_type(text: Column, n_docs: Column) -> Column:
    return F.when(F.lower(text).rlike(DERIVED), "DERIVED").when(n_docs >= 2, "SYNTHESIZED").otherwise("EXTRACTED")


def question_mode(c: Column) -> Column:
    n = normalize(c)
    return F.when(n.rlike(COMPARISON), "comparison").when(n.rlike(INDUCTIVE), "inductive").otherwise("fact")


def overlap(left: Column, right: Column) -> Column:
    """Share of the left token set that the right one holds."""
    left = F.array_distinct(left)
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.lit(1))
