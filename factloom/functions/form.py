"""The project's form of a text: one spelling for everything that looks the same.

Almost every value is already in the form, so a JVM-side character-class test picks the few
values that may need work and only those cross into Python (Arrow batches).  A null value has
a null form; the empty text is its own form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Radicals of the CJK Radicals Supplement and the unified ideographs they look like.
RADICAL = "⺁⺂⺃⺄⺅⺆⺈⺉⺊⺋⺌⺍⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺯⺰⺱⺲⺳⺶⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳"
UNIFIED = "厂乛乚乙亻冂刀刂卜㔾小小兀尣尢巳幺彑彐忄㣺扌攵旡日月歺母民氵氺灬爫爫丬牛犭王疋罒示礻糹纟罓罒㓁羊耂肀肀肉臼艹艹艹虎衤覀西见角讠贝车辶辶辶邑钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟"
# Hyphens and minus signs spelt `-` in the form.
HYPHENS = "‐‑‒–−﹣－⁃"
# Full-width signs spelt half-width in the form (Chinese punctuation is not among them).
WIDE_SIGNS = "％．／＋＃＄＆＊＝＠＿＾｀｜＼"
# Invisible characters outside the format category.
BLANKS_WITHOUT_FORM = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
# Letters of other scripts that are drawn like Latin letters.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХԌԚԜҮаԁсеһіјӏорԛѕуѵхԝ", "ABESIJKMHOPCTYXGQWYadcehijlopqsyvxw"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc"
ARMENIAN, ARMENIAN_AS = "ՕՍհոսօ", "OUhnuo"
LISU, LISU_AS = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
CHEROKEE, CHEROKEE_AS = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏏᏙᏚᏞᏟᏢᏦ", "DRTiAJEWMHGZbVSLCPK"
COPTIC, COPTIC_AS = "ⲂⲎⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲬ", "BHKMNOoPpCcTX"
# Greek small letters that serve as symbols; look-alikes only inside a Latin word.
SYMBOLS, SYMBOLS_AS = "αγικνρυ", "ayikvpu"

# Characters that are in form wherever they stand: plain ranges, so that one scan settles almost every value.
CLEAN = (
    r"^[\x{4E00}-\x{9FFF} -~\n\x{3001}-\x{3029}\x{FF0C}\x{FF1A}-\x{FF1C}\x{FF07}-\x{FF09}\x{FF01}\x{FF1E}\x{FF1F}\x{2014}-\x{2027}\x{A1}-\x{AC}\x{AE}-\x{24F}"
    r"\x{2030}-\x{2042}\x{2044}-\x{205E}\x{20A0}-\x{20BF}\x{2100}-\x{2125}\x{2127}-\x{2129}\x{212C}-\x{2211}\x{2213}-\x{2328}\x{232B}-\x{27FF}"
    r"\x{3030}-\x{3098}\x{309B}-\x{312F}\x{3165}-\x{4DBF}\x{FF3B}\x{FF3D}\x{FF5B}\x{FF5D}-\x{FF65}]*+\z"
)


@lru_cache(None)
def _table() -> dict[int, str | None]:
    t: dict[int, str | None] = {ord(a): b for a, b in zip(RADICAL, UNIFIED, strict=True)}
    t |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
    t |= {c: chr(c - 0xFEE0) for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1)}
    t |= {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0x1D400, 0x1D800), *range(0xFB00, 0xFB07)]}
    t |= {ord(c): chr(ord(c) - 0xFEE0) for c in WIDE_SIGNS}
    t |= {ord(c): "-" for c in HYPHENS}
    for c in [*range(0x0, 0x3100), *range(0xFE00, 0x10000), *range(0xE0000, 0xE1000)]:
        kind = unicodedata.category(chr(c))
        if kind in ("Zs", "Zl", "Zp"):
            t[c] = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            t[c] = None
    t |= {ord(c): None for c in BLANKS_WITHOUT_FORM}
    return t | {0x09: " ", 0x0A: "\n"}


# The same ranges for single values: what stands outside them may need work.
_ODD = re.compile("[^" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]:>04}", CLEAN[2 : CLEAN.index("]")]) + "]")
#: Script -> {its letter: the Latin letter that looks the same}.
_DOUBLES = {
    "Greek": dict(zip(GREEK, GREEK_AS, strict=True)), "Cyrillic": dict(zip(CYRILLIC, CYRILLIC_AS, strict=True)), "Armenian": dict(zip(ARMENIAN, ARMENIAN_AS, strict=True)),
    "Lisu": dict(zip(LISU, LISU_AS, strict=True)), "Cherokee": dict(zip(CHEROKEE, CHEROKEE_AS, strict=True)), "Coptic": dict(zip(COPTIC, COPTIC_AS, strict=True)),
}
_LOOKS = {a: b for doubles in _DOUBLES.values() for a, b in doubles.items()}
_BACK = {script: {b: a for a, b in doubles.items()} for script, doubles in _DOUBLES.items()}
_INSIDE = dict(zip(SYMBOLS, SYMBOLS_AS, strict=True))
_NAMES = ("Latin", *_DOUBLES)
_TOKEN = regex.compile("[" + "".join(rf"\p{{{n}}}" for n in _NAMES) + r"\p{M}]+")
_FOREIGN = regex.compile("[" + "".join(rf"\p{{{n}}}" for n in _DOUBLES) + "]")
_LATIN, _LATIN_AFTER = regex.compile(r"\p{Latin}"), regex.compile(r"[ \-&./]?\p{Latin}")
_SCRIPTS = tuple((n, regex.compile(rf"\p{{{n}}}")) for n in _NAMES)


@lru_cache(4096)
def own_scripts(letter: str) -> frozenset[str]:
    """The script of a letter; marks fit every script."""
    return frozenset({n for n, p in _SCRIPTS if p.match(letter)} or _NAMES)


@lru_cache(4096)
def scripts_of(letter: str) -> frozenset[str]:
    """The resolved scripts of a letter: its own and those in which it has a double."""
    latin = _LOOKS.get(letter, letter)
    return own_scripts(letter) | ({"Latin"} if letter in _LOOKS else set()) | {n for n, back in _BACK.items() if latin in back}


def spelt_in(letter: str, script: str) -> str:
    """A letter, or its double in the script."""
    if script in own_scripts(letter):
        return letter
    latin = _LOOKS.get(letter, letter)
    return latin if script == "Latin" else _BACK[script].get(latin, letter)


def resolve_token(token: str, beside_latin: bool = False) -> str:
    """Spell a token in one script that fits all its letters, or leave it.

    The resolved script sets are intersected letter by letter.  A token that mixes scripts takes a script of that
    intersection: Latin if it is there, else the one most of its letters are of (not Greek, whose letters are symbols
    beside Latin ones: ΔT, MΩ); otherwise it stays.
    A token of one foreign script whose letters all have Latin doubles (whole-script confusable) becomes Latin only
    directly beside a Latin word; a lone Greek letter is a symbol, and Greek symbols are look-alikes only inside a word.
    """
    if not _FOREIGN.search(token):
        return token
    letters = list(unicodedata.normalize("NFD", token))
    lower = lambda c: c.islower() and "Latin" in scripts_of(c)
    letters = [_INSIDE[c] if c in _INSIDE and 0 < i < len(letters) - 1 and lower(letters[i - 1]) and lower(letters[i + 1]) else c for i, c in enumerate(letters)]
    fits = frozenset.intersection(*map(scripts_of, letters))
    whole = frozenset.intersection(*map(own_scripts, letters))
    if not fits:
        return token
    if "Latin" in whole:
        script = "Latin"
    elif whole:
        base = [c for c in letters if not unicodedata.combining(c)]
        if "Latin" not in fits or not beside_latin or ("Greek" in whole and len(base) == 1):
            return token
        script = "Latin"
    elif "Latin" in fits:
        script = "Latin"
    else:
        of = lambda n: sum(own_scripts(c) == {n} for c in letters)
        script = max(sorted(fits), key=of)
        if script == "Greek" or of(script) <= of("Latin"):
            return token
    return unicodedata.normalize("NFC", "".join(spelt_in(c, script) for c in letters))


def _beside_latin(text: str, start: int, end: int) -> bool:
    """Whether a Latin letter, with its marks, stands before or after, at most one blank or sign away."""
    i = start - 1
    if i >= 0 and text[i] in " -&./":
        i -= 1
    while i >= 0 and unicodedata.combining(text[i]):
        i -= 1
    return (i >= 0 and _LATIN.match(text[i]) is not None) or _LATIN_AFTER.match(text, end) is not None


def to_form(text: str | None) -> str | None:
    """The project's form of one value."""
    if text is None or not _ODD.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_table()))
    if not _FOREIGN.search(text):
        return text
    return _TOKEN.sub(lambda m: resolve_token(m.group(), _beside_latin(text, m.start(), m.end())), text)


@F.pandas_udf(T.StringType())
def _form_udf(values: pd.Series) -> pd.Series:
    return values.map(to_form, na_action="ignore").astype(object)


def suspect(c: Column) -> Column:
    """True where a value may not be in the project's form: it holds a character outside the clean ranges."""
    return F.coalesce(~c.rlike(CLEAN), F.lit(False))


def form(c: Column) -> Column:
    """Column of the project's form; clean values never leave the JVM."""
    odd = suspect(c)
    return F.when(odd, _form_udf(F.when(odd, c))).otherwise(c)


def match_key(c: Column) -> Column:
    """Key under which equal-looking values are equal: form, then trimmed and lower-cased."""
    return F.lower(F.regexp_replace(form(c), r"^\s+|\s+$", ""))


def blank(c: Column) -> Column:
    """True for values that hold no letter and no digit (null included)."""
    return ~F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))




def sql_form(x: str) -> str:
    """SQL expression of the form for checks, coarser in one point: every letter with a Latin double becomes Latin."""
    one = {chr(c): v for c, v in _table().items() if c < 0x10000 and chr(c) not in "\n\t" and c > 0x1F}
    one |= _LOOKS
    swap = {a: b for a, b in one.items() if b is not None and len(b) == 1}
    gone = [a for a, b in one.items() if b is None]
    return f"nfc_normalize(translate({x}, '{''.join(swap)}{''.join(gone)}', '{''.join(swap.values())}'))"
