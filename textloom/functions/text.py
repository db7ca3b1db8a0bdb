"""Scalar text functions, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that the application's regular expressions and trim() know.
JSWS = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same characters, one by one.
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed value: the Chinese characters that count as one token each.
CJK = r"[\u4e00-\u9fa5]"
SENTENCE = r"[^。！？；\r\n]+[。！？；]?"


def clean(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"[{JSWS}]+", "")


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JSWS}]+|[{JSWS}]+$", "")


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, f"[{JSWS}]+", " "))


def non_ws_length(text: Column) -> Column:
    return F.length(clean(text))


def cjk_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, CJK, ""))


def estimate_tokens(text: Column) -> Column:
    """A Chinese character is a token, of the rest four visible characters are; halves round up."""
    other = F.length(F.regexp_replace(text, f"[\\u4e00-\\u9fa5{JSWS}]", ""))
    return F.floor(cjk_count(text) + other / 4.0 + 0.5).cast("long")


def ext_of(name: Column) -> Column:
    """The last extension in lower case, or an empty text."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]+)$", 1))


def detect_type(name: Column) -> Column:
    ext = ext_of(name)
    kind = F.when(ext.isin("docx", "doc", "pdf", "txt", "rtf"), ext)
    return kind.when(ext.isin("md", "markdown"), "md").when(ext.isin("html", "htm"), "html")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def severity(sim: Column) -> Column:
    return F.when(sim >= 0.5, "high").when(sim >= 0.3, "mid").otherwise("low")


def pct(share: Column) -> Column:
    """A share as per cent with one digit."""
    return F.concat(F.format_string("%.1f", share.cast("double") * 100), F.lit("%"))


def target_percent(text: Column) -> Column:
    """The leading integer of a setting, 25 if there is none, kept between 5 and 60."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), f"^[{JSWS}]*([+-]?[0-9]{{1,9}})", 1)
    value = digits.try_cast("int")
    return F.greatest(F.lit(5), F.least(F.lit(60), F.coalesce(value, F.lit(25))))


def custom_terms(text: Column) -> Column:
    """The distinct non-empty lines, trimmed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), trim_ws)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_xml(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit('"'), F.lit("&quot;"))


def strip_markers(text: Column) -> Column:
    return F.translate(text, "\u0002\u0003", "")


def replace_first(para: Column, sentence: Column, replacement: Column) -> Column:
    """``struct(text, applied)``: the first occurrence of the sentence replaced; unchanged if there is none or either is empty."""
    at = F.position(sentence, para)
    applied = F.coalesce((sentence != "") & (replacement != "") & (at > 0), F.lit(False))
    head, tail = F.substring(para, F.lit(1), at - 1), F.substring(para, at + F.length(sentence), F.length(para))
    return F.struct(F.when(applied, F.concat(head, replacement, tail)).otherwise(para).alias("text"), applied.alias("applied"))


def normal_keyword(text: Column) -> Column:
    """Punctuation and white space as single blanks, 80 characters at most."""
    return F.substring(F.regexp_replace(text, f"[{JSWS}\\p{{Punct}}，。！？；：、“”‘’（）《》【】…—]+", " "), 1, 80)


# The search pages.
SEARCH_PAGES = (
    ("知网 CNKI", "https://kns.cnki.net/kns8s/defaultresult/index?kw="),
    ("万方数据", "https://s.wanfangdata.com.cn/paper?q="),
    ("维普", "https://qikan.cqvip.com/Qikan/Search/Index?key="),
    ("百度学术", "https://xueshu.baidu.com/s?wd="),
)


def search_urls(keyword: Column) -> Column:
    """An array of ``struct(name, url)``."""
    code = F.replace(F.url_encode(trim_ws(keyword)), F.lit("+"), F.lit("%20"))
    for plain, coded in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        code = F.replace(code, F.lit(coded), F.lit(plain))
    return F.array(*(F.struct(F.lit(n).alias("name"), F.concat(F.lit(u), code).alias("url")) for n, u in SEARCH_PAGES))


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)
