"""Queries over small texts that the tables lack (Chinese prose, file formats, settings), with the rows they have to give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import lint, mask, refine, rewrite, segment, similarity
from textloom.sources import documents as src
from textloom.sources import sinks


def _texts(spark: SparkSession, texts: list) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL for a list of rows."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{v}::BIGINT"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join('"' + c.strip() + '"' for c in columns.split(','))})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(columns: str, rows: list[tuple]) -> Callable:
    def add(function: Callable[[SparkSession], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, _: function(spark)
        ORACLES[function.__name__] = _values(columns, rows)
        return function

    return add


def _one(column: Callable[[Column], Column], name: str = "out") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("id", column(F.col("text")).alias(name))


@_query(
    "id, issue_idx, type, issue, index",
    [
        (0, 0, "colloquial", "非常之", 1),
        (1, 0, "colloquial", "特别特别", 0),
        (1, 1, "colloquial", "好多", 4),
        (2, 0, "colloquial", "很大的", 2),
        (3, 0, "colloquial", "越来越", 0),
        (3, 1, "colloquial", "其实", 3),
        (4, 0, "colloquial", "有点", 0),
        (4, 1, "colloquial", "啥", 4),
        (5, 0, "colloquial", "等等等等", 2),
        (6, 0, "redundant", "进行了分析", 2),
        (6, 1, "redundant", "加以改进", 9),
        (7, 0, "redundant", "能够被", 2),
        (8, 0, "redundant", "在…的过程中", 0),
        (8, 1, "redundant", "具有一定的意义", 7),
        (9, 0, "colloquial", "其实", 0),
        (9, 1, "long", "其实" + "长" * 58 + "…（全句 82 字）", -1),
    ],
)
def lint_rules(spark):
    texts = ["它非常之好", "特别特别好多", "有个很大的坑", "越来越其实", "有点儿 啥", "苹果等等等等", "我们进行了分析，可加以改进", "方法能够被用", "在…的过程中，具有一定的意义", "其实" + "长" * 80 + "。", "简洁。", "", None]
    return lint.issues(_texts(spark, texts), ["id"]).select("id", F.col("issue_idx").cast("long").alias("issue_idx"), "type", "issue", F.col("index").cast("long").alias("index"))


@_query(
    "id, span_idx, span",
    [
        (0, 0, "$x^2$"),
        (0, 1, "[1, 2]"),
        (0, 2, "表 3"),
        (0, 3, "Softmax"),
        (0, 4, "98.5%"),
        (1, 0, "表　3"),
        (1, 1, "图 十二"),
        (1, 2, "公式4(2)"),
        (2, 0, "(3-5)"),
        (2, 1, "[6　7]"),
        (2, 2, "20km"),
        (2, 3, "3万元"),
        (3, 0, "$$a$$"),
        (3, 1, "\\[b\\]"),
    ],
)
def mask_fixture(spark):
    texts = ["设$x^2$与[1, 2]，见表 3和Softmax约98.5%", "表　3与图 十二与公式4(2)", "引(3-5)与[6　7]长20km值3万元", "$$a$$ 与 \\[b\\]", "", None]
    return mask.spans(_texts(spark, texts)).select("id", F.col("span_idx").cast("long").alias("span_idx"), "span")


@_query("id, masked, n_items, back", [(0, "见0与1", 2, "见表　3与98.5%"), (1, "深度学习0"[:0] + "01", 2, "深度学习Softmax"), (2, "", 0, "")])
def mask_fixture_round_trip(spark):
    masked = mask.protect(_texts(spark, ["见表　3与98.5%", "深度学习Softmax", None]), ["id"], terms=["深度", "深度学习"])
    back = mask.restore(masked, ["id", "masked", "items"])
    return back.select("id", "masked", F.size("items").cast("long").alias("n_items"), F.col("text").alias("back"))


@_query("id, k, part", [(0, 0, "一二三。"), (0, 1, "四五六！"), (0, 2, "七八；"), (1, 0, "a.b;c"), (2, 0, "无标点")])
def sentences_fixture(spark):
    rows = segment.sentence_rows(_texts(spark, ["一二三。四五六！七八；", "a.b;c", "无标点", "", None]))
    return rows.select("id", F.col("sent_idx").cast("long").alias("k"), F.col("sentence").alias("part"))


@_query("id, k, part", [(0, 0, "一二三。四五六！"), (0, 1, "七八九；十！"), (0, 2, "长长长长长长长长长长长长。"), (1, 0, "a."), (2, 0, "甲　乙")])
def chunks_fixture(spark):
    rows = segment.chunk_rows(_texts(spark, ["一二三。四五六！七八九；十！" + "长" * 12 + "。", "a. ", "　甲　乙　", "", None]), ["id"], limit=10)
    return rows.select("id", F.col("chunk_idx").cast("long").alias("k"), F.col("chunk").alias("part"))


@_query("id, k, part", [(0, 0, "因为甲"), (0, 1, "所以乙"), (1, 0, "无")])
def clauses_fixture(spark):
    rows = segment.explode_rows(_texts(spark, ["因为甲，所以乙", "无"]), segment.clauses(F.col("text")), "k", "part")
    return rows.select("id", F.col("k").cast("long").alias("k"), "part")


@_query("id, plain, refined, exported", [(0, "a b|c", "a \nb|c", "a|b|c"), (1, "甲", "甲", "甲"), (2, "", " ", "")])
def paragraphs_fixture(spark):
    joined = lambda c: F.array_join(c, "|")
    t = F.col("text")
    return _texts(spark, ["a \nb\r\n\r\n 　\n c\n", "　甲　", " "]).select("id", joined(segment.paragraphs(t)).alias("plain"), joined(segment.refine_paragraphs(t)).alias("refined"), joined(segment.export_paragraphs(t)).alias("exported"))


@_query("id, out", [(0, 5), (1, 0), (2, 1), (3, 4)])
def tokens_fixture(spark):
    return _one(tx.estimate_tokens)(_texts(spark, ["甲乙丙丁1234", "", "ab", "甲 乙　丙 abcd"]))


@_query("id, out, applied", [(0, "甲X丁1234乙丙", True), (1, "甲", False), (2, "甲", False), (3, "甲", False)])
def replace_fixture(spark):
    rows = spark.createDataFrame([(0, "甲乙丙丁1234乙丙", "乙丙", "X"), (1, "甲", "zz", "X"), (2, "甲", "", "X"), (3, "甲", "甲", "")], "id long, p string, s string, r string")
    return rows.select("id", tx.replace_first(F.col("p"), F.col("s"), F.col("r")).alias("x")).select("id", F.col("x.text").alias("out"), F.col("x.applied").alias("applied"))


@_query("id, class, share", [(0, "high", "50.0%"), (1, "mid", "30.0%"), (2, "low", "29.9%"), (3, "low", "0.0%"), (4, "high", "100.0%")])
def severity_fixture(spark):
    rows = spark.createDataFrame(list(enumerate([0.5, 0.3, 0.299, 0.0, 1.0])), "id long, v double")
    return rows.select("id", tx.severity(F.col("v")).alias("class"), tx.pct(F.col("v")).alias("share"))


@_query("id, target, terms", [(0, 30, "30"), (1, 25, "a|b"), (2, 60, "99"), (3, 5, "3"), (4, 25, ""), (5, 5, "-8")])
def settings_fixture(spark):
    t = F.col("text")
    return _texts(spark, ["30", " a\nb\r\n\na", "99", " 3", None, "-8"]).select("id", tx.target_percent(t).cast("long").alias("target"), F.array_join(tx.custom_terms(t), "|").alias("terms"))


@_query("id, html, xml, plain, keyword", [(0, '&lt;a&gt; &amp; "b"', "&lt;a&gt; &amp; &quot;b&quot;", '<a> & "b"', " a b "), (1, "甲，乙", "甲，乙", "甲，乙", "甲 乙"), (2, "\u0002x\u0003y", "\u0002x\u0003y", "xy", "\u0002x\u0003y")])
def escapes_fixture(spark):
    t = F.col("text")
    return _texts(spark, ['<a> & "b"', "甲，乙", "\u0002x\u0003y"]).select("id", tx.escape_html(t).alias("html"), tx.escape_xml(t).alias("xml"), tx.strip_markers(t).alias("plain"), tx.normal_keyword(t).alias("keyword"))


@_query("id, class, label", [(0, "cheap", "🟢 经济"), (1, "high", "🔴 高配"), (2, "unknown", "❔ 未知"), (3, "unknown", "❔ 未知")])
def price_fixture(spark):
    rows = _texts(spark, ["deepseek-chat", "claude-opus-4-20250514", "else", None])
    return rows.select("id", refine.price_of(F.col("text")).alias("class"), refine.price_label(F.col("text")).alias("label"))


@_query("id, name", [(0, "One"), (1, "Two"), (2, "One"), (3, "One")])
def provider_fixture(spark):
    providers = [{"id": "one", "name": "One"}, {"id": "two", "name": "Two"}]
    return refine.with_provider(_texts(spark, ["one", "two", "three", None]), "text", providers).select("id", "provider.name")


@_query(
    "id, out",
    [
        (0, "API Key 无效或没有权限（HTTP 401），请检查 Key 是否正确"),
        (1, "请求过于频繁或额度用尽（HTTP 429），请稍后再试或检查账户余额"),
        (2, "请求被拒绝（HTTP 400）：坏"),
        (3, "请求被拒绝（HTTP 400）：参数有误"),
        (4, "网络连接失败（服务商接口不可达或跨域限制），请检查网络，或使用本地服务模式"),
        (5, "模型名称不存在（HTTP 404），请检查模型选择是否正确"),
        (6, "账户余额不足（HTTP 402）"),
        (7, "别的"),
    ],
)
def errors_fixture(spark):
    rows = spark.createDataFrame([(0, 401, "x", None), (1, 429, "x", None), (2, 400, "x", "坏"), (3, 400, "x", None), (4, None, "Failed to fetch", None), (5, 404, "x", None), (6, 402, "x", None), (7, 500, "别的", None)], "id long, s int, m string, d string")
    return rows.select("id", refine.error_message(F.col("s"), F.col("m"), F.col("d")).alias("out"))


@_query("kind, model, user, n_max, answer", [("openai", "m", "u", "512", "c"), ("anthropic", "m", "u", "512", "ab"), ("gemini", None, "u", "512", "ab")])
def services_fixture(spark):
    """The three shapes of requests and responses."""
    m, s, u = F.lit("m"), F.lit("s"), F.lit("u")
    bodies = {"openai": (refine.openai_payload(m, s, u, 512), "$.messages[1].content", "$.max_tokens"), "anthropic": (refine.anthropic_payload(m, s, u, 512), "$.messages[0].content", "$.max_tokens"), "gemini": (refine.gemini_payload(s, u, 512), "$.contents[0].parts[0].text", "$.generationConfig.maxOutputTokens")}
    answers = {"openai": '{"choices":[{"message":{"content":"c"}}]}', "anthropic": '{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}', "gemini": '{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}'}
    parts = []
    for kind, (body, user, most) in bodies.items():
        get = lambda path: F.get_json_object(body, path)  # noqa: B023, E731
        parts.append(F.struct(F.lit(kind).alias("kind"), get("$.model").alias("model"), get(user).alias("user"), get(most).alias("n_max"), refine.parse_response(F.lit(kind), F.lit(answers[kind])).alias("answer")))
    return spark.range(1).select(F.explode(F.array(*parts)).alias("x")).select("x.*")


@_query("id, k, part", [(0, 0, "a"), (0, 1, "b中c"), (1, 0, "a"), (1, 1, "e b"), (1, 2, "d c"), (2, 0, "xy")])
def rtf_fixture(spark):
    rows = src.read_rtf(_texts(spark, [r"{\rtf1 a\par b\u" + r"20013?c\'41}", r"a\line b\pard c", r"\u-100?x\{y", None]), ["id"], "text")
    return rows.select("id", F.col("para_idx").cast("long").alias("k"), F.col("paragraph").alias("part"))


@_query("id, k, part", [(0, 0, "ab c"), (0, 1, "b c"), (1, 0, "just & text"), (2, 0, "x"), (2, 1, "yz"), (2, 2, "z")])
def html_fixture(spark):
    rows = src.read_html(_texts(spark, ["<body><div>a<p>b  c</p></div></body>", "just &amp; text", "<ul><li>x</li><li>y<h2>z</h2></li></ul>", None]), ["id"], "text")
    return rows.select("id", F.col("para_idx").cast("long").alias("k"), F.col("paragraph").alias("part"))


DOCX = (
    "<w:document><w:body><w:p><w:pPr><w:b/></w:pPr><w:r><w:t>one &amp;lt; &#x4e2d;&#x110000;</w:t><w:tab/><w:t>two</w:t></w:r></w:p>"
    "<w:p><w:r><w:t>f </w:t></w:r><m:oMath><m:r>x</m:r></m:oMath></w:p><w:p><w:drawing></w:drawing></w:p><w:sectPr/></w:body></w:document>"
)


def _package(xml: str) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@_query(
    "id, k, part, n_formulas, safe, failed",
    [(0, 0, "one &lt; 中� two", 0, True, False), (0, 1, "f 0", 1, True, False), (0, 2, "", 0, False, False), (1, -1, None, 0, False, True), (2, -1, None, 0, False, True), (3, 0, "a < b", 0, True, False), (3, 1, "第二段", 0, True, False)],
)
def docx_fixture(spark):
    files = spark.createDataFrame([(0, _package(DOCX)), (1, b"no package"), (2, None), (3, sinks.minimal_docx(["a < b", "第二段"]))], "id long, content binary")
    rows = src.read_docx_rows(files, ["id"])
    return rows.select("id", F.col("para_idx").cast("long").alias("k"), F.col("paragraph").alias("part"), F.size("formulas").cast("long").alias("n_formulas"), "safe", F.col("error").isNotNull().alias("failed"))


@_query("id, k, part", [(0, 0, "ONE"), (0, 1, "f 0!"), (0, 2, ""), (1, 0, "x"), (1, 1, "y & z")])
def docx_write_fixture(spark):
    """Files with new texts, and files made of rows of paragraphs, read again."""
    files = spark.createDataFrame([(0, _package(DOCX))], "id long, content binary")
    new = spark.createDataFrame([(0, ["ONE", "f 0!", None])], "id long, texts array<string>")
    made = sinks.to_docx(spark.createDataFrame([(1, 1, "y & z"), (1, 0, "x")], "id long, para_idx int, paragraph string"), ["id"])
    both = sinks.into_docx(files, new, ["id"]).unionByName(made)
    # A formula that was written into a text is read as one again.
    return src.read_docx_rows(both, ["id"]).select("id", F.col("para_idx").cast("long").alias("k"), F.col("paragraph").alias("part"))


@_query("id, plain, html, rtf", [(0, "a<b\n\n中", '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>\n<p>a&lt;b</p>\n<p>中</p>\n</body></html>', "{\\rtf1\\ansi\\deff0\na<b\\par\n\\u20013?\\par\n}")])
def sinks_fixture(spark):
    rows = spark.createDataFrame([(0, 1, "中"), (0, 0, "a<b")], "id long, para_idx int, paragraph string")
    text = lambda df, name: df.withColumnRenamed("text", name)
    return text(sinks.to_text(rows, ["id"]), "plain").join(text(sinks.to_html(rows, ["id"]), "html"), "id").join(text(sinks.to_rtf(rows, ["id"]), "rtf"), "id")


@_query("id, k, part, size, heading", [(0, 0, "Title", 20.0, True), (0, 1, "first line", 10.0, False), (0, 2, "onnext page", 10.0, False), (0, 3, "goes on here", 10.0, False), (0, 4, "last", 10.0, False)])
def pdf_fixture(spark):
    glyphs = [(0, 1, 0, 0.0, 700.0, 20.0, False, "Title"), (0, 1, 1, 50.0, 660.0, 10.0, False, " line"), (0, 1, 2, 0.0, 660.5, 10.0, False, "first"), (0, 1, 3, 0.0, 630.0, 10.0, False, "on")]
    glyphs += [(0, 2, 0, 0.0, 700.0, 10.0, False, "next page"), (0, 2, 1, 0.0, 690.0, 10.0, False, " "), (0, 2, 2, 0.0, 688.0, 10.0, False, "goes on here"), (0, 2, 3, 0.0, 660.0, 10.0, False, "last")]
    runs = spark.createDataFrame(glyphs, "id long, page int, ord int, x double, y double, size double, bold boolean, text string")
    rows = src.read_pdf_glyphs(runs, ["id"])
    return rows.select("id", F.col("para_idx").cast("long").alias("k"), F.col("paragraph").alias("part"), "size", "heading")


@_query("category, title, entry_idx, name, url, desc, src, tag", [("c", "T", 0, "n0", "u0", "d0", "s0", "g"), ("c", "T", 1, "n1", "u1", None, None, None)])
def knowledge_fixture(spark):
    base = '{"categories":[{"id":"c","title":"T","entries":[{"name":"n0","url":"u0","desc":"d0","src":"s0","tag":"g"},{"name":"n1","url":"u1"}]}],"guides":[{"title":"G","items":["i","j"]}]}'
    rows = src.knowledge_entries(spark.createDataFrame([(base,)], "json string"))
    return rows.withColumn("entry_idx", F.col("entry_idx").cast("long"))


@_query("id, text, tasks, failed, change_count, full_tokens", [(0, "NEW。\n\n乙乙乙乙乙乙乙乙！\n\n", 1, 0, 2, 17), (1, "丙丙丙丙丙丙丙丙？丁", 1, 1, 1, 8)])
def refine_fixture(spark):
    """Paragraphs rewritten and, where they are still near their originals, refined by a stand-in for a service."""
    rows = [(0, 0, "甲甲甲甲甲甲甲甲。"), (0, 1, "乙乙乙乙乙乙乙乙！"), (0, 2, None), (1, 0, "丙丙丙丙丙丙丙丙？")]
    df = spark.createDataFrame(rows, "id long, para_idx int, paragraph string")
    change = {"甲甲甲甲甲甲甲甲。": ("甲甲甲甲甲甲甲甲甲。", 1), "丙丙丙丙丙丙丙丙？": ("丙丙丙丙丙丙丙丙？丁", 1)}
    found = refine.refine_documents(df, ["id"], lambda t: change.get(t, (t, 0)), lambda p: "NEW。" if "甲" in p else "")
    return found.select("id", "text", "tasks", "failed", "change_count", F.col("full_tokens"))


@_query("id, there, back", [(0, "甲。乙。", "甲。乙。"), (1, "", "")])
def translate_fixture(spark):
    """Each chunk goes to a stand-in for a service that swaps languages; no answer leaves it."""
    df = _texts(spark, ["甲。乙。", None])
    there = refine.translate(df, ["id", "text"], lambda c, a, b: "", "zh-CN", "en-GB").withColumnRenamed("translated", "there")
    return refine.back_translate(there, ["id", "there"], lambda c, a, b: c).select("id", "there", F.col("translated").alias("back"))


@_query("id, rounds, reached, change_count, text", [(0, "conservative", True, 0, "不变的一段话，没有词。\n\n"), (1, "ultra", False, 0, "不变的一段话，没有词。")])
def target_fixture(spark):
    """The document loop without a dictionary: one level where any rate will do, the strongest where none does."""
    rows = spark.createDataFrame([(0, 0, "不变的一段话，没有词。"), (0, 1, ""), (1, 0, "不变的一段话，没有词。")], "id long, para_idx int, paragraph string")
    tables = rewrite.Dictionaries()
    easy = rewrite.rewrite_documents(rows.where("id = 0"), ["id"], tables, rewrite.Options(seed=1, strength="conservative"), 101)
    hard = rewrite.rewrite_documents(rows.where("id = 1"), ["id"], tables, rewrite.Options(seed=1, strength="ultra"), 5)
    return easy.unionByName(hard).select("id", F.array_join(F.transform("rounds", lambda r: r["level"]), ",").alias("rounds"), "reached", F.col("change_count").cast("long").alias("change_count"), F.col("joined").alias("text"))


@_query("id, rate, sentences", [(0, "100.0%", 1), (1, "0.0%", 0), (2, "-", 0)])
def report_fixture(spark):
    same = "这是一个完全相同的句子，用来检查报告。"
    df = spark.createDataFrame([(0, same, same), (1, same, "别的内容与之毫无关系，abcdefgh。"), (2, same, "")], "id long, a string, b string")
    page = sinks.report(df, ["id"], "a", "b")
    tiles = F.regexp_extract_all("page", F.lit("<b>([^<]*)</b>"), F.lit(1))
    return page.select("id", F.get(tiles, 0).alias("rate"), F.get(tiles, 1).cast("long").alias("sentences"))


def random_numbers(spark: SparkSession) -> DataFrame:
    rows = [(seed, k, x) for seed in (1, 7, 4294967295) for k, x in zip(range(50), rewrite.uniform(seed))]
    return spark.createDataFrame(rows, "seed long, k long, x double")


QUERIES["random_numbers"] = lambda spark, _: random_numbers(spark)
# The generator in 64-bit integers: products are made of halves, so that nothing overflows.
_LOW = "4294967295"
_MUL = f"(((({{0}}) >> 16) * ({{1}}) & 65535) * 65536 + (({{0}}) & 65535) * ({{1}})) & {_LOW}"
ORACLES["random_numbers"] = f"""
WITH s AS (SELECT seed, k, (seed + (k + 1) * 1831565813) & {_LOW} AS a FROM (VALUES (1::BIGINT), (7), (4294967295)) v(seed), range(50) r(k)),
t AS (SELECT *, {_MUL.format('xor(a, a >> 15)', '(a | 1)')} AS t FROM s),
u AS (SELECT *, xor((t + ({_MUL.format('xor(t, t >> 7)', '(t | 61)')})) & {_LOW}, t) AS u FROM t)
SELECT seed, k, xor(u, u >> 14) / 4294967296::DOUBLE AS x FROM u"""


def self_overlap(spark: SparkSession) -> DataFrame:
    texts = ["甲", "一段不到二十字的话", "这是一段比较长的文字，用来看窗口在结尾处怎样落下来。", "ab" * 30]
    df = _texts(spark, texts).withColumn("other", F.concat("text", F.lit("。")))
    return similarity.overlap_rate(df, ["id"], "text", "text").select("id", "rate", F.col("total_windows").cast("long").alias("windows"))


QUERIES["self_overlap"] = lambda spark, _: self_overlap(spark)
ORACLES["self_overlap"] = _values("id, rate, windows", [(0, 1.0, 1), (1, 1.0, 1), (2, 1.0, 2), (3, 1.0, 5)])
