"""What of a rewritten text is worth an external rewriting service, its cost, and putting answers back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import estimate_tokens
from textloom.operators.segment import chunk_list
from textloom.operators.similarity import _WS, flat_map, matched_sentences, sentence_report


def select_sentences(df: DataFrame, keep: list[str], original_col: str, rewritten_col: str, least: float = 0.55, max_tasks: int | None = None) -> DataFrame:
    """Sentences that are still near the original, the nearest ``max_tasks`` of each text; texts that weren't changed are not looked at."""
    changed = df.where(F.col(original_col) != F.col(rewritten_col))
    if max_tasks is None:
        return sentence_report(changed, keep, original_col, rewritten_col, least)
    return flat_map(changed, [original_col, rewritten_col], keep, "sent_idx int, sim double, sentence string, orig string", lambda a, b: matched_sentences(a, b, least)[:max_tasks])


def budget(tasks: DataFrame, texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(key, task_chars, task_tokens, full_tokens, saved_pct)``; the saving can be negative."""
    per = tasks.groupBy(key).agg(
        F.sum(F.length("sentence") + F.length("orig")).alias("task_chars"),
        F.sum(estimate_tokens(F.col("sentence")) + estimate_tokens(F.col("orig"))).alias("task_tokens"),
    )
    full = texts.select(key, estimate_tokens(F.col(text_col)).alias("full_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = full.join(per, key, "left").select(key, zero("task_chars"), zero("task_tokens"), "full_tokens")
    saved = F.floor((1 - F.col("task_tokens") / F.col("full_tokens")) * 100 + 0.5)
    return both.withColumn("saved_pct", F.when(F.col("full_tokens") > 0, saved).otherwise(0).cast("long"))


# Fixed value: the prompt.
_ASK = "。\n下面这个句子与原文高度相似，请改写以显著降低相似度。要求：1) 保持原意、数据、公式与专有名词完全不变；2) 使用同义词替换、语序调整、句式重组等手法；3) 只输出改写后的句子本身，不要任何解释或引号。\n原文："


def prompt(original: Column, candidate: Column, mode: Column) -> Column:
    return F.concat(F.lit("论文类型："), mode, F.lit(_ASK), original, F.lit("\n待改写："), candidate)


def prompt_text(original: str, candidate: str, mode: str) -> str:
    return f"论文类型：{mode}{_ASK}{original}\n待改写：{candidate}"


def openai_payload(model: Column, system: Column, user: Column, max_tokens: int = 4096) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), F.lit(0.9).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit(False).alias("stream")))


def anthropic_payload(model: Column, system: Column, user: Column, max_tokens: int = 4096) -> Column:
    return F.to_json(F.struct(model.alias("model"), system.alias("system"), F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_tokens")))


def gemini_payload(system: Column, user: Column, max_tokens: int = 4096) -> Column:
    part = lambda text: F.array(F.struct(text.alias("text"))).alias("parts")
    return F.to_json(
        F.struct(
            F.array(F.struct(F.lit("user").alias("role"), part(user))).alias("contents"),
            F.struct(part(system)).alias("systemInstruction"),
            F.struct(F.lit(0.9).alias("temperature"), F.lit(max_tokens).alias("maxOutputTokens")).alias("generationConfig"),
        )
    )


def parse_response(kind: Column, body: Column) -> Column:
    """The answer's text in a response of the kind openai, anthropic or gemini; null where there is none."""
    texts = lambda path: F.array_join(F.transform(F.from_json(F.get_json_object(body, path), "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return F.when(kind == "anthropic", texts("$.content")).when(kind == "gemini", texts("$.candidates[0].content.parts")).otherwise(F.get_json_object(body, "$.choices[0].message.content"))


def error_message(status: Column, message: Column, detail: Column, kind: Column | None = None) -> Column:
    # The messages.
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    out = F.when(status.isin(401, 403), said("API Key 无效或没有权限（HTTP ", status.cast("string"), "），请检查 Key 是否正确"))
    for code, text in ((429, "请求过于频繁或额度用尽（HTTP 429），请稍后再试或检查账户余额"), (404, "模型名称不存在（HTTP 404），请检查模型选择是否正确"), (402, "账户余额不足（HTTP 402）")):
        out = out.when(status == code, text)
    out = out.when(status == 400, said("请求被拒绝（HTTP 400）：", F.coalesce(detail, F.lit("参数有误"))))
    if kind is not None:
        out = out.when(kind == "cors", "浏览器跨域限制：请启动本地服务后再调用该服务商")
    network = "网络连接失败（服务商接口不可达或跨域限制），请检查网络，或使用本地服务模式"
    return out.when(F.coalesce(message, F.lit("")).rlike("(?i)fetch|network|TypeError"), network).otherwise(message)


# Price classes of models, and the labels of the classes.
PRICES = {
    "deepseek-chat": "cheap",
    "deepseek-reasoner": "mid",
    "gpt-4o-mini": "cheap",
    "gpt-3.5-turbo": "cheap",
    "gpt-4o": "mid",
    "gpt-4.1": "mid",
    "gpt-4.1-mini": "mid",
    "o3-mini": "mid",
    "claude-3-5-haiku-20241022": "cheap",
    "claude-sonnet-4-20250514": "mid",
    "claude-3-7-sonnet-20250219": "mid",
    "claude-opus-4-20250514": "high",
    "gemini-2.5-flash": "cheap",
    "gemini-2.0-flash": "cheap",
    "gemini-1.5-flash": "cheap",
    "gemini-2.5-pro": "mid",
    "gemini-1.5-pro": "mid",
}
PRICE_LABELS = {"cheap": "🟢 经济", "mid": "🟡 标准", "high": "🔴 高配", "unknown": "❔ 未知"}


def _entry(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def price_of(model: Column) -> Column:
    return F.coalesce(_entry(PRICES, model), F.lit("unknown"))


def price_label(model: Column) -> Column:
    return _entry(PRICE_LABELS, price_of(model))


def with_provider(df: DataFrame, id_col: str, providers: Sequence[dict[str, str]]) -> DataFrame:
    """``df`` with ``provider``, the entry of its id; the first one where there is none."""
    fields = [x for x in providers[0]]
    entries = [F.struct(*(F.lit(p.get(x)).alias(x) for x in fields)) for p in providers]
    found = entries[0]
    for p, entry in zip(reversed(providers), reversed(entries)):
        found = F.when(F.col(id_col) == p["id"], entry).otherwise(found)
    return df.withColumn("provider", found)


def call_service(df: DataFrame, keep: list[str], prompt_col: str, client: Callable[[str], str]) -> DataFrame:
    """``answer`` of the client for each prompt; the client runs on the executors and has to bear repeated calls."""
    return flat_map(df, [prompt_col], keep, "answer string", lambda p: [(client(p),)])


def splice(para: str, answers: list[tuple[str, str]]) -> tuple[str, int]:
    """The paragraph with the first occurrence of each sentence replaced by its answer, in order; and how many were."""
    done = 0
    for sentence, answer in answers:
        at = para.find(sentence) if sentence and answer else -1
        if at >= 0:
            para, done = para[:at] + answer + para[at + len(sentence) :], done + 1
    return para, done


def refine_text(text: str | None, rewritten: str | None, client: Callable[[str], str], mode: str = "通用学术论文", least: float = 0.55, max_tasks: int | None = None) -> tuple[str, list[tuple[str, str]], int]:
    """(the refined text, the sentences asked about with their originals, how many of them failed).

    A changed text's sentences that are still near the original go to ``client`` one by one; each answer replaces the
    sentence's first occurrence. An error of the client, or an answer that fits nowhere, counts as a failure.
    """
    refined = rewritten or text or ""
    if not text or refined == text:
        return refined, [], 0
    tasks = [(s, o) for _, _, s, o in matched_sentences(text, refined, least)[:max_tasks]]
    failed = 0
    for sentence, original in tasks:
        try:
            refined, done = splice(refined, [(sentence, client(prompt_text(original or sentence, sentence, mode)).strip())])
        except Exception:  # whatever a service does
            done = 0
        failed += not done
    return refined, tasks, failed


def refine_documents(df: DataFrame, keys: list[str], rewrite: Callable[[str], tuple[str, int]], client: Callable[[str], str], pos: str = "para_idx", text_col: str = "paragraph", **how) -> DataFrame:
    """A document's paragraphs rewritten, refined by a service and joined.

    ``rewrite`` gives a paragraph's new text and its number of changes. Returns ``(*keys, text, tasks, failed,
    change_count, task_tokens, full_tokens)``; paragraphs are worked on where they are, then joined by document.
    """

    def one(text: str | None) -> list[tuple]:
        new, changes = rewrite(text) if text and text.strip(_WS) else (text or "", 0)
        refined, tasks, failed = refine_text(text, new or text, client, **how)
        return [(text, refined, changes, [{"sentence": s, "orig": o} for s, o in tasks], failed)]

    rows = flat_map(df, [text_col], [*keys, pos], "old__ string, new__ string, changes int, asked array<struct<sentence:string,orig:string>>, failed int", one)
    tokens = F.aggregate("asked", F.lit(0).cast("long"), lambda n, t: n + estimate_tokens(t["sentence"]) + estimate_tokens(t["orig"]))
    rows = rows.withColumn("tokens__", tokens)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(c, F.lit("")).alias("t")))), lambda r: r["t"]), "\n\n")
    docs = rows.groupBy(*keys).agg(joined("new__").alias("text"), joined("old__").alias("old__"), F.sum(F.size("asked")).alias("tasks"), F.sum("failed").alias("failed"), F.sum("changes").alias("changes"), F.sum("tokens__").alias("task_tokens"))
    total = F.col("changes") + F.col("tasks") - F.col("failed")
    return docs.select(*keys, "text", "tasks", "failed", total.alias("change_count"), "task_tokens", estimate_tokens(F.col("old__")).alias("full_tokens"))


def translate_text(text: str | None, client: Callable[[str, str, str], str], source: str, target: str) -> str:
    """The text's chunks, translated and joined; a chunk without an answer stays."""
    return "".join((client(chunk, source, target) or "").strip() or chunk for chunk in chunk_list(text))


def translate(df: DataFrame, keep: list[str], client: Callable[[str, str, str], str], source: str, target: str, text_col: str = "text") -> DataFrame:
    return flat_map(df, [text_col], keep, "translated string", lambda t: [(translate_text(t, client, source, target),)])


def back_translate(df: DataFrame, keep: list[str], client: Callable[[str, str, str], str], own: str = "zh-CN", other: str = "en-GB", text_col: str = "text") -> DataFrame:
    """There and back again."""
    return flat_map(df, [text_col], keep, "translated string", lambda t: [(translate_text(translate_text(t, client, own, other), client, other, own),)])
