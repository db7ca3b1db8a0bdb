"""Rows of sentences, windows, chunks and paragraphs. None of them shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import JSWS, SENTENCE, WS_CHARS, clean, trim_ws

#: Characters and stride of a window; least length of a sentence that is compared.
WINDOW, STRIDE, LEAST = 20, 10, 8


def explode_rows(df: DataFrame, array: Column, pos: str, value: str) -> DataFrame:
    """``df`` with a row for each element. The outer form keeps the optimizer from computing the array a second time in a filter."""
    return df.select("*", F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def split_sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SENTENCE})"), F.lit(1))


def check_sentences(text: Column) -> Column:
    """Trimmed sentences of at least eight characters."""
    return F.filter(F.transform(split_sentences(text), trim_ws), lambda s: F.length(s) >= LEAST)


def windows(text: Column, size: int = WINDOW, step: int = STRIDE) -> Column:
    """Windows at each step, and the last ``size`` characters unless they equal the last window."""
    n = F.length(text)
    full = F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    tail = F.when(n > size, F.substring(text, n - size + 1, F.lit(size))).otherwise(text)
    same = F.coalesce(F.try_element_at(full, F.lit(-1)) == tail, F.lit(False))
    return F.when(same | (n == 0), full).otherwise(F.concat(full, F.array(tail)))


def sentence_rows(df: DataFrame, text_col: str = "text", checked: bool = False) -> DataFrame:
    split = check_sentences if checked else split_sentences
    return explode_rows(df, split(F.col(text_col)), "sent_idx", "sentence")


def window_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    cleaned = df.withColumn("clean__", clean(F.coalesce(F.col(text_col), F.lit(""))))
    return explode_rows(cleaned, windows(F.col("clean__")), "win_idx", "window").drop("clean__")


def chunks(text: Column, limit: int = 380) -> Column:
    """Sentences packed greedily up to ``limit`` characters; a longer sentence stays whole; trimmed, without empty ones."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "(?<=[。！？；.!?;\n])", -1), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        over = (F.length(acc["open"]) + F.length(s) > limit) & (acc["open"] != "")
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(over, s).otherwise(F.concat(acc["open"], s)).alias("open"),
        )

    packed = F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.filter(F.transform(packed, trim_ws), lambda c: c != "")


_PIECES = re.compile("[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+")


def chunk_list(text: str | None, limit: int = 380) -> list[str]:
    """As ``chunks``, for one text; linear in its length."""
    packed, size = [[]], 0
    for piece in _PIECES.findall(text or ""):
        if size and size + len(piece) > limit:
            packed.append([])
            size = 0
        packed[-1].append(piece)
        size += len(piece)
    return [c for c in ("".join(x).strip(WS_CHARS) for x in packed) if c]


def chunk_rows(df: DataFrame, keep: list[str], text_col: str = "text", limit: int = 380) -> DataFrame:
    """``(*keep, chunk_idx, chunk)``. The column ``chunks`` copies its list for every chunk, which long texts feel; this doesn't."""
    from textloom.operators.similarity import flat_map

    return flat_map(df, [text_col], keep, "chunk_idx int, chunk string", lambda t: list(enumerate(chunk_list(t, limit))))


def clauses(sentence: Column) -> Column:
    return F.split(sentence, "，", -1)


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text: lines up to an empty one, without white space at their ends, joined by a blank."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n", "\n")
    body = F.regexp_replace(body, f"[{JSWS}&&[^\\n]]+\\n", "\n")
    groups = F.split(body, f"\\n(?:[{JSWS}]*\\n)+", -1)
    return F.filter(F.transform(groups, lambda g: trim_ws(F.replace(g, F.lit("\n"), F.lit(" ")))), lambda g: g != "")


def refine_paragraphs(text: Column) -> Column:
    """Paragraphs between empty lines, trimmed, without empty ones; the whole text where there are none."""
    found = F.filter(F.transform(F.split(text, f"\\r?\\n[{JSWS}]*\\r?\\n", -1), trim_ws), lambda p: p != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def export_paragraphs(text: Column) -> Column:
    """Paragraphs for a file: lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n+", -1), trim_ws), lambda p: p != "")


def systematic_sample(df: DataFrame, n: Column, pos: str, most: int = 1500) -> DataFrame:
    """Every k-th row, k the least number that leaves ``most`` of ``n`` rows; all rows up to ``most``."""
    return df.where(F.col(pos) % F.greatest(F.ceil(n / most), F.lit(1)) == 0)


def compare_positions(left: DataFrame, right: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(key, sent_idx, left, right, same)``: the sentences of two texts side by side; a missing one is empty."""
    a = sentence_rows(left.select(key, text_col), text_col).select(key, "sent_idx", F.col("sentence").alias("left"))
    b = sentence_rows(right.select(key, text_col), text_col).select(key, "sent_idx", F.col("sentence").alias("right"))
    both = a.join(b, [key, "sent_idx"], "full")
    text = lambda c: F.coalesce(c, F.lit(""))
    return both.select(key, "sent_idx", text("left").alias("left"), text("right").alias("right"), (text("left") == text("right")).alias("same"))
