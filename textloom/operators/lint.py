"""Style rules over text: a row for each issue, and counts by type."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.similarity import _WS, flat_map

# Fixed values: (type, pattern, reason, suggestion) of each rule, in order.
RULES = (
    ("colloquial", "非常之", "口语化表达", "改为“极其/十分”"),
    ("colloquial", "特别特别|非常非常", "重复强调，口语化", "去掉重复，改为“非常/极为”"),
    ("colloquial", "好多|挺多|挺大|蛮好|蛮大", "口语化表达", "改为“许多/较多/相当大”"),
    ("colloquial", "很(大|好|快|多)的", "“很+形容词”偏口语", "改为“较大的/良好的/较快的/较多的”"),
    ("colloquial", "越来越", "口语化程度表达", "改为“日益/逐渐/不断”"),
    ("colloquial", "其实|真的|确实很", "口语化语气词", "学术写作中通常可直接删除或改“事实上/诚然”"),
    ("colloquial", "有点|有点儿|稍微有点", "口语化程度表达", "改为“略有/稍显/一定程度地”"),
    ("colloquial", "啥|咋|咋样|搞", "口语词汇", "使用规范书面语替代"),
    ("colloquial", "等等等等", "重复冗余", "保留一个“等”即可"),
    ("redundant", "进行(了|着)?(分析|研究|处理|计算|检测|测试|讨论|比较|优化|评估)", "“进行+动词”冗余结构", "直接使用动词，如“进行分析”→“分析”"),
    ("redundant", "加以(分析|研究|处理|解决|说明|讨论|改进)", "“加以+动词”冗余结构", "直接使用动词，如“加以分析”→“分析”"),
    ("redundant", "能够被", "“能够被”冗余被动", "改为“可以被/得以”或直接被动"),
    ("redundant", "在…的过程中", "套话冗余", "多数情况可删除，直接叙述动作"),
    ("redundant", "具有一定的(作用|意义|价值|影响)", "“具有一定的”套话", "改为“具有重要作用/意义”或具体化"),
)
LONG = ("long", "超长句", "建议拆分为 2~3 个短句（超过 80 字）")
MOST, SHOWN = 80, 60


def issues_of(text: str | None) -> list[tuple[str, str, int, str, str]]:
    """(type, text, index, reason, suggestion) in order of place; long sentences, index -1, count as place 1."""
    if not text or not text.strip(_WS):
        return []
    found = [(kind, m[0], m.start(), reason, advice) for kind, pattern, reason, advice in RULES for m in re.finditer(pattern, text)]
    for sentence in re.split("[。！？；]", text):
        s = sentence.strip(_WS)
        if len(s) > MOST:
            found.append((LONG[0], f"{s[:SHOWN]}…（全句 {len(s)} 字）", -1, *LONG[1:]))
    return sorted(found, key=lambda x: 1 if x[2] == -1 else x[2])


def issues(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    return flat_map(df, [text_col], keep, "issue_idx int, type string, issue string, index int, reason string, suggestion string", lambda t: [(k, *x) for k, x in enumerate(issues_of(t))])


def count_by_type(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(keys or []), "type").agg(F.count("*").alias("n"))
