"""Writers: rows of paragraphs back to one file content for each document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import escape_html
from textloom.operators import lint, similarity
from textloom.sources.documents import FORMULA_CLOSE, FORMULA_OPEN, docx_paragraphs


def ordered_join(df: DataFrame, keys: list[str], pos: str, text: Column, separator: str, out: str = "text") -> DataFrame:
    """One row for each key, its texts joined in order of ``pos``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias(out))


def to_text(df: DataFrame, keys: list[str], pos: str = "para_idx", text_col: str = "paragraph") -> DataFrame:
    return ordered_join(df, keys, pos, F.col(text_col), "\n\n")


def to_html(df: DataFrame, keys: list[str], pos: str = "para_idx", text_col: str = "paragraph") -> DataFrame:
    joined = ordered_join(df, keys, pos, F.concat(F.lit("<p>"), escape_html(F.col(text_col)), F.lit("</p>")), "\n")
    shell = '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>\n'
    return joined.withColumn("text", F.concat(F.lit(shell), "text", F.lit("\n</body></html>")))


def filled(new: Column, old: Column) -> Column:
    """The new text, or the old one where there is none."""
    return F.coalesce(new, old)


def rtf_document(paragraphs: Sequence[str]) -> str:
    def code(c: str) -> str:
        n = ord(c)
        if c in "\\{}":
            return "\\" + c
        return c if n < 128 else f"\\u{n - 0x10000 if n > 0x7FFF else n}?"

    return "{\\rtf1\\ansi\\deff0\n" + "\n".join("".join(map(code, p)) + "\\par" for p in paragraphs) + "\n}"


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


PROPERTIES = frozenset(("w:pPr", "w:sectPr"))


def _properties(raw: str) -> str:
    """The property elements of a paragraph as they stand in it."""
    data, spans, inside = raw.encode("utf-8"), [], []
    parser = expat.ParserCreate()

    def begin(name: str, _) -> None:
        if inside or name in PROPERTIES:
            inside.append(parser.CurrentByteIndex)

    def end(_) -> None:
        if inside:
            start, tag = inside.pop(), parser.CurrentByteIndex
            if not inside and data.startswith(b"</", tag):  # an empty element says nothing
                spans.append(data[start : data.index(b">", tag) + 1])

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        return ""
    return b"".join(spans).decode("utf-8")


def _rebuilt(paragraph: dict, text: str) -> str:
    """The paragraph with its properties, one run of the new text, and its formulas in their places."""
    formulas = dict(enumerate(paragraph["formulas"]))
    body = re.sub(f"{FORMULA_OPEN}([0-9]+){FORMULA_CLOSE}", lambda m: formulas.get(int(m[1]), ""), _escape(text))
    return f'<w:p>{_properties(paragraph["raw"])}<w:r><w:t xml:space="preserve">{body}</w:t></w:r></w:p>'


def rebuild_docx(content: bytes, texts: Sequence[str | None]) -> bytes:
    """The document with new texts; a paragraph without one stays as it is, as does all between paragraphs."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item)
            if item.filename == "word/document.xml":
                found, gaps = docx_paragraphs(data.decode("utf-8"))
                new = [*texts, *[None] * (len(found) - len(texts))]
                parts = [gaps[0]]
                for p, text, gap in zip(found, new, gaps[1:]):
                    parts += [p["raw"] if text is None else _rebuilt(p, text), gap]
                data = "".join(parts).encode("utf-8")
            w.writestr(zipfile.ZipInfo(item.filename, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def minimal_docx(paragraphs: Sequence[str]) -> bytes:
    """A word-processing document of plain paragraphs."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{body}<w:sectPr/></w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{main}"/>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/styles" Target="styles.xml"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _gathered(df: DataFrame, keys: list[str], pos: str, text_col: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text_col).alias("t"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["t"]).alias("texts__"))


def to_rtf(df: DataFrame, keys: list[str], pos: str = "para_idx", text_col: str = "paragraph") -> DataFrame:
    """``(*keys, text)``: an RTF document for each key."""
    return similarity.flat_map(_gathered(df, keys, pos, text_col), ["texts__"], keys, "text string", lambda t: [(rtf_document([x or "" for x in t]),)])


def to_docx(df: DataFrame, keys: list[str], pos: str = "para_idx", text_col: str = "paragraph") -> DataFrame:
    """``(*keys, content)``: a plain word-processing document for each key."""
    return similarity.flat_map(_gathered(df, keys, pos, text_col), ["texts__"], keys, "content binary", lambda t: [(minimal_docx([x or "" for x in t]),)])


def into_docx(files: DataFrame, texts: DataFrame, keys: list[str], content_col: str = "content", texts_col: str = "texts") -> DataFrame:
    """``(*keys, content)``: the files with new texts, an array for each (null: the paragraph stays); files without an array stay as they are."""
    both = files.select(*keys, F.col(content_col).alias("content__")).join(texts.select(*keys, F.col(texts_col).alias("texts__")), keys, "left")
    return similarity.flat_map(both, ["content__", "texts__"], keys, "content binary", lambda c, t: [(bytes(c) if t is None else rebuild_docx(bytes(c), t),)])


# Words of the report, how many rows its tables have, and the similarity of the sentences it lists.
REPORT_TITLE, REPORT_SENTENCES, REPORT_CHANGES, REPORT_ISSUES, REPORT_SIMILARITY = "论文降重自查报告", 20, 100, 30, 0.55
REPORT_STATS = ("改写文与原文估算重复率", "疑似高度相似句子（≥55%）", "原文内部重复句对", "写作规范问题")
REPORT_PARTS = ("一、疑似与原文高度相似的句子", "二、改写明细（前 100 条）", "三、写作规范检查")
REPORT_HEADS = (("相似度", "句子"), ("#", "原文片段", "改写后", "策略"))


def _table(head: Sequence[str], rows: Sequence[Sequence[str]], none: str) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in row) + "</tr>"
    return "<table>" + cells("th", head) + "".join(cells("td", r) for r in rows) + "</table>" if rows else f"<p>{none}</p>"


def report_page(original: str | None, rewritten: str | None, changes: Sequence[dict] | None = None, when: str = "") -> str:
    """A page on how much of a rewritten text repeats its original, with the changes and the style issues."""
    esc = lambda t: _escape(t or "").replace("&quot;", '"')
    estimate = similarity.overlap(original, rewritten)
    near = similarity.matched_sentences(original, rewritten, REPORT_SIMILARITY) if (rewritten or "").strip(similarity._WS) else []
    twice, found, changes = similarity.repeated_sentences(original), lint.issues_of(original), changes or []
    size = [len(similarity._SPACES.sub("", t or "")) for t in (original, rewritten)]
    figures = (f"{estimate[0] * 100:.1f}%" if estimate else "-", len(near), len(twice), len(found))
    stats = "".join(f'<div class="stat"><b>{v}</b>{name}</div>' for v, name in zip(figures, REPORT_STATS))
    tables = (
        _table(REPORT_HEADS[0], [(f"{v * 100:.0f}%", esc(s)) for _, v, s, _ in near[:REPORT_SENTENCES]], "未发现。"),
        _table(REPORT_HEADS[1], [(k, esc(c["old"]), esc(c["new"]), esc(c["type"])) for k, c in enumerate(changes[:REPORT_CHANGES], 1)], "无。"),
        "".join(f'<div class="issue"><b>{esc(t)}</b> — {reason}。建议：{esc(advice)}</div>' for _, t, _, reason, advice in found[:REPORT_ISSUES]) or "<p>未发现问题。</p>",
    )
    body = "".join(f"<h2>{name}</h2>{part}" for name, part in zip(REPORT_PARTS, tables))
    lead = f"<p>生成时间：{esc(when)} · 原文 {size[0]} 字 → 改写后 {size[1]} 字 · 改写/变换 {len(changes)} 处</p>"
    return f'<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"><title>{REPORT_TITLE}</title></head><body><h1>{REPORT_TITLE}</h1>{lead}{stats}{body}</body></html>'


def report(df: DataFrame, keep: list[str], original_col: str, rewritten_col: str, changes_col: str | None = None, when: str = "") -> DataFrame:
    """``(*keep, page)``: a report on each pair of texts."""
    columns = [original_col, rewritten_col, *([changes_col] if changes_col else [])]
    return similarity.flat_map(df, columns, keep, "page string", lambda *v: [(report_page(*v, when=when),)])
