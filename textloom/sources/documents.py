"""Readers: files to rows of paragraphs. Files come as Spark's ``binaryFile`` rows (``path, content``), from any store Spark reads."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import collapse_ws
from textloom.operators.segment import explode_rows, paragraphs
from textloom.operators.similarity import _SPACES, _WS, flat_map

# The elements whose text is a paragraph, and the ends of a formula's placeholder.
HTML_BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 blockquote tr".split())
FORMULA_OPEN, FORMULA_CLOSE = "\ue100", "\ue101"
UNSAFE = frozenset(("w:txbxContent", "w:drawing", "w:pict", "w:object", "w:subDoc"))
MATH = frozenset(("m:oMath", "m:oMathPara"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def text_paragraphs(df: DataFrame, text_col: str = "text") -> DataFrame:
    return explode_rows(df, paragraphs(F.col(text_col)), "para_idx", "paragraph")


def html_text(html: Column) -> Column:
    """The body's text by pattern alone, one paragraph: without scripts, styles and tags, with four entities decoded."""
    body = F.regexp_extract(html, r"(?i)<body[^>]*>([\s\S]*?)</body>", 1)
    body = F.when(html.rlike(r"(?i)<body[^>]*>[\s\S]*?</body>"), body).otherwise(html)
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", "<[^>]+>", "&nbsp;"):
        body = F.regexp_replace(body, pattern, " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return collapse_ws(body)


class _Blocks(HTMLParser):
    """Text of every block, an outer block with that of its inner ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.blocks: list[list[str]] = []
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        parts = [] if tag in HTML_BLOCKS else None
        if parts is not None:
            self.blocks.append(parts)
        self.open.append((tag, parts))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.all.append(data)
        for _, parts in self.open:
            if parts is not None:
                parts.append(data)


def html_blocks(text: str | None) -> list[str]:
    body = re.search(r"<body[^>]*>([\s\S]*?)</body>", text or "", re.I)
    parser = _Blocks()
    parser.feed(body[1] if body else text or "")
    parser.close()
    joined = (_SPACES.sub(" ", "".join(b)).strip(_WS) for b in (parser.blocks or [parser.all]))
    return [b for b in joined if b]


_RTF = re.compile(r"\\(?:(par|line)|u(-?\d+)(?:\\'[0-9a-fA-F]{2}|\?)?|[a-zA-Z]+(?:-?\d+)? ?|'[0-9a-fA-F]{2}|[\\{}]|)|[{}]|[^\\{}]+")


def rtf_paragraphs(text: str | None) -> list[str]:
    """Paragraphs of simple RTF. As in the application, what follows the four characters of ``\\par`` or ``\\lin`` is text."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if joined := "".join(run).strip(_WS):
            out.append(joined)
        run.clear()

    at, text = 0, text or ""
    while at < len(text):
        m = _RTF.match(text, at)
        at = m.end()
        if m[1]:
            end()
            at = m.start() + 4
            at += text.startswith(" ", at)
        elif m[2]:
            if int(m[2]) > 0:
                run.append(chr(int(m[2]) & 0xFFFF))
        elif m[0][0] not in "\\{}":
            run.append(m[0])
    end()
    return out


_XML = re.compile(r"<!--[\s\S]*?(?:-->|$)|<!\[CDATA\[[\s\S]*?(?:\]\]>|$)|<\?[\s\S]*?(?:\?>|$)|</\s*([^\s>]+)[^>]*>|<([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+")


def _character(number: int) -> str:
    """The character of a number; the replacement character for those that aren't any."""
    return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else "\ufffd"


def decode_entities(text: str) -> str:
    text = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: _character(int(m[1], 16)), text)
    text = re.sub(r"&#([0-9]{1,4000});", lambda m: _character(int(m[1])), text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&nbsp;", " ")):
        text = text.replace(entity, char)
    return text


def _events(xml: str):
    """(kind, name, start, end) with kind open, close, empty or text."""
    for m in _XML.finditer(xml):
        if m[1]:
            yield "close", m[1], m.start(), m.end()
        elif m[2]:
            yield "empty" if m[3].rstrip().endswith("/") else "open", m[2].rstrip("/"), m.start(), m.end()
        elif not m[0].startswith("<"):
            yield "text", "", m.start(), m.end()


def docx_paragraphs(xml: str) -> tuple[list[dict], list[str]]:
    """The paragraphs (raw, text, formulas, safe) of a ``document.xml``, and what lies between them."""
    found: list[dict] = []
    gaps: list[str] = []
    last = depth = math = 0
    now: dict = {}
    stack: list[str] = []
    start = math_start = 0
    for kind, name, a, b in _events(xml):
        if kind == "open" and name == "w:p":
            depth += 1
            if depth == 1:
                start, stack = a, []
                now = {"text": "", "formulas": [], "safe": True}
                gaps.append(xml[last:a])
        if not depth:
            continue
        if name in MATH and kind != "empty":
            math += 1 if kind == "open" else -1
            if kind == "open" and math == 1:
                math_start = a
            elif kind == "close" and math == 0:
                now["text"] += f"{FORMULA_OPEN}{len(now['formulas'])}{FORMULA_CLOSE}"
                now["formulas"].append(xml[math_start:b])
        elif math:
            pass
        elif kind == "open":
            now["safe"] = now["safe"] and name not in UNSAFE
            stack.append(name)
        elif kind == "empty":
            now["text"] += " " if name in ("w:tab", "w:br") else ""
        elif kind == "text":
            now["text"] += decode_entities(xml[a:b]) if stack and stack[-1] == "w:t" else ""
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
        if kind == "close" and name == "w:p":
            depth -= 1
            if depth == 0:
                found.append({"raw": xml[start:b], **now})
                last = b
    gaps.append(xml[last:])
    return found, gaps


def read_docx(content: bytes) -> tuple[list[dict], list[str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return docx_paragraphs(z.read("word/document.xml").decode("utf-8"))


def _decoded(reader: Callable[[str], list[str]]) -> Callable[[bytes | str | None], list[tuple]]:
    """A reader of file contents, or of texts, as rows of (index, paragraph)."""

    def rows(content: bytes | str | None) -> list[tuple]:
        text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")
        return list(enumerate(reader(text.removeprefix("\ufeff"))))

    return rows


def read_html(df: DataFrame, keep: list[str], content_col: str = "content") -> DataFrame:
    return flat_map(df, [content_col], keep, "para_idx int, paragraph string", _decoded(html_blocks))


def read_rtf(df: DataFrame, keep: list[str], content_col: str = "content") -> DataFrame:
    return flat_map(df, [content_col], keep, "para_idx int, paragraph string", _decoded(rtf_paragraphs))


def read_docx_rows(df: DataFrame, keep: list[str], content_col: str = "content") -> DataFrame:
    """``(*keep, para_idx, paragraph, formulas, safe, error)``; a file that can't be read is one row with index -1 and its error."""

    def rows(content: bytes | None) -> list[tuple]:
        try:
            return [(k, p["text"], p["formulas"], p["safe"], None) for k, p in enumerate(read_docx(bytes(content or b""))[0])]
        except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
            return [(-1, None, [], False, f"{type(e).__name__}: {e}")]

    return flat_map(df, [content_col], keep, "para_idx int, paragraph string, formulas array<string>, safe boolean, error string", rows)


def pdf_lines(glyphs: list[tuple[float, float, float, bool, str]], near: float = 1.6) -> list[dict]:
    """Lines of one page from glyph runs (x, y, size, bold, text): runs whose heights differ by at most ``near`` are a line."""
    lines: list[dict] = []
    for x, y, size, bold, text in glyphs:
        line = next((n for n in lines if abs(n["y"] - y) <= near), None)
        if line is None:
            lines.append(line := {"y": y, "parts": [], "size": size, "bold": bold})
        line["parts"].append((x, text))
        line["size"], line["bold"] = max(line["size"], size), line["bold"] or bold
    for line in lines:
        line["text"] = _SPACES.sub(" ", "".join(t for _, t in sorted(line["parts"], key=lambda p: p[0]))).strip(_WS)
    return sorted((n for n in lines if n["text"]), key=lambda n: -n["y"])


#: Points of a font when nothing is known; how much larger than the mean a heading is; lines' distance that ends a
#: paragraph, in sizes; points by which lines of a paragraph may differ.
PLAIN_SIZE, HEADING, FAR, ALIKE = 12.0, 1.12, 1.7, 2.0


def pdf_paragraphs(pages: list[list[dict]]) -> list[tuple[str, float, bool]]:
    """(text, size, heading) of a document's paragraphs from its pages' lines.

    Headings stand alone. A line of text goes on with the paragraph before it, on the page before too, if their sizes
    are alike and it isn't the last before a gap, a heading or the page's end.
    """
    lines = [line for page in pages for line in page]
    mean = sum(n["size"] for n in lines) / len(lines) if lines else PLAIN_SIZE
    out: list[list] = []
    for page in pages:
        for line, after in zip(page, [*page[1:], None]):
            size = line["size"]
            heading = size > mean * HEADING or bool(line["bold"] and size >= mean)
            ends = after is None or line["y"] - after["y"] > size * FAR or (not heading and after["size"] > mean * HEADING)
            if not heading and not ends and out and not out[-1][2] and abs(out[-1][1] - size) <= ALIKE:
                out[-1][:2] = out[-1][0] + line["text"], max(out[-1][1], size)
            else:
                out.append([line["text"], size, heading])
    return [tuple(x) for x in out]


def read_pdf_glyphs(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, para_idx, paragraph, size, heading, mean_size)`` from rows ``page, ord, x, y, size, bold, text`` of glyph runs.

    A document's runs are gathered in one row; ``ord`` is their order on a page.
    """
    run = F.struct("page", "ord", "x", "y", "size", "bold", "text")
    docs = df.groupBy(*keys).agg(F.array_sort(F.collect_list(run)).alias("runs__"))

    def rows(runs: list) -> list[tuple]:
        pages: dict[int, list] = {}
        for r in runs:
            if (r["text"] or "").strip(_WS):
                pages.setdefault(r["page"], []).append((r["x"], r["y"], r["size"] or PLAIN_SIZE, bool(r["bold"]), r["text"]))
        lines = [pdf_lines(pages[k]) for k in sorted(pages)]
        sizes = [n["size"] for page in lines for n in page]
        mean = sum(sizes) / len(sizes) if sizes else PLAIN_SIZE
        return [(k, *p, mean) for k, p in enumerate(pdf_paragraphs(lines))]

    return flat_map(docs, ["runs__"], keys, "para_idx int, paragraph string, size double, heading boolean, mean_size double", rows)


KNOWLEDGE = "categories array<struct<id:string,title:string,desc:string,entries:array<struct<name:string,url:string,desc:string,src:string,tag:string>>>>, guides array<struct<title:string,items:array<string>>>"


def knowledge_entries(df: DataFrame, json_col: str = "json") -> DataFrame:
    """``(category, title, entry_idx, name, url, desc, src, tag)`` of knowledge bases, a JSON text each."""
    cats = df.select(F.explode(F.from_json(F.col(json_col), KNOWLEDGE)["categories"]).alias("c"))
    rows = cats.select(F.col("c.id").alias("category"), F.col("c.title").alias("title"), F.posexplode("c.entries").alias("entry_idx", "e"))
    return rows.select("category", "title", "entry_idx", "e.*")


def knowledge_guides(df: DataFrame, json_col: str = "json") -> DataFrame:
    """``(guide, item_idx, item)`` of knowledge bases."""
    guides = df.select(F.explode(F.from_json(F.col(json_col), KNOWLEDGE)["guides"]).alias("g"))
    return guides.select(F.col("g.title").alias("guide"), F.posexplode("g.items").alias("item_idx", "item"))
