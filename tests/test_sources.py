from textloom.sources import documents, sinks


def test_rtf():
    assert documents.rtf_paragraphs(r"{\rtf1 a\par b\u20013?c\'41}") == ["a", "b中c"]
    assert documents.rtf_paragraphs(r"a\line b\pard c") == ["a", "e b", "d c"]
    assert documents.rtf_paragraphs(r"\u-100?x\{y") == ["xy"] and documents.rtf_paragraphs(None) == []
    text = sinks.rtf_document(["中a{b}"])
    assert "\\u20013?" in text and "\\{" in text and "\\u-" in sinks.rtf_document(["龥"])


def test_html():
    assert documents.html_blocks("<body><div>a<p>b  c</p></div></body>") == ["ab c", "b c"]
    assert documents.html_blocks("just &amp; text") == ["just & text"] and documents.html_blocks(None) == []


DOCX = (
    '<w:document><w:body><w:p><w:pPr><w:b/></w:pPr><w:r><w:t>one &amp;lt; </w:t><w:tab/><w:t>two</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>f </w:t></w:r><m:oMath><m:r>x</m:r></m:oMath></w:p><w:p><w:drawing></w:drawing></w:p><w:sectPr/></w:body></w:document>"
)


def test_docx():
    found, gaps = documents.docx_paragraphs(DOCX)
    assert [p["text"] for p in found] == ["one &lt;  two", "f \ue1000\ue101", ""]
    assert [p["safe"] for p in found] == [True, True, False] and found[1]["formulas"] == ["<m:oMath><m:r>x</m:r></m:oMath>"]
    assert "".join(x for pair in zip(gaps, [p["raw"] for p in found] + [""]) for x in pair) == DOCX


def test_docx_round_trip(spark):
    content = sinks.minimal_docx(["a < b", "第二段"])
    assert [p["text"] for p in documents.read_docx(content)[0]] == ["a < b", "第二段"]
    again = sinks.rebuild_docx(content, [None, "new & old"])
    assert [p["text"] for p in documents.read_docx(again)[0]] == ["a < b", "new & old"]
    rows = documents.read_docx_rows(spark.createDataFrame([("p", bytearray(again))], "path string, content binary"), ["path"]).collect()
    assert [(r.para_idx, r.paragraph) for r in rows] == [(0, "a < b"), (1, "new & old")]


def test_files_to_text_and_back(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p><p>y</p>", encoding="utf-8")
    files = documents.files(spark, str(tmp_path), "*.html")
    rows = documents.read_html(files, ["path"])
    assert sinks.to_text(rows, ["path"]).first().text == "x\n\ny"
    assert "<p>x</p>\n<p>y</p>" in sinks.to_html(rows, ["path"]).first().text


def test_pdf_lines():
    lines = documents.pdf_lines([(10, 700, 12, False, "b"), (0, 700.5, 12, False, "a "), (0, 650, 14, True, "c")])
    assert [(n["text"], n["size"]) for n in lines] == [("a b", 12), ("c", 14)]


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "self_duplicates" in entry.queries()


def test_stream(spark, tmp_path):
    from textloom.operators import segment
    from textloom.streaming.stateless import over_stream

    df = spark.createDataFrame([(1, "a。b。"), (2, "c")], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    query = over_stream(spark, str(tmp_path / "in"), df.schema, segment.sentence_rows).writeStream.format("memory").queryName("sents").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("sents").count() == segment.sentence_rows(df).count() == 3
