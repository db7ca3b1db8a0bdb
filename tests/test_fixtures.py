"""The fixture queries give the rows their SQL lists, and some properties of the operators behind them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.operators import rewrite, segment, similarity
from textloom.plans import fixtures
from textloom.sources import documents, sinks


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_fixture(spark, name):
    found = fixtures.QUERIES[name](spark, "")
    want = duckdb.sql(fixtures.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_chunk_list_is_the_column(spark):
    texts = ["", "a" * 500 + ". b. c!", "一。" * 400, " x\n\n\ny ", "no end", None, "。。。" * 150]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("text", segment.chunks(F.col("text")).alias("c")).collect()
    assert all(segment.chunk_list(r.text) == list(r.c) for r in rows)


def test_vectorised_overlap_is_the_plain_one():
    import random

    rnd = random.Random(3)
    for _ in range(60):
        a = "".join(rnd.choices("abcdeé中", k=rnd.randint(1, 400)))
        b = "".join(c if rnd.random() < 0.97 else "z" for c in a) + "".join(rnd.choices("abc", k=rnd.randint(0, 60)))
        scores = similarity.best_scores(a, b, 2)
        assert similarity.overlap(a, b)[1:] == (sum(x >= 0.8 for x in scores), len(scores))


def test_sentence_match_by_index_is_the_plain_one():
    import random

    rnd = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta".split()
    make = lambda n: "。".join(" ".join(rnd.choices(words, k=rnd.randint(2, 6))) for _ in range(n)) + "。"
    for least in (0.1, 0.5, 0.8):
        a, b = make(30), make(30)
        own = similarity.checked_sentences(a)
        sets = [similarity.bigram_set(s) for s in own]
        want = []
        for i, s in enumerate(similarity.checked_sentences(b)):
            best, at = 0.0, -1
            for k, o in enumerate(sets):
                v = similarity.similarity(similarity.bigram_set(s), o)
                if v > best:
                    best, at = v, k
                    if best >= 0.98:
                        break
            if best >= least:
                want.append((i, best, s, own[at]))
        assert similarity.matched_sentences(a, b, least) == sorted(want, key=lambda x: (-x[1], x[0]))


def test_document_loop_lists_and_counts_changes(spark):
    tables = rewrite.Dictionaries(synonyms={"甲": ["乙"]})
    rows = [(1, k, "甲" * 30 + f"。尾{k}") for k in range(20)] + [(1, 20, None), (1, 21, "甲甲")]
    df = spark.createDataFrame(rows, "id int, para_idx int, paragraph string").withColumn("safe", F.col("para_idx") != 21)
    got = rewrite.rewrite_documents(df, ["id"], tables, rewrite.Options(seed=3, strength="ultra"), 1, safe=F.col("safe")).first()
    assert got.change_count > 400 and len(got.changes) == 400 and got.texts[20] is None and got.texts[21] is None and got.joined.endswith("甲甲")
    assert [r.level for r in got.rounds] == ["ultra"] and got.final_rate == got.rounds[0].rate
    assert rewrite.rewrite_documents(df, ["id"], tables, rewrite.Options(seed=3), None).first().reached is None


def test_report_lists(spark):
    page = sinks.report_page("其实很好。", "", [{"old": "<a>", "new": "b", "type": "synonym"}] * 150)
    assert page.count("<tr>") == 101 and "&lt;a&gt;" in page and page.count('class="issue"') == 1


def test_odd_characters():
    assert documents.decode_entities("&#x110000;&#xD800;&#65;&#x4e2d;&#" + "9" * 30 + ";") == "��A中�"
    found, _ = documents.docx_paragraphs("<w:p><w:pPr><w:x a='1>2'/></w:pPr><w:sectPr/><w:r><w:t>t</w:t></w:r></w:p>")
    assert sinks._rebuilt(found[0], "n&") == "<w:p><w:pPr><w:x a='1>2'/></w:pPr><w:r><w:t xml:space=\"preserve\">n&amp;</w:t></w:r></w:p>"
