from itertools import islice

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import lint, mask, refine, rewrite, segment, similarity

TEXT = "深度学习模型在图像分类任务上达到98.5%的准确率。实验结果表明，该方法能够被广泛应用；其实还有改进空间！最后使用Softmax输出。"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_windows_equal_the_plain_form(spark):
    for n in (0, 1, 19, 20, 21, 30, 39, 40, 41):
        for text in ("".join(chr(97 + k % 23) for k in range(n)), "ab" * (n // 2)):
            assert one(spark, segment.windows, text) == similarity.windows_of(text)


def test_bigrams_and_jaccard(spark):
    assert sorted(one(spark, tx.bigrams, "abab")) == ["ab", "ba"]
    assert one(spark, tx.bigrams, "a") == []
    row = spark.createDataFrame([("ab", "ab"), ("a", "b"), ("abc", "bcd")], "a string, b string")
    assert [r.s for r in row.select(tx.jaccard(tx.bigrams(F.col("a")), tx.bigrams(F.col("b"))).alias("s")).collect()] == [1.0, 1.0, 1 / 3]


def test_index_finds_what_all_pairs_find():
    sentences = [f"the quick brown fox {k % 7} jumps over {'x' * (k % 5)} the lazy dog" for k in range(40)]
    text = "\n".join(sentences)
    sets = [similarity.bigram_set(s) for s in similarity.checked_sentences(text)]
    plain = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similarity.similarity(sets[i], sets[j]) >= 0.85}
    assert {(i, j) for i, j, *_ in similarity.repeated_sentences(text, most=None)} == plain and plain
    rewritten = text.replace("lazy", "idle")
    scores = similarity.best_scores(text, rewritten, 2)
    rate, repeated, total = similarity.overlap(text, rewritten)
    assert (repeated, total) == (sum(x >= 0.8 for x in scores), len(scores)) and rate == repeated / total


def test_overlap_of_odd_texts():
    assert similarity.overlap("a", "b") == (1.0, 1, 1)
    assert similarity.overlap("", "b") is None and similarity.overlap(None, "x") is None and similarity.overlap("　", "x") is None
    assert similarity.overlap(TEXT, TEXT)[0] == 1


def test_self_duplicates_rows(spark):
    df = spark.createDataFrame([(1, TEXT + "\n" + TEXT), (2, None), (3, "")], "id int, text string")
    found = similarity.self_duplicates(df, ["id"]).collect()
    assert {r.id for r in found} == {1} and all(r.sim >= 0.85 for r in found) and len(found) >= 3


def test_sentence_report_takes_the_earliest(spark):
    df = spark.createDataFrame([("abcdefgh。abcdefgh。zzzzzzzzzz。", "abcdefgh。")], "o string, r string").withColumn("id", F.lit(1))
    row = similarity.sentence_report(df, ["id"], "o", "r").first()
    assert (row.sent_idx, row.sim, row.orig) == (0, 1.0, "abcdefgh。")


def test_chunks(spark):
    chunks = one(spark, lambda t: segment.chunks(t, 10), "一二三。四五六！七八九；十！" + "长" * 30 + "。")
    assert "".join(chunks) == "一二三。四五六！七八九；十！" + "长" * 30 + "。" and chunks[0] == "一二三。四五六！"
    assert one(spark, segment.chunks, "") == [] and one(spark, segment.chunks, None) == []


def test_paragraphs(spark):
    assert one(spark, segment.paragraphs, "a  \nb\r\n\r\n  \n c\n") == ["a b", "c"]
    assert one(spark, segment.paragraphs, None) == []


def test_mask_round_trip(spark):
    text = "设 $x^2$ 与 [1,2]，见表 3 和 Softmax，约 98.5% 或 20 km。"
    masked, items = mask.protect_text(text, ["见表"])
    assert mask.restore_text(masked, items) == text and "$x^2$" in items and "见表" in items and "98.5%" in items
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    back = mask.restore(mask.protect(df, ["id"]), ["id"])
    assert {r.id: r.text for r in back.collect()} == {1: text, 2: ""}
    assert [r.span for r in mask.spans(df.where("id = 1")).orderBy("span_idx").collect()] == mask.protect_text(text)[1]


def test_lint():
    found = lint.issues_of("其实我们进行了分析，" + "长" * 90)
    assert [x[0] for x in found] == ["colloquial", "long", "redundant"] and found[1][2] == -1
    assert lint.issues_of("") == [] and lint.issues_of(None) == [] and lint.issues_of("简洁。") == []


TABLES = rewrite.Dictionaries(
    synonyms={"方法": ["手段", "办法"], "实验": ["试验"], "模型": ["网络"]},
    conjunctions={"因此": ["由此"]},
    subjects={"我们": ["笔者"]},
    templates={"实验结果表明": ["试验显示"]},
    template_patterns=[("在(.{2,4})上", ["于$1之中"])],
    expansions=[("广泛", "较为广泛")],
    terms=["深度学习"],
)


def test_random_numbers():
    assert [round(x, 6) for x in islice(rewrite.uniform(1), 3)] == [round(x, 6) for x in islice(rewrite.uniform(1), 3)]
    assert all(0 <= x < 1 for x in islice(rewrite.uniform(7), 1000))


def test_rewriting_is_seeded_and_keeps_protected_spans(spark):
    options = rewrite.Options(seed=3, strength="ultra", expand=True)
    a, b = (rewrite.rewrite_text(TEXT, TABLES, options) for _ in range(2))
    assert a == b and a["text"] != TEXT and "98.5%" in a["text"] and "Softmax" in a["text"] and "深度学习" in a["text"]
    assert not set("\u0002\u0003\ue000\ue001") & set(a["text"])
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r for r in rewrite.rewrite(df, ["id"], TABLES, options).collect()}
    assert rows[1].rewritten == a["text"] and rows[1].change_count == len(a["changes"]) and rows[2].rewritten == rows[3].rewritten == ""


def test_target_loop():
    found = rewrite.rewrite_to_target(TEXT, TABLES, rewrite.Options(seed=1), 0)
    assert [x for x, _ in found["rounds"]] == ["standard", "strong", "ultra"] and not found["reached"]
    assert len(rewrite.rewrite_to_target(TEXT, TABLES, rewrite.Options(seed=1), 101)["rounds"]) == 1


def test_splitting_a_long_sentence():
    text = "一是甲，二是乙，因此丙，四是丁。"
    found = [rewrite.rewrite_text(text, TABLES, rewrite.Options(seed=s)) for s in range(1, 20)]
    assert any("。由此丙" in f["text"] or any(c[2] == "split" for c in f["changes"]) for f in found)


def test_refining(spark):
    df = spark.createDataFrame([("甲乙丙丁1234", "乙丙", "X"), ("abc", "zz", "X"), ("abc", "", "X")], "p string, s string, r string")
    got = [tuple(r.x) for r in df.select(tx.replace_first(F.col("p"), F.col("s"), F.col("r")).alias("x")).collect()]
    assert got == [("甲X丁1234", True), ("abc", False), ("abc", False)]
    assert one(spark, tx.estimate_tokens, "甲乙丙丁1234") == 5
    assert refine.splice("aXbX", [("X", "1"), ("Y", "2"), ("X", "3")]) == ("a1b3", 2)
    body = one(spark, lambda t: refine.openai_payload(F.lit("m"), F.lit("s"), t), "u")
    assert '"role":"user","content":"u"' in body
    assert one(spark, lambda t: refine.parse_response(F.lit("gemini"), t), '{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}') == "ab"
    assert one(spark, lambda t: refine.parse_response(F.lit("openai"), t), '{"choices":[{"message":{"content":"c"}}]}') == "c"


def test_settings(spark):
    assert [one(spark, tx.target_percent, x) for x in ("30", "x", None, "99", " 3", "12abc")] == [30, 25, 25, 60, 5, 12]
    assert one(spark, tx.custom_terms, " a\nb\r\n\na") == ["a", "b"]
    assert one(spark, lambda t: tx.pct(F.lit(0.256)), "") == "25.6%"
