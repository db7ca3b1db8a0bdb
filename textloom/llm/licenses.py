"""Licence scans by a positional rare-token index, with DataFrame functions only.

Templates of licence notices are indexed by word: (template, place). The words'
inverse document frequencies are counted over the whole corpus and name each
template's two rarest words. A file is compared with a template only where it
holds the template's rarest word; each of its licence words then votes for the
place at which the template would start, and a template is found where its
rarest words agree on the start and every word of its mandatory key phrase
stands at its relative place. The score is the weight of the template's words
found there.

The base phrases are matched on the same positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import cut, table
from textloom.llm.quality import let

#: Phrases and their labels, as the contract fixes them.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and words of each template. "~" is any one word; "?" ends a word that isn't mandatory.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0 ~ license? ~ ~ ~ use? ~ file? except? ~ compliance?"),
    ("artistic", "artistic license 2? 0?"),
    ("bsd", "redistribution ~ use ~ source ~ binary forms ~ ~ ~ modification? ~ permitted? provided? ~ ~ following? conditions?"),
    ("bsl-1.0", "boost software license version? 1? 0?"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc0", "cc0 1? 0? universal?"),
    ("epl", "eclipse public license v? 2? 0?"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-2.0-or-later", "redistribute ~ ~ ~ modify ~ under ~ terms ~ ~ gnu general public license ~ published? ~ ~ free? software? foundation? ~ version 2 ~ ~ license? ~ ~ ~ option? ~ later version"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-3.0-or-later", "redistribute ~ ~ ~ modify ~ under ~ terms ~ ~ gnu general public license ~ published? ~ ~ free? software? foundation? ~ version 3 ~ ~ license? ~ ~ ~ option? ~ later version"),
    ("isc", "permission ~ use copy modify ~ ~ distribute ~ software ~ any purpose ~ ~ without fee ~ hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-text", "permission ~ hereby granted free ~ charge ~ any? person? obtaining? ~ copy? ~ ~ software? ~ associated? documentation? files?"),
    ("mpl-2.0", "mozilla public license version? 2? 0?"),
    ("unlicense", "released into ~ public domain"),
    ("zlib", "without ~ express ~ implied warranty ~ ~ event ~ ~ authors ~ held liable"),
)
#: Words too common to look a file up by.
COMMON = frozenset(
    "any authors by charge conditions copy distribute documentation domain event except fee file files following forms foundation free general held into later modify option permitted person provided public published "
    "purpose software source terms under use v version without 0 1 2 3 4".split()
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 2


def postings(templates: Sequence[tuple[str, str]]) -> list[tuple[str, int, str, bool]]:
    """(label, place, word, mandatory)"""
    return [(label, k, w.rstrip("?"), not w.endswith("?")) for label, words in templates for k, w in enumerate(words.split()) if w != "~"]


def split_words(lowered: Column, gap: str) -> Column:
    parts = F.split(lowered, gap, -1)
    return F.filter(F.when(lowered == "", F.array().cast("array<string>")).otherwise(parts), lambda w: w != "")


def _hits(text: Column, vocabulary: Sequence[str]) -> Column:
    """(place, word) of the licence words, in order; A-Z lower-cased and nothing else."""
    words = split_words(F.translate(text, UPPER, LOWER), NOT_WORD)
    return let(words, lambda w: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda e: e["w"].isin(*vocabulary)))


def _starts(hits: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """(place, label) of every place where a phrase stands."""

    def at(phrase: str, label: str) -> Column:
        words = phrase.split()

        def stands(x: Column, k: Column) -> Column:
            ok = x["w"] == words[0]
            for j, w in enumerate(words[1:], 1):
                nxt = F.get(hits, k + j)
                ok = ok & F.coalesce((nxt["w"] == w) & (nxt["i"] == x["i"] + j), F.lit(False))
            return ok

        return F.transform(F.filter(hits, stands), lambda x: F.struct(x["i"].alias("i"), F.lit(label).alias("l")))

    return F.concat(*(at(p, label) for p, label in phrases))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row for each row of ``df``.

    Null and empty texts have no words, no labels and score 0; rows equal in id
    and text get equal answers; an empty table gives an empty result.
    """
    spark = df.sparkSession
    index = postings(templates)
    in_phrases = {w for p, _ in phrases for w in p.split()}
    vocabulary = sorted({w for _, _, w, _ in index} | in_phrases)
    core = [w for w in vocabulary if w not in COMMON]
    for name, words in [*((label, {w for t, _, w, _ in index if t == label}) for label, _ in templates), *((p, set(p.split())) for p, _ in phrases)]:
        if not words & set(core):
            raise ValueError(f"{name} has no word to look it up by")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lit_words = F.array(*(F.lit(w) for w in vocabulary))
    seen = let(split_words(F.lower(text), NOT_WORD), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.array_intersect(lit_words, w).alias("present")))
    first = df.select(F.col(id_col).alias("id"), text.alias("text"), seen.alias("s"))
    some = F.arrays_overlap("s.present", F.array(*(F.lit(w) for w in core)))
    none = F.array().cast("array<struct<i:int,w:string>>")
    files = cut(first.select("id", F.xxhash64("text").alias("t"), "s.n_words", "s.present", F.when(some, _hits(F.col("text"), vocabulary)).otherwise(none).alias("hits")))

    # As many rows as the templates have words.
    found = {r.w: r.n for r in files.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label, _ in templates:
        own = [(k, w, must) for t, k, w, must in index if t == label]
        rare = sorted({w for _, w, must in own if must}, key=lambda w: (found.get(w, 0), w))[:ANCHORS]
        anchors = {next(k for k, w, _ in own if w == r) for r in rare}
        rows += [(label, k, w, k in anchors, must, found.get(w, 0), rare[0], len(anchors), sum(m for _, _, m in own)) for k, w, must in own]
    posting = spark.createDataFrame(rows, "label string, k int, w string, anchor boolean, must boolean, df long, rare string, n_anchors int, n_must int")
    posting = posting.withColumn("weight", F.expr(f"1 + ln({float(files.count() + 1)}D / (df + 1))"))
    total = posting.groupBy("label").agg(F.sum("weight").alias("total")).withColumnRenamed("label", "label__")
    posting = posting.join(total, F.col("label") == F.col("label__")).drop("label__")

    base = let(
        F.col("hits"),
        lambda h: let(
            _starts(h, phrases),
            lambda s: F.struct(
                F.size(s).cast("long").alias("n_base"),
                F.array_min(s["i"]).cast("long").alias("first_word"),
                F.array_max(s["i"]).cast("long").alias("last_word"),
                F.array_sort(F.array_distinct(s["l"])).alias("base"),
            ),
        ),
    )
    votes = files.where(F.size("hits") > 0).dropDuplicates(["id", "t"]).select("id", "t", "present", F.explode("hits").alias("h"))
    votes = votes.join(F.broadcast(posting), (F.col("h.w") == F.col("w")) & F.array_contains("present", F.col("rare")))
    agreed = votes.groupBy("id", "t", "label", (F.col("h.i") - F.col("k")).alias("start")).agg(
        F.count_if("anchor").alias("a"), F.count_if("must").alias("m"), F.first("n_anchors").alias("n_anchors"), F.first("n_must").alias("n_must"), F.sum("weight").alias("weight"), F.first("total").alias("total")
    )
    agreed = agreed.where("a = n_anchors and m = n_must")
    named = agreed.groupBy("id", "t").agg(F.collect_set("label").alias("more"), F.max(F.col("weight") / F.col("total")).alias("score"))
    named = named.select(F.col("id").alias("id__"), F.col("t").alias("t__"), "more", "score")
    out = files.select("id", "t", "n_words", base.alias("b")).join(named, F.col("id").eqNullSafe(F.col("id__")) & (F.col("t") == F.col("t__")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "id",
        "n_words",
        "b.n_base",
        "b.first_word",
        "b.last_word",
        F.array_join("b.base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b.base", more)), ",").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    values = ", ".join(f"('{t}', {k}, '{w}', {str(m).lower()})" for t, k, w, m in postings(TEMPLATES))
    phrase = " UNION ALL ".join(
        "SELECT a.doc_id, a.i, '" + label + "' AS l FROM h a " + " ".join(f"JOIN h b{j} ON b{j}.doc_id = a.doc_id AND b{j}.i = a.i + {j} AND b{j}.w = '{w}'" for j, w in enumerate(p.split()[1:], 1)) + f" WHERE a.w = '{p.split()[0]}'"
        for p, label in PHRASES
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, k, w, must) AS (VALUES {values}),
u AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM d),
h AS (SELECT * FROM u WHERE w IN (SELECT w FROM p) OR w IN ('license', 'mit', 'by', 'cc', 'apache', 'gnu', 'general', 'public')),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM h GROUP BY w),
q AS (SELECT p.*, coalesce(df, 0) AS df, 1 + ln((SELECT count(*) + 1 FROM d)::DOUBLE / (coalesce(df, 0) + 1)) AS weight FROM p LEFT JOIN df USING (w)),
r AS (SELECT label, w, min(k) AS k, row_number() OVER (PARTITION BY label ORDER BY min(df), w) AS n FROM q WHERE must GROUP BY label, w),
a AS (SELECT label, count(*) FILTER (WHERE n <= 2) AS n_anchors, min(w) FILTER (WHERE n = 1) AS rare FROM r GROUP BY label),
t AS (SELECT label, sum(weight) AS total, count(*) FILTER (WHERE must) AS n_must FROM q GROUP BY label),
v AS (
  SELECT h.doc_id, q.label, h.i - q.k AS start, sum(q.weight) AS weight, count(*) FILTER (WHERE q.must) AS m, count(r.k) AS a
  FROM h JOIN q ON h.w = q.w LEFT JOIN r ON r.label = q.label AND r.k = q.k AND r.n <= 2 GROUP BY ALL),
f AS (
  SELECT doc_id, label, max(weight / total) AS score FROM v JOIN t USING (label) JOIN a USING (label)
  WHERE v.m = t.n_must AND v.a = a.n_anchors AND (doc_id, rare) IN (SELECT (doc_id, w) FROM h) GROUP BY doc_id, label),
b AS ({phrase}),
bb AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT l, ',' ORDER BY l) AS ls FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS ls FROM (SELECT doc_id, l FROM b UNION SELECT doc_id, label FROM f) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(bb.n, 0) AS n_base, cast(bb.lo AS BIGINT) AS first_word, cast(bb.hi AS BIGINT) AS last_word,
       coalesce(bb.ls, '') AS base_labels, coalesce(al.ls, '') AS labels, round(coalesce(sc.score, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP10_SQL = _sql()
