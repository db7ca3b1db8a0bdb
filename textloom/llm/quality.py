"""Quality rules with the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (white space runs to one blank, letters lower-cased, digit
runs to one 0) and hashed. For each host, the documents' ``source``, each line's
distinct documents are counted; documents with equal texts count once, so that a
document doesn't fall for its own copies. A line is boilerplate of its host if
it is in at least ``min_docs`` of the host's distinct documents and in more than
``max_share`` of them, or in more than ``max_docs`` whatever their share. A document is depleted if the boilerplate lines leave it
fewer than ``min_words`` words or less than ``min_left`` of its words. Such
documents and those that break a rule are rejected; from the others
``quality_texts`` removes the boilerplate lines.

The texts are read once. What goes on from there is a row of numbers for each
document, with 24 bytes for each of its lines: texts and lines are told apart by
hashes of 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_SPACE, cut, fresh, table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Texts that are rejected or lose lines are broadcast up to this many, and joined beyond.
BROADCAST_ROWS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often or deep in lambdas ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def repeat_words(words: Column) -> Column:
    """Words in windows of five words that occur at least twice in the text, the first occurrence included."""

    def windows(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, at(i, 1), at(i, 2), at(i, 3), at(i, 4)))

    def covered(z: Column) -> Column:
        """z: (hash, position), sorted."""
        hash_at = lambda k: F.get(z, k)["x"]
        twice = F.filter(z, lambda e, k: F.coalesce((hash_at(k - 1) == e["x"]), F.lit(False)) | F.coalesce((hash_at(k + 1) == e["x"]), F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)).cast("long")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(ASCII_SPACE))), SPACES, " "), "[0-9]+", "0")


def key_of(text: Column) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def line_facts(text: Column) -> Column:
    """For each line with a word: (the normalised line's hashes, number of words)."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    return F.transform(lines, lambda x: let(normalised(x), lambda y: F.struct(*key_of(y), (F.length(y) - F.length(F.replace(y, F.lit(" "))) + 1).alias("w"))))


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines whose normalised form has one of the ``keys``; lines without a word stay."""
    gone = lambda x: (F.btrim(x, F.lit(ASCII_SPACE)) != "") & F.array_contains(keys, let(normalised(x), lambda y: F.struct(*key_of(y))))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~gone(x)), "\n")


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("a"), host), F.lit("b"))


def base_rules(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    facts = let(
        words_of(F.col(text_col)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    return df.select(
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        F.xxhash64(text).alias("t"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        facts.alias("f"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        line_facts(F.col(text_col)).alias("lines"),
    )


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    min_docs: int = 10,
    max_share: float = 0.05,
    max_docs: int = 1000,
    min_words: int = 10,
    min_left: float = 0.3,
) -> DataFrame:
    """``(id, host, t, t2, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_above, above)``, a row for each row of ``df``.

    ``t, t2`` are the text's hashes, ``n_above`` the number of its boilerplate
    lines, ``above`` their keys, null where it has none. Null and empty texts
    have no words and fail; null hosts are one host; rows with equal host and
    text share one verdict; an empty table gives an empty result. Other columns
    of ``df`` don't matter, whatever their names.
    """
    docs = cut(base_rules(df, id_col, host_col, text_col))
    host = host_key(F.col("host"))
    texts = docs.select(host.alias("host"), "t", "t2", "lines").dropDuplicates(["host", "t", "t2"])
    many = texts.groupBy("host").agg(F.count("*").alias("n_docs"))
    lines = texts.select("host", "t", "t2", F.explode("lines").alias("l")).select("host", "t", "t2", "l.h", "l.g", "l.w")
    once = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))).alias("k")).select("host", "k.h", "k.g")
    often = once.groupBy("host", "h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    limit = F.least(F.col("n_docs") * F.lit(float(max_share)), F.lit(float(max_docs)))
    above = often.join(many, "host").where(F.col("n") > limit).select("host", "h", "g")
    key = F.struct("h", "g")
    lost = lines.join(above, ["host", "h", "g"]).groupBy("host", "t", "t2").agg(F.sum("w").alias("lost"), F.count("*").alias("n_above"), F.collect_set(key).alias("above"))
    lost = lost.select(F.col("host").alias("host__"), F.col("t").alias("t__"), F.col("t2").alias("t2__"), "lost", "n_above", "above")
    found = docs.select("id", "host", "t", "t2", "f.*", "n_symbols", "n_dup_lines").withColumn("key__", host)
    found = found.join(lost, (F.col("key__") == F.col("host__")) & (F.col("t") == F.col("t__")) & (F.col("t2") == F.col("t2__")), "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("lost").isNotNull() & ((left < min_words) | (left < F.col("n_words") * F.lit(float(min_left))))
    facts = ["id", "host", "t", "t2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*facts, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("n_above", F.lit(0)).alias("n_above"), "above")


def quality_texts(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, their text without the boilerplate lines of their host.

    All columns are kept, whatever their names; an empty table gives an empty result.
    """
    host, one, two, kept, above = fresh(df.columns, "host__", "t__", "t2__", "kept__", "above__")
    verdicts = quality_rules(df, id_col, host_col, text_col, **limits).where(~F.col("kept") | F.col("above").isNotNull())
    verdicts = verdicts.select(host_key(F.col("host")).alias(host), F.col("t").alias(one), F.col("t2").alias(two), F.col("kept").alias(kept), F.col("above").alias(above))
    verdicts = cut(verdicts.dropDuplicates([host, one, two]))
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    t, t2 = key_of(F.coalesce(F.col(text_col), F.lit("")))
    found = df.join(verdicts, (host_key(F.col(host_col)) == F.col(host)) & (t == F.col(one)) & (t2 == F.col(two)), "left").where(F.coalesce(kept, F.lit(True)))
    rest = F.when(F.col(above).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col(above)))
    return found.withColumn(text_col, rest).select(*df.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_above").alias("n_lines_above"))


def quality_text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without the lines above the limit: ``doc_id, n_chars, text_sha256``."""
    found = quality_texts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_VERDICTS = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM d),
g5 AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM g),
twice AS (SELECT doc_id, i FROM g5 QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
gap AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS n FROM twice),
rep AS (SELECT doc_id, sum(n) AS n FROM gap GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, host, text, line,
         regexp_replace(regexp_replace(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS k,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS n_docs FROM d GROUP BY host),
above AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM ln GROUP BY host, k) JOIN hosts USING (host)
  WHERE n >= 10 AND n > least(n_docs * 0.05::DOUBLE, 1000)),
lost AS (SELECT doc_id, sum(w) AS n, count(*) AS lines FROM ln JOIN above USING (host, k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         cast(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost.n AS lost, cast(coalesce(lost.lines, 0) AS BIGINT) AS n_lines_above
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
verdict AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND NOT (lost IS NOT NULL AND (n_words - lost < 10 OR n_words - lost < n_words * 0.3::DOUBLE)) AS kept, n_lines_above
  FROM v)
"""
OP9_SQL = _VERDICTS + "SELECT * FROM verdict"
TEXTS_SQL = (
    _VERDICTS
    + r"""
, rest AS (
  SELECT doc_id, i, line, coalesce(above.k IS NOT NULL, false) AS gone
  FROM (SELECT *, regexp_replace(regexp_replace(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS k
        FROM (SELECT doc_id, host, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d))
  LEFT JOIN above USING (host, k)),
joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM rest GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM joined JOIN verdict USING (doc_id) WHERE kept"""
)
