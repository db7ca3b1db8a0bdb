"""The queries by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import lint, mask, refine, rewrite, segment, similarity
from textloom.plans import fixtures
from textloom.sources import documents as src

#: White space of the tables' texts, in RE2's terms, and the sentence pattern.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TRIM = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
SENTENCES = "regexp_extract_all(coalesce(text, ''), '[^。！？；\\r\\n]+[。！？；]?')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that is heavy on every row: one of fewer files than cores is dealt out to all of them."""
    df, cores = _table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def sentences(spark, d):
    return segment.sentence_rows(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")


def check_sentences(spark, d):
    return segment.sentence_rows(_table(spark, d, "documents").select("doc_id", "text"), checked=True).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")


def text_stats(spark, d):
    t = F.coalesce("text", F.lit(""))
    return _spread(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("length"), tx.non_ws_length(t).cast("long").alias("visible"), tx.cjk_count(t).cast("long").alias("cjk"), F.size(segment.split_sentences(t)).cast("long").alias("sentences"))


def token_estimate(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def windows(spark, d):
    return segment.window_rows(_table(spark, d, "benchmark").select("item_id", "text")).select("item_id", F.col("win_idx").cast("long").alias("win_idx"), "window", F.size(tx.bigrams(F.col("window"))).cast("long").alias("n_bigrams"))


def chunks(spark, d):
    found = segment.chunk_rows(_spread(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


def document_windows(spark, d):
    found = segment.window_rows(_spread(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("win_idx").cast("long").alias("win_idx"), "window")


#: Words that the invented texts hold, as a dictionary's keys.
DICTIONARY = ("the", "then", "der", "die", "und", "les", "le", "que", "tion")


def dictionary_hits(spark, d):
    return rewrite.dictionary_hits(_table(spark, d, "documents"), ["doc_id"], DICTIONARY)


def document_totals(spark, d):
    """The document loop over the lines of each document, with the words of a small dictionary."""
    rows = segment.sentence_rows(_table(spark, d, "documents").select("doc_id", "text")).withColumnRenamed("sent_idx", "para_idx").withColumnRenamed("sentence", "paragraph")
    tables = rewrite.Dictionaries(synonyms={w: [w.upper()] for w in DICTIONARY})
    found = rewrite.rewrite_documents(rows, ["doc_id"], tables, rewrite.Options(seed=1, strength="ultra"), 5)
    return found.select("doc_id", "reached", F.col("change_count").cast("long").alias("change_count"), F.size("changes").cast("long").alias("listed"))


def paragraphs(spark, d):
    return src.text_paragraphs(_table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.col("para_idx").cast("long").alias("para_idx"), "paragraph")


def self_duplicates(spark, d):
    found = similarity.self_duplicates(_spread(spark, d, "documents"), ["doc_id"])
    return found.select("doc_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("sim", 9).alias("sim"))


def overlap_rate(spark, d):
    """Each document against the next one."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    found = similarity.overlap_rate(docs.join(after.hint("merge"), "doc_id"), ["doc_id"], "text", "next")
    return found.select("doc_id", F.round("rate", 9).alias("rate"), F.col("dup_windows").cast("long").alias("dup_windows"), F.col("total_windows").cast("long").alias("total_windows"))


def _turn_pairs(spark, d):
    turns = _table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return turns.where("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"])


def sentence_top1(spark, d):
    """Each answer's sentences against the turn before, at a low threshold."""
    found = similarity.sentence_report(_turn_pairs(spark, d), ["conv_id", "turn"], "asked", "text", least=0.1)
    return found.select("conv_id", "turn", F.col("sent_idx").cast("long").alias("sent_idx"), F.round("sim", 9).alias("sim"), "orig")


def refine_budget(spark, d):
    pairs = _turn_pairs(spark, d).withColumn("pair", F.concat_ws("-", "conv_id", "turn"))
    tasks = refine.select_sentences(pairs, ["pair"], "asked", "text", 0.1)
    return refine.budget(tasks, pairs, "pair")


def sampled_sentences(spark, d):
    rows = segment.sentence_rows(_table(spark, d, "documents").select("doc_id", "text"), checked=True)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return segment.systematic_sample(rows.withColumn("n", n), F.col("n"), "sent_idx", 5).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"))


def mask_spans(spark, d):
    return mask.spans(_spread(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("span_idx").cast("long").alias("span_idx"), "span")


def mask_round_trip(spark, d):
    masked = mask.protect(_table(spark, d, "documents").select("doc_id", "text"), ["doc_id", "text"])
    back = mask.restore(masked.withColumn("original", F.col("text")), ["doc_id", "original", "items"])
    return back.select("doc_id", F.size("items").cast("long").alias("n_items"), (F.col("text") == F.col("original")).alias("equal"))


def html_text(spark, d):
    return _spread(spark, d, "pages").select("page_id", src.html_text(F.col("html")).alias("text"))


def html_paragraphs(spark, d):
    return src.read_html(_spread(spark, d, "pages"), ["page_id"], "html")


def lint_issues(spark, d):
    return lint.issues(_spread(spark, d, "documents"), ["doc_id"]).select("doc_id", F.col("issue_idx").cast("long").alias("issue_idx"), "type", F.col("index").cast("long").alias("index"), "issue")


def issues_by_type(spark, d):
    return lint.count_by_type(lint.issues(_table(spark, d, "documents"), ["doc_id"]))


def compare_positions(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    found = segment.compare_positions(docs, docs.select((F.col("doc_id") - 1).alias("doc_id"), "text").where("doc_id >= 0"), "doc_id")
    return found.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "left", "right", "same")


def file_types(spark, d):
    name = F.concat(F.regexp_extract("url", "([^/?#]*)(?:[?#].*)?$", 1), F.element_at(F.array(*(F.lit(x) for x in (".html", ".HTM", ".md", ".docx", ".xyz", ""))), (F.pmod("page_id", F.lit(6)) + 1).cast("int")))
    return _table(spark, d, "pages").select("page_id", tx.ext_of(name).alias("ext"), tx.detect_type(name).alias("kind"), tx.base_name(name).alias("base"))


def search_urls(spark, d):
    return _table(spark, d, "nation").select("n_nationkey", F.explode(tx.search_urls(F.col("n_name"))).alias("u")).select("n_nationkey", "u.name", "u.url")


QUERIES = {f.__name__: f for f in (sentences, check_sentences, text_stats, token_estimate, windows, chunks, paragraphs, self_duplicates, overlap_rate, sentence_top1, refine_budget, sampled_sentences, mask_spans, mask_round_trip, html_text, html_paragraphs, lint_issues, issues_by_type, compare_positions, file_types, search_urls, document_windows, dictionary_hits, document_totals)} | fixtures.QUERIES

_ROWS = f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_idx, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)"
_CHECKED = f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_idx, unnest(s) AS sentence
FROM (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda x: {TRIM % 'x'}), lambda x: length(x) >= 8) AS s FROM documents)"""
_GRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"
_SIM = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
_LONG = f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS s
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？；]'), lambda x: {TRIM % 'x'}), lambda x: length(x) > 80) AS s FROM documents)"""
_TURNS = """
SELECT a.conv_id, a.turn, a.text, u.text AS asked
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user'"""


def _split(table: str, column: str, out: str) -> str:
    split = f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '[^。！？；\\r\\n]+[。！？；]?'), lambda x: {TRIM % 'x'}), lambda x: length(x) >= 8)"
    return f"SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS s FROM (SELECT conv_id, turn, {split} AS s FROM {table})"


# Written apart from the operator's pattern, in RE2's terms.
_BLANK = WS[1:-1]
_SPAN = (
    r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\[[\s\S]+?\\\]"
    + "|" + rf"\[[0-9,\-{_BLANK}]+\]|（[0-9,\-{_BLANK}]+）|\([0-9,\-{_BLANK}]+\)"
    + "|" + rf"(?:表|图|公式)[{_BLANK}]*[0-9一二三四五六七八九十]+(?:\([0-9]+\))?"
    + "|" + r"[A-Za-z][A-Za-z0-9._\-]+"
    + "|" + r"[0-9]+(?:\.[0-9]+)?%?(?:℃|°|元|万元|亿元|万|亿|km|cm|mm|kg|g|t|吨|人|次|年|月|日|小时|分钟|秒|个|种|项|倍|dB|Hz|kWh|度|平方米|平方公里|m|s|h|d)?"
)


def _tokens(text: str) -> str:
    return f"cast(floor(len(regexp_extract_all({text}, '[一-龥]')) + length(regexp_replace(regexp_replace({text}, '[一-龥]', '', 'g'), '{WS}+', '', 'g')) / 4.0::DOUBLE + 0.5) AS BIGINT)"



ORACLES = {
    "sentences": _ROWS,
    "check_sentences": _CHECKED,
    "text_stats": f"SELECT doc_id, length(coalesce(text, '')) AS length, length(regexp_replace(coalesce(text, ''), '{WS}+', '', 'g')) AS visible, len(regexp_extract_all(coalesce(text, ''), '[一-龥]')) AS cjk, len({SENTENCES}) AS sentences FROM documents",
    "token_estimate": f"SELECT doc_id, cast(floor(len(regexp_extract_all(coalesce(text, ''), '[一-龥]')) + length(regexp_replace(regexp_replace(coalesce(text, ''), '[一-龥]', '', 'g'), '{WS}+', '', 'g')) / 4.0::DOUBLE + 0.5) AS BIGINT) AS tokens FROM documents",
    "windows": f"""
WITH c AS (SELECT item_id, regexp_replace(coalesce(text, ''), '{WS}+', '', 'g') AS t FROM benchmark),
f AS (SELECT item_id, t, CASE WHEN length(t) < 20 THEN [] ELSE list_transform(range(0, length(t) - 19, 10), lambda i: substr(t, i + 1, 20)) END AS w, CASE WHEN length(t) > 20 THEN right(t, 20) ELSE t END AS tail FROM c),
g AS (SELECT item_id, CASE WHEN t = '' OR (len(w) > 0 AND w[len(w)] = tail) THEN w ELSE list_append(w, tail) END AS w FROM f),
r AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS win_idx, unnest(w) AS win FROM g)
SELECT item_id, win_idx, win AS "window", len({_GRAMS.format('win')}) AS n_bigrams FROM r""",
    "paragraphs": f"""
WITH l AS (SELECT conv_id, turn, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS s FROM conversations)),
m AS (SELECT *, regexp_replace(line, '{WS}+$', '') AS r, count(*) FILTER (WHERE regexp_replace(line, '{WS}+$', '') = '') OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM l),
p AS (SELECT conv_id, turn, g, {TRIM % "string_agg(r, ' ' ORDER BY i) FILTER (WHERE r <> '')"} AS paragraph FROM m GROUP BY conv_id, turn, g)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY g) - 1 AS para_idx, paragraph FROM p WHERE paragraph <> ''""",
    "self_duplicates": f"""
WITH c AS ({_CHECKED}), b AS (SELECT doc_id, sent_idx, {_GRAMS.format('sentence')} AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
p AS (SELECT x.doc_id, x.sent_idx AS i, y.sent_idx AS j, {_SIM.format('x.g', 'y.g')} AS sim
      FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.sent_idx < y.sent_idx AND y.sent_idx <= x.sent_idx + CASE WHEN x.n > 1500 THEN 400 ELSE x.n END
      WHERE least(len(x.g), len(y.g)) >= 0.85 * greatest(len(x.g), len(y.g)) - 1e-9)
SELECT doc_id, i, j, round(sim, 9) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, i, j) AS r FROM p WHERE sim >= 0.85) WHERE r <= 30""",
    "sentence_top1": f"""
WITH t AS ({_TURNS}), o AS ({_split('t', 'asked', 'o')}), w AS ({_split('t', 'text', 'w')}),
og AS (SELECT *, {_GRAMS.format('s')} AS g FROM o), wg AS (SELECT *, {_GRAMS.format('s')} AS g FROM w),
p AS (SELECT wg.conv_id, wg.turn, wg.k AS sent_idx, og.k AS ok, og.s AS orig, {_SIM.format('wg.g', 'og.g')} AS sim FROM wg JOIN og USING (conv_id, turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_idx ORDER BY sim >= 0.98 DESC, CASE WHEN sim >= 0.98 THEN 0 ELSE -sim END, ok) AS r FROM p)
SELECT conv_id, turn, sent_idx, round(sim, 9) AS sim, orig FROM r WHERE r = 1 AND sim >= 0.1""",
    "refine_budget": f"""
WITH t0 AS ({_TURNS}), t AS (SELECT * FROM t0 WHERE asked <> text), o AS ({_split('t', 'asked', 'o')}), w AS ({_split('t', 'text', 'w')}),
og AS (SELECT *, {_GRAMS.format('s')} AS g FROM o), wg AS (SELECT *, {_GRAMS.format('s')} AS g FROM w),
p AS (SELECT wg.conv_id, wg.turn, wg.k AS sent_idx, wg.s AS sentence, og.k AS ok, og.s AS orig, {_SIM.format('wg.g', 'og.g')} AS sim FROM wg JOIN og USING (conv_id, turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_idx ORDER BY sim >= 0.98 DESC, CASE WHEN sim >= 0.98 THEN 0 ELSE -sim END, ok) AS r FROM p),
k AS (SELECT conv_id, turn, sum(length(sentence) + length(orig)) AS chars, sum({_tokens('sentence')} + {_tokens('orig')}) AS tokens FROM r WHERE r = 1 AND sim >= 0.1 GROUP BY conv_id, turn),
v AS (SELECT t0.conv_id || '-' || t0.turn AS pair, coalesce(chars, 0)::BIGINT AS task_chars, coalesce(tokens, 0)::BIGINT AS task_tokens, {_tokens('t0.text')} AS full_tokens FROM t0 LEFT JOIN k ON k.conv_id = t0.conv_id AND k.turn = t0.turn)
SELECT *, cast(CASE WHEN full_tokens > 0 THEN floor((1 - task_tokens / full_tokens::DOUBLE) * 100 + 0.5) ELSE 0 END AS BIGINT) AS saved_pct FROM v""",
    "sampled_sentences": f"WITH c AS ({_CHECKED}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c) SELECT doc_id, sent_idx FROM n WHERE sent_idx % greatest(1, ceil(n / 5.0)::BIGINT) = 0",
    "mask_spans": f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS span_idx, unnest(s) AS span FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPAN}') AS s FROM documents)",
    "mask_round_trip": f"""
SELECT doc_id, len(regexp_extract_all(text, '{_SPAN}')) AS n_items,
       (SELECT string_agg(p || i, '' ORDER BY k) FROM (SELECT unnest(string_split_regex(text, '{_SPAN}')) AS p, unnest(list_append(regexp_extract_all(text, '{_SPAN}'), '')) AS i, generate_subscripts(string_split_regex(text, '{_SPAN}'), 1) AS k)) = text AS equal
FROM documents WHERE text IS NOT NULL""",
    "document_windows": f"""
WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}+', '', 'g') AS t FROM documents),
f AS (SELECT doc_id, t, CASE WHEN length(t) < 20 THEN [] ELSE list_transform(range(0, length(t) - 19, 10), lambda i: substr(t, i + 1, 20)) END AS w, CASE WHEN length(t) > 20 THEN right(t, 20) ELSE t END AS tail FROM c),
g AS (SELECT doc_id, CASE WHEN t = '' OR (len(w) > 0 AND w[len(w)] = tail) THEN w ELSE list_append(w, tail) END AS w FROM f)
SELECT doc_id, generate_subscripts(w, 1) - 1 AS win_idx, unnest(w) AS "window" FROM g""",
    "dictionary_hits": f"""
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}')) AS word FROM documents)
SELECT doc_id, word, count(*) AS n FROM h GROUP BY doc_id, word""",
    "overlap_rate": f"""
WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}+', '', 'g') AS t FROM documents),
f AS (SELECT doc_id, t, CASE WHEN length(t) < 20 THEN [] ELSE list_transform(range(0, length(t) - 19, 10), lambda i: substr(t, i + 1, 20)) END AS w, CASE WHEN length(t) > 20 THEN right(t, 20) ELSE t END AS tail FROM c WHERE t <> ''),
g AS (SELECT doc_id, CASE WHEN len(w) > 0 AND w[len(w)] = tail THEN w ELSE list_append(w, tail) END AS w FROM f),
r AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS win FROM g),
s AS (SELECT doc_id, k, {_GRAMS.format('win')} AS g FROM r),
x AS (SELECT doc_id, k, len(g) AS n, unnest(g) AS x FROM s),
often AS (SELECT doc_id, x, count(*) AS c FROM x GROUP BY doc_id, x),
b AS (SELECT x.doc_id - 1 AS doc_id, k, n, x.x, row_number() OVER (PARTITION BY x.doc_id, k ORDER BY coalesce(c, 0), x.x) AS p FROM x LEFT JOIN often ON often.doc_id = x.doc_id - 1 AND often.x = x.x),
met AS (SELECT DISTINCT b.doc_id, b.k AS kb, x.k AS ka FROM b JOIN x ON x.doc_id = b.doc_id AND x.x = b.x AND least(x.n, b.n) >= 0.8 * greatest(x.n, b.n) - 1e-9 WHERE p <= b.n - ceil(0.8 * b.n - 1e-9) + 1),
hit AS (SELECT DISTINCT met.doc_id, kb FROM met JOIN s a ON a.doc_id = met.doc_id AND a.k = ka JOIN s t ON t.doc_id = met.doc_id + 1 AND t.k = kb WHERE {_SIM.format('a.g', 't.g')} >= 0.8),
n AS (SELECT doc_id - 1 AS doc_id, count(*) AS total FROM r GROUP BY doc_id),
h AS (SELECT doc_id, count(*) AS dup FROM hit GROUP BY doc_id)
SELECT n.doc_id, round(coalesce(dup, 0) / total::DOUBLE, 9) AS rate, coalesce(dup, 0) AS dup_windows, total AS total_windows
FROM n JOIN f ON f.doc_id = n.doc_id LEFT JOIN h ON h.doc_id = n.doc_id""",
    "chunks": f"""
WITH RECURSIVE p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^。！？；.!?;\\n]*[。！？；.!?;\\n]|[^。！？；.!?;\\n]+') AS parts FROM documents),
l AS (SELECT doc_id, list_transform(parts, lambda x: length(x)) AS sizes FROM p),
w AS (
  SELECT doc_id, 1::BIGINT AS i, 0::BIGINT AS c, sizes[1]::BIGINT AS open FROM l WHERE len(sizes) > 0
  UNION ALL
  SELECT w.doc_id, i + 1, c + CASE WHEN open > 0 AND open + sizes[i + 1] > 380 THEN 1 ELSE 0 END, CASE WHEN open > 0 AND open + sizes[i + 1] > 380 THEN sizes[i + 1] ELSE open + sizes[i + 1] END
  FROM w JOIN l ON l.doc_id = w.doc_id WHERE i < len(sizes)),
u AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM p),
j AS (SELECT w.doc_id, c, {TRIM % "string_agg(part, '' ORDER BY u.i)"} AS chunk FROM w JOIN u ON u.doc_id = w.doc_id AND u.i = w.i GROUP BY w.doc_id, c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS chunk_idx, chunk FROM j WHERE chunk <> ''""",
    "html_text": f"""
WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<body[^>]*>[\\s\\S]*?</body>') THEN regexp_extract(html, '(?i)<body[^>]*>([\\s\\S]*?)</body>', 1) ELSE html END AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS t FROM c)
SELECT page_id, {TRIM % f"regexp_replace(t, '{WS}+', ' ', 'g')"} AS text FROM e""",
    "lint_issues": f"WITH l AS ({_LONG}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS issue_idx, 'long' AS type, cast(-1 AS BIGINT) AS index, left(s, 60) || '…（全句 ' || length(s) || ' 字）' AS issue FROM l",
    "issues_by_type": f"WITH l AS ({_LONG}) SELECT 'long' AS type, count(*) AS n FROM l HAVING count(*) > 0",
    "compare_positions": f"""
WITH s AS ({_ROWS}), a AS (SELECT doc_id, sent_idx, sentence FROM s), b AS (SELECT doc_id - 1 AS doc_id, sent_idx, sentence FROM s WHERE doc_id > 0)
SELECT doc_id, sent_idx, coalesce(a.sentence, '') AS "left", coalesce(b.sentence, '') AS "right", coalesce(a.sentence, '') = coalesce(b.sentence, '') AS same FROM a FULL JOIN b USING (doc_id, sent_idx)""",
    "file_types": """
WITH n AS (SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || (['.html', '.HTM', '.md', '.docx', '.xyz', ''])[page_id % 6 + 1] AS name FROM pages),
e AS (SELECT page_id, name, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext FROM n)
SELECT page_id, ext, CASE WHEN ext IN ('docx', 'doc', 'pdf', 'txt', 'rtf') THEN ext WHEN ext IN ('md', 'markdown') THEN 'md' WHEN ext IN ('html', 'htm') THEN 'html' END AS kind, regexp_replace(name, '\\.[^.]+$', '') AS base FROM e""",
    "search_urls": "SELECT n_nationkey, p.name, p.url || replace(trim(n_name), ' ', '%20') AS url FROM nation, (VALUES " + ", ".join(f"('{n}', '{u}')" for n, u in tx.SEARCH_PAGES) + ") p(name, url)",
}
ORACLES |= fixtures.ORACLES
