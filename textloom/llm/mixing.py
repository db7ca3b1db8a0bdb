"""Mixing sources to target weights by a low-discrepancy schedule.

Point i of the golden-ratio sequence falls into one source's part of the
cumulative weights; that is the source of slot i. So every stretch of the mix
is near the weights, not just the whole. Each source's documents, in an order
set by a hash, form a stream of words cut into blocks of equal length; the
source's r-th slot takes its r-th block, and starts over after the last one. The
last slot of a source is shortened to meet its target to the word.

Every running number (slots of a source, words of a source) is made in two
levels, cells first and then within a cell, so that a source with most rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, slices, table, utf8

#: Words of a block, and slots or documents of one numbering task, about.
BLOCK, CELL = 4096, 50_000
#: The fractional part of the golden ratio in units of 2**-31, so that the sequence is exact in integers.
GOLDEN, UNIT = 1327217885, 1 << 31
#: Parts of the unit interval by which points and sources meet.
BINS = 4096


def word_counts(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` without its text, with the number of ``[^\\x20\\x09-\\x0D]+`` in it; null has none."""
    at = df.columns.index(text_col)
    rest = [k for k in range(len(df.columns)) if k != at]
    out = T.StructType([*(df.schema.fields[k] for k in rest), T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            counts = pa.array([len(x.split()) for x in utf8(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), counts], names=out.names)

    return df.mapInArrow(run, out)


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """``(src, source_size, target)`` from ``sizes(src, source_size)``, a row for each source.

    Weights repeat over the sources in code point order, null last. A target is
    at most ``max_repeats`` times its source's size; what is above goes to the
    others by weight, until none is above. In order of the cap for each unit of
    weight, the sources that stop at their cap come first, so one running sum
    finds the common level of the rest.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("src", "source_size", weight.alias("w"), (F.col("source_size") * float(max_repeats)).alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(rest))
    t = t.withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("level").alias("level")))).over(everything)["level"]
    return t.select("src", "source_size", F.when(F.col("open"), level * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _running(df: DataFrame, keys: list[str], cell: str, size: Column, order: list, out: str) -> DataFrame:
    """``df`` with the sum of ``size`` over the rows before this one within ``keys``: cells first, then in the cell."""
    df = df.withColumn("size__", size)
    sums = df.groupBy(*keys, cell).agg(F.sum("size__").alias("sum__"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, cell, F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum("size__").over(inside), F.lit(0)))
    return df.join(sums, [*keys, cell]).withColumn(out, F.col(out) + F.col("offset__")).drop("size__", "offset__", cell)


def schedule(spark: SparkSession, plan: DataFrame, n_slots: int) -> DataFrame:
    """``(slot, src, rank)``: each slot's source and the slot's number among that source's slots.

    ``plan(src, slots)`` says how many slots a source gets; ``n_slots`` is
    their sum. Slots the sequence deals beyond a source's number are left out,
    and those it has not dealt by its end (a few a source) are appended.
    """
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    parts = plan.select("src", "slots", F.floor(F.sum("slots").over(upto) / F.lit(float(max(n_slots, 1))) * UNIT).alias("edge"))
    parts = parts.withColumn("start", F.coalesce(F.lag("edge").over(Window.orderBy("src")), F.lit(0)))
    width = UNIT // BINS
    bins = parts.where("start < edge").withColumn("bin", F.explode(F.expr(f"sequence(start div {width}L, (edge - 1) div {width}L)")))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"((id & {UNIT - 1}L) * {GOLDEN}L) & {UNIT - 1}L").alias("x"))
    points = points.withColumn("bin", F.expr(f"x div {width}L"))
    dealt = points.join(bins, "bin").where("start <= x and x < edge").select("slot", "src", F.expr(f"slot div {CELL}L").alias("cell"))
    dealt = _running(dealt, ["src"], "cell", F.lit(1), ["slot"], "rank")
    counts = dealt.groupBy("src").agg(F.count("*").alias("dealt"))
    left = plan.join(counts, "src", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).where("dealt < slots")
    left = left.select("src", F.explode(F.expr("sequence(dealt, slots - 1)")).alias("rank"))
    late = left.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("rank", "src")) - 1).alias("slot"), "src", "rank")
    kept = dealt.join(plan, "src").where("rank < slots").select("slot", "src", "rank")
    return kept.unionByName(late)


def mix(df: DataFrame, weights: Sequence[float], max_repeats: float = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, plan, pieces)`` of the mix.

    - documents: ``id, src, size, start``: each row's words and its place in its source's stream
    - plan: ``src, source_size, target`` with a row for each source
    - pieces: ``slot, src, start, id, size, first, words``: slot takes ``words`` words of the row from word ``first``
      on. Rows with words that no slot takes have one piece without a slot, of no words.

    ``src`` is "a" and the source, or "b" for null, which orders as the
    weights are dealt. Rows without words, whether null or empty, are in no
    piece; a text of any length is cut at the ends of blocks only. Rows with
    equal ids keep apart by their sizes and lie side by side. An empty table, or
    one without words, gives an empty mix. Other columns of ``df`` don't matter,
    whatever their names.
    """
    spark = df.sparkSession
    src = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b"))
    docs = cut(word_counts(df.select(F.col(id_col).alias("id"), src.alias("src"), F.col(text_col).alias("t__")), "t__", "size"))
    sizes = docs.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(sizes, weights, max_repeats))
    goal, whole = F.floor("target"), F.col("source_size")
    quota = plan.where("source_size > 0").select("src", whole.alias("s"), F.floor(goal / whole).cast("long").alias("passes"), F.ceil(whole / BLOCK).cast("long").alias("blocks"), goal.alias("q"))
    quota = quota.withColumn("passes", F.expr("q div s")).withColumn("rest", F.expr("q % s"))
    quota = quota.withColumn("slots", F.expr(f"passes * blocks + (rest + {BLOCK - 1}L) div {BLOCK}L"))
    n_slots = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    slots = schedule(spark, quota.select("src", "slots"), n_slots).join(quota.select("src", "s", "passes", "blocks", "rest"), "src")
    block = f"(rank % blocks) * {BLOCK}L"
    slots = slots.select("slot", "src", F.expr("rank % blocks").alias("block"), F.expr(f"least({BLOCK}L, s - {block}, if(rank div blocks = passes, rest - {block}, {BLOCK}L))").alias("take"))

    digits, n = 2, docs.count()
    while n > CELL * 16**digits:
        digits += 1
    place = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    placed = docs.withColumn("o__", place).withColumn("cell", F.substring("o__", 1, digits))
    placed = _running(placed, ["src"], "cell", F.col("size"), ["o__", "id", "size"], "start").drop("o__")
    inside = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}L, (start + size - 1) div {BLOCK}L)")))
    inside = inside.withColumn("from__", F.expr(f"greatest(start - block * {BLOCK}L, 0L)")).withColumn("to__", F.expr(f"least(start + size - block * {BLOCK}L, {BLOCK}L)"))
    met = inside.join(slots, ["src", "block"], "left")
    words = F.expr("greatest(least(coalesce(take, 0L), to__) - from__, 0L)")
    pieces = met.select("slot", "src", "start", "id", "size", F.expr(f"block * {BLOCK}L + from__ - start").alias("first"), words.alias("words"))
    return placed, plan, pieces


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(id, src, size, taken, first_slot)``: the words of each row in the mix, repeats counted, and the first slot that takes one, or null."""
    some = pieces.groupBy("src", "start", "id", "size").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    none = documents.where("size = 0").select("id", "src", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.select(*none.columns).unionByName(none)


def places(pieces: DataFrame) -> DataFrame:
    """``(id, copies, slots)`` of each id with words: how often the mix takes it, to the nearest whole number, and a slot for each time.

    The slots are those that take its beginning, in order; where these are fewer, the last or else the first slot that takes any of it repeats.
    """
    begins = F.when((F.col("words") > 0) & (F.col("first") == 0), F.col("slot"))
    rows = pieces.groupBy("id", "start").agg(F.sum("words").alias("words"), F.max("size").alias("size"), F.collect_list(begins).alias("slots"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("any"))
    often = F.round(F.sum("words") / F.max("size")).cast("int")
    found = rows.groupBy("id").agg(often.alias("copies"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("slots"), F.min("any").alias("any"))
    slot = lambda k: F.coalesce(F.get("slots", k - 1), F.try_element_at("slots", F.lit(-1)), F.col("any"))
    return found.where("copies > 0").select("id", "copies", F.transform(F.sequence(F.lit(1), "copies"), slot).alias("slots"))


#: The weights of the contract: they repeat over the sources.
WEIGHTS = (5.0, 2.0, 1.0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, plan, pieces = mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return taken(documents, pieces).join(plan, "src").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src, md5(cast(doc_id AS VARCHAR)) AS o,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (SELECT src, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) AS k FROM d GROUP BY src),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
o AS (SELECT *, cap >= level * w AS open FROM l),
m AS (SELECT arg_min(level, cap / w) AS level FROM o WHERE open),
t AS (SELECT src, source_size, CASE WHEN open THEN m.level * w ELSE cap END AS target FROM o, m),
p AS (
  SELECT d.*, t.source_size, t.target, cast(floor(t.target) AS BIGINT) AS q,
         cast(coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.src = t.src),
-- The schedule: slots of a source, the golden-ratio points in its part of the unit interval, and what the points leave out.
c AS (
  SELECT src, (q // source_size) * ((source_size + 4095) // 4096) + (q % source_size + 4095) // 4096 AS slots
  FROM (SELECT src, source_size, cast(floor(target) AS BIGINT) AS q FROM t WHERE source_size > 0)),
e AS (
  SELECT src, slots, coalesce(sum(slots) OVER (), 0) AS n, cast(floor(sum(slots) OVER (ORDER BY src) / (sum(slots) OVER ())::DOUBLE * 2147483648) AS BIGINT) AS hi FROM c),
e2 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM e),
x AS (SELECT i AS slot, (i * 1327217885) % 2147483648 AS x FROM range((SELECT cast(coalesce(max(n), 0) AS BIGINT) FROM e)) r(i)),
g AS (SELECT slot, src, slots, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM x JOIN e2 ON lo <= x AND x < hi),
had AS (SELECT e2.src, e2.slots, count(g.slot) AS dealt FROM e2 LEFT JOIN g ON g.src = e2.src GROUP BY e2.src, e2.slots),
late AS (
  SELECT (SELECT cast(max(n) AS BIGINT) FROM e) + row_number() OVER (ORDER BY rank, src) - 1 AS slot, src, rank
  FROM (SELECT src, unnest(range(dealt, slots)) AS rank FROM had WHERE dealt < slots)),
sch AS (SELECT slot, src, rank FROM g WHERE rank < slots UNION ALL SELECT slot, src, rank FROM late)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target,
       cast(CASE WHEN size = 0 THEN 0 ELSE (q // source_size) * size + greatest(0, least(size, q % source_size - start)) END AS BIGINT) AS taken,
       cast(CASE WHEN size > 0 AND (q // source_size > 0 OR start < q % source_size) THEN sch.slot ELSE -1 END AS BIGINT) AS first_slot
FROM p LEFT JOIN sch ON sch.src = p.src AND sch.rank = p.start // 4096
"""
