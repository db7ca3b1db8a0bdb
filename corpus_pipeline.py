"""A training corpus from the table ``documents``, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, whatever further columns there are. Rows are
known by two hashes of id and text, so repeated or missing ids do no harm: rows
equal in both are one document from the near-duplicate stage on. An empty table
gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe, line_dedup, mixing, near_copies, quality
from textloom.llm.common import cut, fresh
from textloom.session import ship

ID, TEXT, SOURCE = "doc_id", "text", "source"
#: Rows that leave the corpus are broadcast up to this many, and joined beyond.
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame, one: str, two: str) -> DataFrame:
    text = F.coalesce(F.col(TEXT), F.lit(""))
    return docs.withColumns({one: F.xxhash64(F.col(ID), text), two: F.xxhash64(text, F.col(ID), F.lit(1))})


def _as_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it is now."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.length(F.coalesce(F.col(TEXT), F.lit(""))).cast(kind))
    return found.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule, or that lines common on their host deplete, go; the others lose those lines.

    Null and empty texts go. Repeated rows share one verdict and all stay if it is good.
    """
    ship(spark)
    return _as_documents(quality.quality_texts(docs, ID, SOURCE, TEXT), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines in ten documents or more the first occurrence stays; documents that have no other lines go.

    The first occurrence is that of the smallest id, null last. Null and empty texts have no such line and stay, as an empty text.
    """
    ship(spark)
    count, lost = fresh(docs.columns, "n_lines__", "n_dropped__")
    found = line_dedup.line_dedup(docs, ID, TEXT, min_docs=10, min_chars=1, keep_first=True, names=(count, lost))
    return _as_documents(found.where((F.col(lost) == 0) | F.col(TEXT).rlike(r"[^\x20\x09-\x0D]")), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Null ids come last. Texts without words are one group; of rows equal in id and text one stays. Only names of rows
    are moved, not texts, as long as those that go or repeat are few enough to be sent to all executors.
    """
    ship(spark)
    one, two = fresh(docs.columns, "k1__", "k2__")
    keyed = _keyed(docs, one, two)
    groups = cut(near_copies.near_copies(keyed, ID, TEXT, carry=(one, two), words=5, similarity=0.8).select("id", F.col(one).alias("a"), F.col(two).alias("b"), "group"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "a", "b")).alias("f"))
    gone = groups.join(first, "group").where((F.col("a") != F.col("f.a")) | (F.col("b") != F.col("f.b"))).select("a", "b").distinct()
    gone = cut(gone.select(F.col("a").alias("a__"), F.col("b").alias("b__")))
    again = cut(groups.groupBy(F.col("a").alias("a__"), F.col("b").alias("b__")).agg(F.count("*").alias("n")).where("n > 1").join(gone, ["a__", "b__"], "left_anti").select("a__", "b__"))
    rest, twice = gone.union(again), again
    if rest.count() <= BROADCAST_ROWS:
        rest, twice = F.broadcast(rest), F.broadcast(twice)
    here = (F.col(one) == F.col("a__")) & (F.col(two) == F.col("b__"))
    found = keyed.join(rest, here, "left_anti").unionByName(keyed.join(twice, here, "left_semi").dropDuplicates([one, two]))
    return _as_documents(found, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, to the nearest whole number, in the order of the schedule's slots.

    Sources end near their targets. Documents without words go; a null source is one source, the last. Each repeat of a
    document lies where the schedule takes its beginning.
    """
    ship(spark)
    one, two, key, name, slots, copy, place = fresh(docs.columns, "k1__", "k2__", "key__", "id__", "slots__", "copy__", "place__")
    keyed = _keyed(docs, one, two).withColumn(key, F.concat(F.hex(one), F.lit("-"), F.hex(two)))
    pieces = mixing.mix(keyed, mixing.WEIGHTS, 3, key, SOURCE, TEXT)[2]
    found = keyed.join(mixing.places(pieces).select(F.col("id").alias(name), F.col("slots").alias(slots)), F.col(key) == F.col(name))
    n = F.row_number().over(Window.partitionBy(key).orderBy(name))
    found = found.withColumn(copy, n).where(F.col(copy) == 1).select(*docs.columns, key, F.posexplode(slots).alias(copy, place))
    return _as_documents(found.repartitionByRange(place, key, copy).sortWithinPartitions(place, key, copy), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a null text has none and decodes to an empty one."""
    ship(spark)
    coded = bpe.encode(docs.select(ID, SOURCE, TEXT), bpe.default_path(), TEXT, "ids", "decoded")
    return coded.select(ID, SOURCE, F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce(F.col(TEXT), F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL has no byte-pair encoding; the tests compare every stage and the whole with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
