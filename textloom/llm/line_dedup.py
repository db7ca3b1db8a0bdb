"""Removal of lines that repeat across documents, by two Bloom filters.

A first pass hashes every line's key and keeps two filters: keys seen once, and
keys seen in a second document. Partial filters of many tasks merge by parts of
the bit array: a bit is in the merged second filter if it is in either second
filter or in both first ones, which never loses a repeated key. In a second
pass only keys that the second filter suspects are sent on, 16 bytes each, and
counted exactly. The last pass drops lines.

The filters are sized by the number of lines, up to ``MAX_BITS``; beyond that
more lines are suspected, which costs shuffle but changes no result. Confirmed
keys are broadcast only up to ``broadcast_keys`` of them; more are joined.

Keys are told apart by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, fresh, slices, table, utf8

SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each line, bits set for a key, and the bounds of a filter's bits as powers of two.
BITS_A_LINE, PROBES, MIN_BITS, MAX_BITS = 10, 4, 16, 29


def keys_of(line_list: list[bytes], min_chars: int) -> list[bytes | None]:
    """Each line's key, or None where it has fewer than ``min_chars`` code points."""
    keys = [x.strip(SPACE).lower() for x in line_list]
    if min_chars == 1:
        return [k or None for k in keys]
    return [k if len(k) >= min_chars and len(k.decode()) >= min_chars else None for k in keys]


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _doc_keys(data: bytes, min_chars: int) -> set[bytes]:
    """The hashes of a document's distinct keys."""
    return {_hash(k) for k in set(keys_of(data.split(b"\n"), min_chars)) if k is not None}


def _halves(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def _positions(halves: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, a row of PROBES."""
    steps = np.arange(PROBES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64((1 << bits) - 1)


def _holds(filter_bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _put(filter_bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def merge_filters(parts: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(once, twice) of the parts' (once, twice)."""
    once = twice = None
    for a, b in parts:
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return once, twice


def suspects(texts: DataFrame, min_chars: int) -> tuple[np.ndarray, int]:
    """The second filter for the keys of ``texts(text)``, and the power of two of its bits."""
    spark = texts.sparkSession
    n = texts.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(n * BITS_A_LINE).bit_length()))
    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    step = max(512, min((1 << bits) // 8, 1 << 16, (64 << 20) // (2 * tasks)))
    step = 1 << (step.bit_length() - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((1 << bits) // 8, np.uint8) for _ in range(2))
        for batch in slices(batches, 0):
            found: list[bytes] = []
            for data in utf8(batch.column(0)):
                found += _doc_keys(data, min_chars)
            if not found:
                continue
            halves = _halves(found)
            at = _positions(halves, bits)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            same = np.zeros(len(order), bool)
            same[order[1:]] = (halves[order[1:]] == halves[order[:-1]]).all(1)
            _put(twice, at[same | _holds(once, at)])
            _put(once, at)
        for k in range(0, len(once), step):
            a, b = once[k : k + step], twice[k : k + step]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["part", "once", "twice"])

    def merge(part: pa.Table) -> pa.Table:
        _, twice = merge_filters(zip(part["once"].to_pylist(), part["twice"].to_pylist()))
        return pa.table({"part": part["part"][:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    built = texts.coalesce(tasks).mapInArrow(build, "part int, once binary, twice binary")
    merged = built.groupBy("part").applyInArrow(merge, "part int, twice binary")
    second = np.zeros((1 << bits) // 8, np.uint8)
    for row in merged.toLocalIterator():
        second[row.part * step : row.part * step + len(row.twice)] = np.frombuffer(row.twice, np.uint8)
    return second, bits


def _row_key(id_col: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_col, text).alias("r1"), F.xxhash64(text, id_col, F.lit(1)).alias("r2")]


def repeated_keys(df: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(k1, k2, n, r1, r2, line)``: keys in at least ``min_docs`` rows, with their number and first occurrence.

    The first occurrence is the lowest line of the row with the smallest id
    (null last), told apart by the hash of id and text.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    second, bits = suspects(docs.select("text"), min_chars)
    shipped = spark.sparkContext.broadcast(second)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = shipped.value
        for batch in slices(batches, 1):
            rows: list[int] = []
            lines: list[int] = []
            found: list[bytes] = []
            for row, data in enumerate(utf8(batch.column(1))):
                first: dict[bytes, int] = {}
                for line, key in enumerate(keys_of(data.split(b"\n"), min_chars)):
                    if key is not None:
                        first.setdefault(key, line)
                found += map(_hash, first)
                lines += first.values()
                rows += [row] * len(first)
            if not found:
                continue
            halves = _halves(found)
            keep = np.nonzero(_holds(second, _positions(halves, bits)))[0]
            halves = halves[keep].view(np.int64)
            take = pa.array(np.array(rows, np.int32)[keep])
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(np.array(lines, np.int32)[keep])], names=["k1", "k2", "id", "r1", "r2", "line"])

    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select("id", "text", *_row_key(F.col("id"), F.col("text")))
    rows = keyed.mapInArrow(suspected, f"k1 long, k2 long, id {kind}, r1 long, r2 long, line int")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "r1", "r2", "line")).alias("f")
    found = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs)
    return cut(found.select("k1", "k2", "n", "f.r1", "f.r2", "f.line"))


def drop_lines(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, min_chars: int, keep_first: bool, names: tuple[str, str], broadcast_keys: int) -> DataFrame:
    docs = df.drop(*names)
    base = docs.columns
    one, two, lost = fresh([*base, *names], "r1__", "r2__", "gone__")
    docs = docs.select("*", *(c.alias(n) for c, n in zip(_row_key(F.col(id_col), F.col(text_col)), (one, two))))
    at = base.index(text_col)
    fields = [*docs.schema.fields[: len(base)], T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())]
    fields[at] = T.StructField(text_col, T.StringType())
    out = T.StructType(fields)

    def emit(batch: pa.RecordBatch, dropped) -> pa.RecordBatch:
        """dropped(row, lines) gives the numbers of the lines to leave out, or nothing."""
        texts, counts, gone = [], [], []
        for row, data in enumerate(utf8(batch.column(at))):
            lines = data.split(b"\n")
            out_of = dropped(row, lines)
            if out_of:
                texts.append(b"\n".join([x for k, x in enumerate(lines) if k not in out_of]))
            else:
                texts.append(data)
            counts.append(len(lines))
            gone.append(len(out_of or ()))
        columns = list(batch.columns[: len(base)])
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=out.names)

    if keys.count() <= broadcast_keys:
        found = keys.toPandas()
        known = {k.tobytes(): (a, b, c) for k, a, b, c in zip(np.ascontiguousarray(found[["k1", "k2"]].to_numpy(np.int64)), found["r1"], found["r2"], found["line"])}
        shipped = df.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shipped.value
            for batch in slices(batches, at):
                marks = list(zip(batch.column(len(base)).to_pylist(), batch.column(len(base) + 1).to_pylist()))

                def dropped(row: int, lines: list[bytes]) -> set[int]:
                    gone = set()
                    for k, key in enumerate(keys_of(lines, min_chars)):
                        if key is not None and (f := known.get(_hash(key))) is not None and not (keep_first and f == (*marks[row], k)):
                            gone.add(k)
                    return gone

                yield emit(batch, dropped)

        return docs.mapInArrow(run, out)

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            rows, lines, found = [], [], []
            for row, data in enumerate(utf8(batch.column(0))):
                for line, key in enumerate(keys_of(data.split(b"\n"), min_chars)):
                    if key is not None:
                        rows.append(row)
                        lines.append(line)
                        found.append(_hash(key))
            halves, take = _halves(found).view(np.int64), pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(1).take(take), batch.column(2).take(take), pa.array(lines, pa.int32())], names=["k1", "k2", "r1__", "r2__", "at"])

    marks = docs.select(F.col(text_col).alias("text"), F.col(one).alias("r1__"), F.col(two).alias("r2__")).mapInArrow(lines_of, "k1 long, k2 long, r1__ long, r2__ long, at int")
    hit = marks.join(keys, ["k1", "k2"])
    if keep_first:
        hit = hit.where(~((F.col("r1") == F.col("r1__")) & (F.col("r2") == F.col("r2__")) & (F.col("line") == F.col("at"))))
    gone = hit.groupBy(F.col("r1__").alias(one), F.col("r2__").alias(two)).agg(F.collect_set("at").alias(lost))
    joined = docs.join(gone, [one, two], "left").select(*base, lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            marked = batch.column(len(base)).to_pylist()
            yield emit(batch, lambda row, lines: set(marked[row] or ()))

    return joined.mapInArrow(run, out)


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    names: tuple[str, str] = ("n_lines", "n_dropped"),
    broadcast_keys: int = 500_000,
) -> DataFrame:
    """``df`` without the lines whose key is in at least ``min_docs`` rows, and each row's numbers of lines and of dropped ones.

    A key is the line without ASCII white space at its ends and with A-Z
    lower-cased; lines whose key has fewer than ``min_chars`` code points stay.
    With ``keep_first`` each key's first occurrence stays: the lowest such line
    of the row with the smallest id. Null and empty texts are one empty line;
    a text of which no line is left is empty. Every row counts as a document;
    columns named like ``names`` are replaced, all others are kept whatever their
    names; an empty table gives an empty result. Rows equal in id and text are
    treated alike.
    """
    keys = repeated_keys(df, id_col, text_col, min_docs, min_chars)
    return drop_lines(df, keys, id_col, text_col, min_chars, keep_first, names, broadcast_keys)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""
