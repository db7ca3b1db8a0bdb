"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in
at most ``max_distance`` bits differ in at most ``max_distance // segments`` of
them within some segment, so it is enough to look up, for each segment, the
small Hamming ball around the segment's value in a table of segment values, and
to verify the complete distance of what is found. The join on segment values
carries the distance as a condition, so only true links leave it.

Of two different segment values only the larger one enumerates the smaller, so
that each link is met once for each segment. Equal fingerprints are one node:
groups of copies cost one row, whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, slices, table, unsigned, utf8
from textloom.llm.components import connected_components

SEED = 42


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence where it is shorter."""
    found = data.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ends = (starts[words:] - 1).tolist()
    spans = [whole[a:b] for a, b in zip(starts.tolist(), ends)]
    return np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, len(spans))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes; signed, as Spark has it."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, words: int, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """``df`` without its text, with the text's fingerprint; no words give zero."""
    at = df.columns.index(text_col)
    rest = [k for k in range(len(df.columns)) if k != at]
    out = T.StructType([*(df.schema.fields[k] for k in rest), T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            fps = [fingerprint(shingle_hashes(x, words)) for x in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(fps, pa.int64())], names=out.names)

    return df.mapInArrow(run, out)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _entries(fps: DataFrame, segments: int, radius: int, probe: bool) -> DataFrame:
    """``(segment, value, fp)``: the table's entries, or the ball around each value, the value itself included."""
    cuts = _cuts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([sum(1 << b for b in c) for r in range(radius + 1 if probe else 1) for c in combinations(range(n), r)], np.uint64) for _, n in cuts]
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                own = batch.column(0).slice(start, 20_000).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for s, (first, n) in enumerate(cuts):
                    value = (own >> np.uint64(first)) & np.uint64((1 << n) - 1)
                    ball = value[:, None] ^ masks[s][None, :]
                    row, col = np.nonzero(ball <= value[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s, np.int32)), pa.array(ball[row, col].view(np.int64)), pa.array(own[row].view(np.int64))], names=["segment", "value", "fp"])

    return fps.mapInArrow(run, "segment int, value long, fp long")


def links(fps: DataFrame, max_distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fps(fp)`` that differ in 1 to ``max_distance`` bits. None is lost."""
    radius = max_distance // segments
    here = _entries(fps, segments, radius, False).select("segment", "value", F.col("fp").alias("own"))
    probe = _entries(fps, segments, radius, True)
    near = F.expr(f"fp <> own and bit_count(fp ^ own) <= {int(max_distance)}")
    first, bits = _cuts(segments)[0]
    found = probe.join(here, (probe.segment == here.segment) & (probe.value == here.value) & near, "inner")
    return found.select(F.least("fp", "own").alias("a"), F.greatest("fp", "own").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: int = 3, max_distance: int = 3, segments: int = 2) -> DataFrame:
    """``(id, *carry, fp, component_id)``, one row per row of ``df``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_distance`` bits. Rows of equal ids stay apart and get the same
    answer only if their texts do; null ids never name a component unless a
    component has no other; texts without words share fingerprint zero, which
    links like any other. An empty table gives an empty result.
    """
    own = cut(fingerprints(df.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("text__")), words, "text__"))
    nodes = own.groupBy("fp").agg(F.min("id").alias("rep"))
    found = connected_components(links(nodes.select("fp"), max_distance, segments))
    linked = nodes.join(found, nodes.fp == found.node).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "root").select(F.col("fp").alias("node"), "least")
    labels = nodes.join(moved, nodes.fp == moved.node, "left").select(F.col("fp").alias("node"), F.coalesce("least", "rep").alias("component_id"))
    return own.join(labels, own.fp == labels.node).select("id", *carry, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), unsigned(F.col("fp")).alias("fingerprint"), "component_id")
