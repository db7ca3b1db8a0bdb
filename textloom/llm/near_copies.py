"""Near copies down to a word-shingle similarity: SimHash with multi-index hashing, then an exact search of the rest.

Texts with equal sets of shingles are one node. Links come in two passes, and
every one is decided by the exact Jaccard similarity of two complete sets, so
nothing below the bound is linked.

The first pass looks up fingerprints (``simhash.links``): nodes whose
fingerprints differ in few bits are candidates. That finds most copies, but
fingerprints of 64 bits lose pairs near the bound (the README has figures). So
the second pass is one that loses none, for pairs the first left apart: put all
sets in one order; if two of sizes m and n share ``s / (1 + s) * (m + n)`` elements,
as a similarity of s needs, their first common element lies so early in both
that as many follow in either. So each set is entered under its first
``n - ceil(s * n) + 1`` elements with their places, and two sets meet under a common
element only where the places allow the similarity.

The order has the shingles first that are rare in a sample of the texts. It
decides only how many pairs are looked at. The sample grows with the table, so
that a passage that stands in some dozens of texts counts as frequent in a table
of any size, and the texts that share it aren't paired. The most frequent shingles of the
sample, ``FREQUENT`` at most, are sent to the executors; all others count as rare and
go by their hash.

Candidates are first compared by bitmaps: each element of a set flips one bit of
as many as the set has elements, or up to twice as many. Elements of both sets
flip the same bits, so the bitmaps differ in no more bits than the sets in elements, and none
that is similar is lost. Only what this leaves is compared by complete sets.

Groups of copies are not paired out. Under a crowded element every node is first
paired with one only, the node that has the element earliest in its own order:
a text of which the others are altered copies has no rare shingles, so it is
that one for most of them. In the second pass the nodes of one component
count as one for each element, and only pairs from different components leave
the join. Their complete sets are made again from the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import simhash
from textloom.llm.common import cut, slices, utf8
from textloom.llm.components import connected_components
from textloom.llm.simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates may differ, and the segments they are looked up by.
MAX_DISTANCE, SEGMENTS = 3, 2
#: Texts in the sample for the order at least, one of how many texts it has, texts of it that make a shingle frequent, and frequent shingles sent out at most.
SAMPLE, ONE_OF, OFTEN, FREQUENT = 8_000, 8, 3, 1_000_000
#: Shingles in the sets, and words of bitmaps, that are broadcast at most; more are joined.
BROADCAST_SHINGLES = 1_000_000
#: Names of nodes that are broadcast at most; more are joined.
BROADCAST_NODES = 500_000
#: Nodes of an element from which they are paired with one of them first.
CROWD = 16
#: Against the rounding of products with the similarity.
TINY = 1e-9
#: Bytes of text that are worked on at a time.
STEP = 4 << 20


def shingle_set(data: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, words))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of numbers; None stays null."""
    offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in arrays]))).astype(np.int32)
    some = [x for x in arrays if x is not None]
    values = np.concatenate(some) if some else np.empty(0, np.uint64)
    mask = pa.array([x is None for x in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), mask=mask)


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, and the counts of the shingles frequent in a sample of ``texts(text__)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            found = np.concatenate([shingle_set(x, words) for x in utf8(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    n = texts.count()
    sample = texts.sample(False, max(SAMPLE / n, 1 / ONE_OF), 7) if n > SAMPLE else texts
    often = cut(sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN))
    often = often.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes, counts = (often.column(k).to_numpy().astype(np.int64) for k in range(2))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a set, rare ones first, of which similar sets share one."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - TINY) + 1 if n else 0
    if not len(frequent):
        return hashes[:size]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    rank = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[:size]]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them with at least as many bits as the set has elements; each element flips the bit of its low end.

    The two halves xored are the bitmap of half as many bits.
    """
    bits = 64 << max(0, (len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def described(df: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """``df`` without its text, with what is known of the text's set.

    ``s1, s2``: its 128-bit name; ``n``: its size; ``fp``: its fingerprint;
    ``prefix``: its first elements, ``bits``: its bitmap, both null where the
    task has already given them for an equal set.
    """
    at = df.columns.index(text_col)
    rest = [k for k in range(len(df.columns)) if k != at]
    long = T.LongType()
    out = T.StructType([*(df.schema.fields[k] for k in rest), *(T.StructField(x, long) for x in ("s1", "s2", "n", "fp")), T.StructField("prefix", T.ArrayType(long)), T.StructField("bits", T.ArrayType(long))])
    sent = df.sparkSession.sparkContext.broadcast(frequent_shingles(df.select(F.col(text_col).alias("text__")), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        seen: set[bytes] = set()
        for batch in slices(batches, at, STEP):
            names, sizes, fps, firsts, maps = [], [], [], [], []
            for x in utf8(batch.column(at)):
                hashes = shingle_set(x, words)
                name = xxhash.xxh3_128_digest(hashes.tobytes())
                names.append(name)
                sizes.append(len(hashes))
                fps.append(simhash.fingerprint(hashes))
                firsts.append(None if name in seen else prefix(hashes, frequent, counts, similarity))
                maps.append(None if name in seen else bitmap(hashes))
                seen.add(name)
            halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            found = [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), _lists(firsts), _lists(maps)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *found], names=out.names)

    return df.mapInArrow(run, out)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _named(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``(node, n, *columns)`` of the nodes in ``pairs(a, b)``, a row a node, materialised."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    if ends.count() <= BROADCAST_NODES:
        ends = F.broadcast(ends)
    return cut(nodes.join(ends, "node", "left_semi").select("node", "n", *columns).dropDuplicates(["node"]))


def _beside(pairs: DataFrame, sets: DataFrame, small: bool) -> DataFrame:
    """``pairs`` with the ``items`` of both ends."""
    one, two = (sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}")) for x in "ab")
    return pairs.join(F.broadcast(one) if small else one, "a").join(F.broadcast(two) if small else two, "b")


def _small(sizes: DataFrame, size: Column) -> bool:
    return (sizes.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_SHINGLES


def _differing(one: Column, two: Column) -> Column:
    """Bits in which two bitmaps differ, the larger one folded if it has twice the size; null if it is larger still."""
    words = F.least(F.size(one), F.size(two))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = [F.when(F.size(x) > words, F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, F.size(x)), xor)).otherwise(x) for x in (one, two)]
    return F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda so_far, x: so_far + x)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sizes and bitmaps allow the similarity.

    Sets of sizes m and n that are similar differ in at most ``(1 - s) / (1 + s) * (m + n)`` elements, and bitmaps in no
    more bits. Their sizes are then so near that one bitmap has at most twice the bits.
    """
    some = _named(pairs, nodes, "bits")
    sets = some.select("node", F.struct("n", "bits").alias("items"))
    found = _beside(pairs, sets, _small(some, F.size("bits")))
    na, nb = F.col("sa.n"), F.col("sb.n")
    near = F.least(na, nb) + F.lit(TINY) >= F.lit(similarity) * F.greatest(na, nb)
    most = F.lit((1 - similarity) / (1 + similarity) + TINY) * (na + nb)
    return found.where(near & (_differing(F.col("sa.bits"), F.col("sb.bits")) <= most)).select("a", "b")


def complete_sets(some: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``(node, items)``: the complete sets of ``some(node, t1, t2)``, a row a node, from ``texts(text__)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1, 1 << 20):
            found: dict[int, np.ndarray] = {}
            for node, x in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if node not in seen:
                    seen.add(node)
                    found[node] = shingle_set(x, words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), _lists(list(found.values()))], names=["node", "items"])

    need = some.select("node", F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    if need.count() <= BROADCAST_NODES:
        need = F.broadcast(need)
    keyed = texts.select("text__", *_text_key(F.col("text__")))
    wanted = keyed.join(need, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2"))).select("node", "text__")
    return wanted.mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose complete sets have at least the similarity, materialised."""
    pairs = cut(plausible(cut(pairs), nodes, similarity))
    some = _named(pairs, nodes, "t1", "t2")
    found = _beside(pairs, complete_sets(some, texts, words), _small(some, F.col("n")))
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(found.where(shared + F.lit(TINY) >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))


def _allowed(similarity: float, na: Column, nb: Column, ra: Column, rb: Column) -> Column:
    """Whether sets of sizes ``na`` and ``nb`` that have ``ra`` and ``rb`` elements from their first common one on can be similar."""
    return F.least(ra, rb) + F.lit(TINY) >= F.lit(similarity / (1 + similarity)) * (na + nb)


def _size_and_rest(packed: str) -> tuple[Column, Column]:
    return F.shiftright(packed, 32), F.col(packed).bitwiseAND(F.lit((1 << 32) - 1))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Candidate pairs of nodes by their fingerprints: each node with the first of its fingerprint, and those of near ones."""
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("last")))
    several = firsts.where("rep <> last").select("fp", "rep")
    equal = nodes.select("fp", "node").join(several, "fp").where("node <> rep").select(*_ordered("node", "rep"))
    near = simhash.links(firsts.select("fp"), MAX_DISTANCE, SEGMENTS)
    one, two = (firsts.select(F.col("fp").alias(x), F.col("rep").alias(f"r{x}")) for x in "ab")
    return equal.union(near.join(one, "a").join(two, "b").select(*_ordered("ra", "rb")))


def links(nodes: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` that join all similar ``nodes(node, t1, t2, n, fp, prefix, bits)`` and no others.

    A node may have several rows, which differ in no more than the text they name. Inside a group that links already
    join, further links are not listed.
    """
    # nr: a node's size, and how many elements it has from this one on. One exchange serves both the counts and the join with them,
    # as long as both have the same filters below it: the join would add one of its own on nr.
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "node", F.expr("shiftleft(n, 32) | (n - pos)").alias("nr"))
    entries = entries.where("key is not null and nr is not null").repartition("key")
    n, r = _size_and_rest("nr")
    hub = F.min(F.struct((n - r).alias("pos"), "node", "nr")).alias("h")
    ends = entries.groupBy("key").agg(hub, F.count("*").alias("many"), F.min("node").alias("first"), F.max("node").alias("last"), F.min(n).alias("least"), F.max(r).alias("most"))
    # The best partner that this element could have is as small as the smallest and has its elements as late as the latest.
    partner = F.lit(similarity / (1 + similarity)) * (n + F.greatest(F.col("least"), F.lit(similarity) * n))
    met_by = (F.col("first") != F.col("last")) & (F.least(r, "most") + F.lit(TINY) >= partner)
    crowded = lambda c: F.when(F.col("many") >= CROWD, F.col(c))
    live = cut(entries.join(ends, "key").where(met_by).select("key", "node", "nr", crowded("h.node").alias("hub"), crowded("h.nr").alias("hub_nr")))

    (na, ra), (nb, rb) = _size_and_rest("nr"), _size_and_rest("hub_nr")
    stars = live.where("node <> hub").where(_allowed(similarity, na, nb, ra, rb)).select(*_ordered("node", "hub"))
    first = cut(connected_components(verified(near_fingerprints(nodes).union(stars).distinct(), nodes, texts, words, similarity)).withColumnRenamed("node", "node__"))

    few = first.count() <= BROADCAST_NODES
    members = live.join(F.broadcast(first) if few else first, F.col("node") == F.col("node__"), "left").select("key", F.coalesce("root", "node").alias("root"), "node", n.alias("n"), r.alias("r"))
    members = members if few else cut(members)
    groups = members.groupBy("key", "root").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("n"), F.max("r").alias("r"))
    one, two = (groups.select("key", F.col("root").alias(f"root{x}"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(y), F.col("n").alias(f"n{x}"), F.col("r").alias(f"r{x}")) for x, y in ("ax", "by"))
    met = one.join(two, (one["key"] == two["key"]) & (F.col("roota") < F.col("rootb")) & _allowed(similarity, *map(F.col, ("na", "nb", "ra", "rb"))))
    met = cut(met.select(one["key"], "roota", "rootb", "x", "y"))

    alone = F.col("x").isNotNull() & F.col("y").isNotNull()
    single = met.where(alone).select("x", "y")
    left, right = (members.select("key", F.col("root").alias(f"root{x}"), F.col("node").alias(y), F.col("n").alias(f"n{y}"), F.col("r").alias(f"r{y}")) for x, y in ("ax", "by"))
    crowd = met.where(~alone).select("key", "roota", "rootb").join(left, ["key", "roota"]).join(right, ["key", "rootb"]).where(_allowed(similarity, *map(F.col, ("nx", "ny", "rx", "ry"))))
    rest = verified(single.union(crowd.select("x", "y")).select(*_ordered("x", "y")).distinct(), nodes, texts, words, similarity)
    return first.where("node__ <> root").select(F.col("node__").alias("a"), F.col("root").alias("b")).union(rest)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, *carry, group, component_id)``, one row per row of ``df``.

    ``group`` names the near copies that a row belongs to; ``component_id`` is
    the group's smallest id, null only if it has no id. Null and empty texts
    and those without words form one group, texts of fewer words than a
    shingle are one shingle, repeated rows fall in one group, and an empty
    table gives an empty result. ``carry`` may name any columns of ``df``; other
    columns don't matter, whatever their names.
    """
    kept = [f"carry{k}__" for k in range(len(carry))]
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(k) for c, k in zip(carry, kept)), F.coalesce(F.col(text_col), F.lit("")).alias("text__"))
    rows = rows.select("*", *_text_key(F.col("text__")))
    own = cut(described(rows, words, similarity, "text__"))
    # A set's first half names it, unless another set has the same: then the second half joins in.
    clash = cut(own.groupBy("s1").agg(F.min("s2").alias("first2"), F.max("s2").alias("last2")).where("first2 <> last2").select(F.col("s1").alias("s1__"), "first2"))
    if clash.count():
        other = F.col("first2").isNotNull() & (F.col("s2") != F.col("first2"))
        own = own.join(clash, F.col("s1") == F.col("s1__"), "left").withColumn("node", F.when(other, F.xxhash64("s2", "s1")).otherwise(F.col("s1")))
    else:
        own = own.withColumn("node", F.col("s1"))
    nodes = own.where(F.col("prefix").isNotNull()).select("node", "t1", "t2", "n", "fp", "prefix", "bits")
    found = cut(connected_components(links(nodes, rows.select("text__"), words, similarity)).withColumnRenamed("node", "node__"))
    own = own.select("id", *kept, "node")
    own = own.join(F.broadcast(found) if found.count() <= BROADCAST_NODES else found, F.col("node") == F.col("node__"), "left").withColumn("group", F.coalesce("root", "node"))
    least = own.groupBy("group").agg(F.min("id").alias("component_id")).withColumnRenamed("group", "group__")
    joined = own.join(least, F.col("group") == F.col("group__"))
    return joined.select("id", *(F.col(k).alias(c) for c, k in zip(carry, kept)), "group", "component_id")
