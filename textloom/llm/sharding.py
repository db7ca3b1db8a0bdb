"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Equal texts form one atomic group; groups lie in the order of their text's
64-bit hash. The smallest capacity for which a greedy walk needs no more than
``n_shards`` shards is found by binary search. The walk only asks where a
running total falls, so the driver needs no list of groups: it holds a
histogram of sizes over ranges of the hash and splits, with one job a round,
just those ranges in which a cut of some capacity still in question can fall.
Every round divides such ranges by 1,024, so few rounds reach single groups.
The histogram has a bounded number of bins whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, table

FIRST_BITS, MORE_BITS = 12, 10
#: Rows of one numbering task, about.
CELL_ROWS = 50_000


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as no bytes."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _prefix(hash_col: str, bits: int) -> Column:
    """The hash's highest bits, as a number that orders like the unsigned hash."""
    return F.col(hash_col) if bits == 64 else F.shiftrightunsigned(F.col(hash_col), 64 - bits)


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut points (indexes into ``ends``) of the greedy walk, or None where ``shards`` do not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, lo=at)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
    return None


def minimax_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity that lets ``shards`` contiguous shards hold the sizes."""
    ends, total = [], 0
    for x in sizes:
        ends.append(total := total + x)
    low, high = -(-total // shards) if total else 0, total
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Cut points that respect ``capacity`` and otherwise lie as near to equal shares as they can.

    The greedy walk from the left gives the last place each cut may have, the
    walk from the right the first; between them the place nearest to an equal
    share of what remains is taken.
    """
    ends, total = [], 0
    for x in sizes:
        ends.append(total := total + x)
    n = len(sizes)
    first = [0] * (shards + 1)
    first[shards] = at = n
    for k in range(shards - 1, -1, -1):
        while at and (ends[first[k + 1] - 1] if first[k + 1] else 0) - (ends[at - 2] if at > 1 else 0) <= capacity:
            at -= 1
        first[k] = at
    cuts, at = [], 0
    for k in range(1, shards + 1):
        done = ends[at - 1] if at else 0
        last = bisect_right(ends, done + capacity, lo=at)
        goal = done + (total - done) / (shards - k + 1)
        near = bisect_right(ends, goal, lo=at)
        if near < n and (ends[near] - goal) < goal - (ends[near - 1] if near else 0):
            near += 1
        at = n if k == shards else min(last, max(first[k], near, at))
        cuts.append(at)
    return cuts


def _relaxed(sizes: list[int], whole: list[bool], capacity: int, shards: int) -> list[float] | None:
    """Where the greedy walk gets at best if the parts that aren't ``whole`` may be cut anywhere."""
    starts, total = [], 0
    for x in sizes:
        starts.append(total)
        total += x
    at, cuts = 0, []
    for _ in range(shards):
        at = min(at + capacity, total)
        k = bisect_right(starts, at) - 1
        if at < total and whole[k] and starts[k] < at:
            at = starts[k]
        cuts.append(at)
    return cuts if at == total else None


def _lower_bound(sizes: list[int], whole: list[bool], shards: int, high: int) -> int:
    low = 0
    while low < high:
        mid = (low + high) // 2
        if _relaxed(sizes, whole, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _open_parts(sizes: list[int], whole: list[bool], low: int, high: int, shards: int) -> list[int]:
    """The parts in which a cut can fall for some capacity from ``low`` to ``high``."""
    ends, total = [], 0
    for x in sizes:
        ends.append(total := total + x)
    best, touched, at = _relaxed(sizes, whole, high, shards) or [], set(), 0
    for k in range(shards):
        done = ends[at - 1] if at else 0
        at = bisect_right(ends, done + low, lo=at)
        last = bisect_right(ends, best[k] if k < len(best) else total)
        touched.update(range(at, min(last + 1, len(sizes))))
        if at < len(sizes) and sizes[at] > low:
            at += 1
    return sorted(k for k in touched if not whole[k])


def _histogram(rows: DataFrame, bits: int, parent_bits: int, parents: list[int]) -> list[tuple[int, int, int]]:
    """(first hash, bits, size) of each range that has rows; 64 bits where one hash alone is in it."""
    if parents:
        rows = rows.where(_prefix("h", parent_bits).isin(parents))
    found = rows.groupBy(_prefix("h", bits).alias("p")).agg(F.sum("size").alias("s"), F.min("h").alias("a"), F.max("h").alias("b"))
    return [(r.a % (1 << 64), 64, r.s) if r.a == r.b else ((r.p << (64 - bits)) % (1 << 64), bits, r.s) for r in found.collect()]


def plan_cuts(rows: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, upper ends): shard k has the unsigned hashes below its upper end that no earlier shard has.

    ``rows`` has ``h``, the group's hash, and ``size``. The capacity is the
    smallest there is, exactly.
    """
    bins = sorted(_histogram(rows, FIRST_BITS, 0, []))
    while True:
        sizes, whole = [s for _, _, s in bins], [b == 64 for _, b, _ in bins]
        high = minimax_capacity(sizes, n_shards)
        low = _lower_bound(sizes, whole, n_shards, high)
        parts = _open_parts(sizes, whole, low, high, n_shards) if low < high else []
        if not parts:
            break
        bits = min(bins[k][1] for k in parts)
        parts = [k for k in parts if bins[k][1] == bits]
        finer = _histogram(rows, min(64, bits + MORE_BITS), bits, [bins[k][0] >> (64 - bits) for k in parts])
        chosen = set(parts)
        bins = sorted([b for k, b in enumerate(bins) if k not in chosen] + finer)
    cuts = balanced_cuts(sizes, n_shards, high)
    return high, [bins[c][0] if c < len(bins) else 1 << 64 for c in cuts]


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for each row of ``df``; shards' sizes are as equal as whole groups allow.

    Null and empty texts are one group of size 1 a row. Slots count from 0
    without gaps in each shard; rows that are equal in every respect take
    neighbouring slots. An empty table gives an empty result. Groups whose
    64-bit hashes coincide move together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(df.select(F.col(id_col).alias("id"), utf8_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    _, ends = plan_cuts(rows, n_shards)
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    number = sum(((order >= F.lit(e - (1 << 63))).cast("int") for e in ends[:-1] if e < 1 << 64), F.lit(0))
    cells = max(64, rows.count() // (n_shards * CELL_ROWS))
    dealt = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("id", "h"), F.lit(cells)))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("id", "h")
    ranked = dealt.withColumn("r", F.row_number().over(inside))
    joined = ranked.join(offsets, ["shard", "cell"])
    return joined.select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 16)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
