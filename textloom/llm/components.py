"""Connected components by alternating large-star and small-star rounds.

Every round is a handful of joins and distributed minima over the edges, so
neither a component nor the list of links is ever gathered in one place. The
joins' hot side (a root that most of a large component already points to) has
one row per key on the other side, which lets Spark split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    rest = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any comparable ids; returns ``(node, root)``.

    ``root`` is the smallest id of the node's component. Only nodes with an
    edge to another node appear. Loops and repeated edges are harmless; null
    ends are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        edges = cut(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle; raise max_rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())
