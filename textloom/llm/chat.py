"""Chat formatting of logged conversations, in DataFrame functions only.

Logs often hold snapshots of a conversation that went on. A rolling hash over
the turns gives every prefix of every conversation a 128-bit name: the running
XOR of a hash of (position, role, text). A conversation whose whole name is the
name of a longer conversation's prefix is such a snapshot, and an anti-join
takes it out; of conversations with equal turns the smallest id stays. What is
left is rendered.

Positions and running hashes are made in two levels, blocks of turns first, so
that one endless conversation is spread over tasks up to its rendering, which
is one text by nature. Texts are only moved for conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, table

#: Turns of a block, and the number a turn without one has.
BLOCK, NO_TURN = 256, -(1 << 63)
#: Repeated (conversation, turn, role) that are broadcast at most; more are joined.
BROADCAST_TIES = 500_000
START, END = "<|im_start|>", "<|im_end|>"


def _tied(turns: DataFrame) -> DataFrame:
    """``turns`` with ``tie``: the text where another turn of the conversation has the same number and role, else null.

    Only such turns are told apart by their texts, so only their texts are moved before it is known which conversations stay.
    """
    ties = cut(turns.groupBy("conv", "turn", "role").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r")))
    n = ties.count()
    if not n:
        return turns.withColumn("tie", F.lit(None).cast("string"))
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("role") == F.col("r"))
    joined = turns.join(F.broadcast(ties) if n <= BROADCAST_TIES else ties, here, "left")
    return joined.select("conv", "turn", "role", "text", F.when(F.col("t").isNotNull(), F.col("text")).alias("tie"))


def _hashed(turns: DataFrame) -> DataFrame:
    """``(conv, pos, p1, p2)``: each turn's place from 1 and the name of the prefix that it ends."""
    order = ["turn", "role", "tie"]
    block = F.expr(f"turn div {BLOCK}").alias("block")
    rows = _tied(turns).select("conv", "turn", "role", "tie", F.xxhash64("text").alias("text"), F.xxhash64(F.lit(1), "text").alias("text2"), block)
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    rows = rows.withColumn("r", F.row_number().over(inside))
    per = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).withColumn("pos", F.col("offset") + F.col("r"))
    placed = placed.select("conv", "block", "pos", F.xxhash64("pos", "role", "text", "text2").alias("x1"), F.xxhash64("text2", "text", "role", "pos").alias("x2"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv", "block", "pos", F.bit_xor("x1").over(upto).alias("p1"), F.bit_xor("x2").over(upto).alias("p2"))
    ends = placed.groupBy("conv", "block").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    starts = ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.bit_xor("p1").over(before).alias("o1"), F.bit_xor("p2").over(before).alias("o2"))
    both = rolled.join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    own = lambda p, o: F.col(p).bitwiseXOR(F.coalesce(o, F.lit(0))).alias(p)
    return both.select("conv", "pos", own("p1", "o1"), own("p2", "o2"))


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv, n_turns, n_logs)`` of the conversations that are no proper prefix of another; one of each equal group.

    ``turns`` has ``conv, turn, role, text``; ``n_logs`` counts the equal ones.
    """
    names = cut(_hashed(turns))
    last = names.groupBy("conv").agg(F.max(F.struct("pos", "p1", "p2")).alias("e")).select("conv", "e.*")
    wholes = last.groupBy("pos", "p1", "p2").agg(F.min(F.struct(F.col("conv").isNull().alias("last"), "conv")).alias("f"), F.count("*").alias("n_logs"))
    end = last.select(F.col("conv").alias("c"), F.col("pos").alias("n"))
    proper = names.join(end, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") < F.col("n"))).select("pos", "p1", "p2").distinct()
    kept = wholes.join(proper, ["pos", "p1", "p2"], "left_anti")
    return kept.select(F.col("f.conv").alias("conv"), F.col("pos").alias("n_turns"), "n_logs")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def chat_format(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, n_turns, n_logs, text)``, a row for each maximal conversation.

    Turns are ordered by number (null first), then role and text, both by code points. Null roles
    and texts are empty; rows without a conversation id are one conversation,
    which has a null id and loses ties; repeated rows are repeated turns. An
    empty table gives an empty result. Other columns of ``df`` don't matter,
    whatever their names; a conversation of any length is one text in the end.
    """
    turns = df.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = cut(maximal(turns))
    own = kept.select(F.col("conv").alias("c"), "n_turns", "n_logs")
    said = turns.join(own, F.col("conv").eqNullSafe(F.col("c")))
    turn = F.struct("turn", "role", "text")
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda x: render(x["role"], x["text"]))
    return said.groupBy("conv", "n_turns", "n_logs").agg(F.array_join(lines, "\n").alias("text")).select(F.col("conv").alias("conv_id"), "n_turns", "n_logs", "text")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos,
         sha256(string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''), '') OVER w) AS p,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' AS line
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT conv_id, max(pos) AS n, arg_max(p, pos) AS p FROM t GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, n, p, count(*) AS n_logs FROM e GROUP BY n, p),
proper AS (SELECT DISTINCT t.p FROM t JOIN e ON t.conv_id = e.conv_id AND t.pos < e.n)
SELECT g.conv_id, g.n AS n_turns, g.n_logs, string_agg(t.line, chr(10) ORDER BY t.pos) AS text
FROM g JOIN t USING (conv_id) WHERE g.p NOT IN (SELECT p FROM proper) GROUP BY g.conv_id, g.n, g.n_logs
"""
