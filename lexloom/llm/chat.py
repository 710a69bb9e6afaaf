"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows.  Each turn gets a hash of its position, role
and text; the exclusive or of these over a conversation's first turns is a rolling hash of that prefix
(two independent 64-bit hashes).  A conversation whose whole sequence is a proper prefix of a longer one's
goes by an anti-join; of equal ones that of the smallest id stays; the rest are rendered turn by turn.

Positions and prefixes are computed in two levels (within blocks of turn numbers, then over the blocks), so
a conversation that holds a large share of all rows is spread over many tasks until its one row is rendered.

Defined cases: turns order by turn (null first), then role and text; rows with a null conv_id are one
conversation; a null role reads ``unknown`` and a null text is empty when rendered, but they differ from
these as turns; repeated turns are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import stored, table

BLOCK_TURNS = 1_024

ORACLE = """
WITH t AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, pos, n,
    string_agg(coalesce('v' || role, 'n') || chr(30) || coalesce('v' || text, 'n') || chr(31), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM t),
maximal AS (
  SELECT min(f.conv_id) AS conv_id FROM p f LEFT JOIN (SELECT DISTINCT prefix FROM p WHERE pos < n) longer ON f.prefix = longer.prefix
  WHERE f.pos = f.n AND longer.prefix IS NULL GROUP BY f.prefix)
SELECT t.conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN maximal ON t.conv_id IS NOT DISTINCT FROM maximal.conv_id GROUP BY t.conv_id
"""


def _marked(name: str):
    return F.coalesce(F.concat(F.lit("v"), F.col(name)), F.lit("n"))


def turns_of(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """key, block, pos, role, text, and the two prefix hashes a, b up to each turn."""
    turns = conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long").alias("block"),
        "turn",
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    inside = W.Window.partitionBy("key", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    earlier = W.Window.partitionBy("key").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = turns.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("key", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = turns.withColumn("row", F.row_number().over(inside)).join(offsets, ["key", "block"])
    pos = F.col("row") + F.col("offset")
    hashed = placed.select(
        "conv_id", "key", "block", "row", pos.alias("pos"), "role", "text",
        F.xxhash64(pos, _marked("role"), _marked("text")).alias("h"),
        F.xxhash64(F.lit("second"), _marked("text"), pos, _marked("role")).alias("g"),
    )
    hashed = stored(hashed)
    so_far = W.Window.partitionBy("key", "block").orderBy("row").rowsBetween(W.Window.unboundedPreceding, 0)
    whole = hashed.groupBy("key", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    before = whole.select("key", "block", F.coalesce(F.bit_xor("h").over(earlier), F.lit(0)).alias("h0"), F.coalesce(F.bit_xor("g").over(earlier), F.lit(0)).alias("g0"))
    rolled = hashed.withColumn("h", F.bit_xor("h").over(so_far)).withColumn("g", F.bit_xor("g").over(so_far)).join(before, ["key", "block"])
    return rolled.select("conv_id", "key", "pos", "role", "text", F.col("h").bitwiseXOR(F.col("h0")).alias("a"), F.col("g").bitwiseXOR(F.col("g0")).alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """key, n_turns of the conversations that stay, of turns as turns_of() gives them."""
    prefixes = turns.select("conv_id", "key", "pos", "a", "b")
    totals = prefixes.groupBy("key").agg(F.max("pos").alias("n_turns"))
    marked = prefixes.join(totals, "key")
    longer = marked.where("pos < n_turns").select("pos", "a", "b").distinct()
    full = marked.where("pos = n_turns")
    # Ids compare as they are; a conversation without one comes last among equals.
    kept = full.groupBy("pos", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "key")).alias("one"))
    return kept.join(longer, ["pos", "a", "b"], "left_anti").select("one.key", F.col("pos").cast("long").alias("n_turns"))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, n_turns, rendered of every conversation that is no prefix of another."""
    turns = stored(turns_of(conversations, block_turns))
    kept = collapse(turns)
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    lines = turns.select("conv_id", "key", "pos", line.alias("line")).join(kept, "key")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    rendered = F.array_join(F.transform(ordered, lambda x: x["line"]), "")
    return lines.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), rendered.alias("rendered")).drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
