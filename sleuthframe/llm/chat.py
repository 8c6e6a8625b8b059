"""Chat formatting of logged conversations, after snapshots that longer ones continue have been collapsed.

A log often holds a conversation again each time it grows. Turns are hashed where they are read; a rolling hash over the turns of
a conversation, in which every turn enters with its place, names each of its prefixes. A conversation whose whole hash is the hash
of a shorter prefix of another is a snapshot: an anti-join of whole hashes against inner prefixes leaves the maximal ones, of equal
ones that with the least conv_id. Only these are rendered.

No task holds a whole conversation: turns are placed and hashed in blocks of turn numbers, whose counts and hashes are added up
over the (``BLOCK`` times fewer) blocks, and texts are rendered in parts of ``PART`` turns. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

BLOCK = 1_024
PART = 256
NO_TURN = -(2**63)
TURN = ["conv_id", "t", "role", "h1", "h2"]


def hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, t, role, h1, h2, text) of the rows that have a conv_id; a null turn comes before all others."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("t"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(11), "text", "role")})


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` (TURN, distinct) with block, pos (from 1, by turn, role and hash) and n, the turns of the conversation."""
    turns = turns.withColumn("block", F.floor(F.col("t") / BLOCK))
    counts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("own"))
    of_conversation = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("own").over(of_conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("conv_id", "block", before.alias("before"), F.sum("own").over(of_conversation).alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("t", "role", "h1", "h2"))
    return turns.withColumn("rank", rank).join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.col("rank")).drop("before", "rank")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, p1, p2): the 128-bit hash of every prefix of every conversation; ``turns`` as :func:`placed` gives them."""
    marks = turns.select("conv_id", "block", "pos", "n", F.xxhash64("pos", "h1").alias("m1"), F.xxhash64(F.lit(13), "pos", "h2").alias("m2"))
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marks.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(m).over(earlier), F.lit(0)).alias(b) for m, b in (("m1", "b1"), ("m2", "b2"))))
    rolled = marks.withColumns({"r1": F.bit_xor("m1").over(running), "r2": F.bit_xor("m2").over(running)}).join(blocks, ["conv_id", "block"])
    return rolled.select("conv_id", "pos", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(prefix: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one continues, one for each class of equal ones."""
    whole = prefix.where("pos = n").groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = prefix.where("pos < n").select("p1", "p2").distinct()
    return whole.join(inner, ["p1", "p2"], "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    """One turn between markers. A marker's beginning inside a text is broken, so that no text can pose as a turn."""
    return F.concat(F.lit("<|im_start|>"), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, part_turns: int = PART) -> DataFrame:
    """conv_id, part, n_turns, turns_in_part and text of every maximal conversation of ``conversations`` (conv_id, turn, role, text).

    Turns go by turn number, equal ones by role and then by a hash of the text. Conversations are compared by their roles and whole
    texts, whatever the numbers of their turns. A part holds up to ``part_turns`` turns, and the texts of all parts in order are
    the whole. A null role is "unknown", a null text empty, and a null turn number comes first; rows without a conv_id are left out.
    A row repeated as it is counts once. An empty table gives no rows; other columns are not read.
    """
    rows = hashed(conversations)
    turns = materialize(placed(rows.select(*TURN).distinct()), "turns")
    kept = turns.join(materialize(maximal(prefixes(turns)), "maximal"), "conv_id", "left_semi").select(*TURN, "pos", "n")
    texts = rows.join(kept, TURN)
    part = F.floor((F.col("pos") - 1) / part_turns).cast("int")
    lines = texts.select("conv_id", part.alias("part"), "n", F.struct("pos", rendered(F.col("role"), F.col("text")).alias("line")).alias("x"))
    # a set, since repeated rows meet here again
    parts = lines.groupBy("conv_id", "part").agg(F.first("n").alias("n_turns"), F.array_sort(F.collect_set("x")).alias("xs"))
    return parts.select("conv_id", "part", "n_turns", F.size("xs").cast("long").alias("turns_in_part"), F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("text"))


ORACLE = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
), prefix AS (
  SELECT conv_id, pos, n, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS h FROM placed
), maximal AS (
  SELECT min(conv_id) AS conv_id FROM prefix WHERE pos = n AND h NOT IN (SELECT h FROM prefix WHERE pos < n) GROUP BY h
)
SELECT conv_id, CAST((pos - 1) // {PART} AS INTEGER) AS part, n AS n_turns, count(*) AS turns_in_part,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed JOIN maximal USING (conv_id) GROUP BY conv_id, (pos - 1) // {PART}, n
"""
