"""Chat formatting with collapse of cumulative snapshots. Native: DataFrame functions only.

Loggers often store a conversation again after every turn. Each prefix of a conversation
has a rolling hash: the XOR, over its turns, of hashes that include the turn's place. A
conversation whose whole hash is a proper prefix's of another is dropped by an anti-join, and
of equal conversations the one with the smallest id stays. The rest is rendered.

A conversation of any length is processed in chunks of CHUNK turn numbers: the running counts
and hashes are accumulated over chunk sums first, then within chunks. Rendered text
comes in parts of at most one chunk each, so that no row grows without bound.

Defined cases: turns are ordered by number, then role and text; null numbers come last; a null role reads
``unknown``, a null text is empty; rows with a null conversation id are one conversation;
repeated rows are repeated turns; marks inside a role or text are broken by a space; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize

CHUNK = 1024
START, END = "<|im_start|>", "<|im_end|>"
#: What begins a mark inside a turn, and what it becomes, so that no turn can forge another.
FORGED, BROKEN = "<|im_", "<| im_"


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: conv, chunk, place (from 1), role, text, and hashes a, b of the conversation up to this turn."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("chunk", F.coalesce(F.expr(f"turn div {CHUNK}"), F.lit(2**62)))
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    sums = t.groupBy("conv", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    t = t.withColumn("at", F.row_number().over(inside))
    t = t.join(sums, t["conv"].eqNullSafe(sums["c"]) & (t["chunk"] == sums["k"])).withColumn("place", F.col("at") + F.col("earlier"))
    t = t.withColumn("ha", F.xxhash64("place", "role", "text")).withColumn("hb", F.xxhash64("text", "role", "place"))
    each = t.groupBy("conv", "chunk").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    each = each.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), *[F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"{h}0") for h in ("ha", "hb")])
    upto = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    t = t.drop("c", "k")
    t = t.join(each, t["conv"].eqNullSafe(each["c"]) & (t["chunk"] == each["k"]))
    return t.select("conv", "chunk", "place", "role", "text", F.col("ha0").bitwiseXOR(F.bit_xor("ha").over(upto)).alias("a"),
                    F.col("hb0").bitwiseXOR(F.bit_xor("hb").over(upto)).alias("b"))


def maximal(hashed: DataFrame) -> DataFrame:
    """``(conv, n_turns, copies)`` of the conversations that no other one extends, once per content."""
    ends = hashed.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("end"))
    whole = ends.select("conv", "end.place", "end.a", "end.b")
    distinct = whole.groupBy("place", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    # a turn that is not its conversation's last closes a proper prefix
    n = ends.select(F.col("conv").alias("c"), F.col("end.place").alias("n"))
    proper = (hashed.select("conv", "place", "a", "b").join(n, F.col("conv").eqNullSafe(F.col("c")))
              .where("place < n").select("place", "a", "b").distinct())
    return distinct.join(proper, ["place", "a", "b"], "left_anti").select("conv", F.col("place").alias("n_turns"), "copies")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per kept conversation and part: conv, part (from 0), n_turns, copies (equal conversations) and rendered text."""
    hashed = materialize(prefixes(turns, conv, turn, role, text), "turns")
    kept = maximal(hashed).withColumnRenamed("conv", "kept")
    plain = lambda c: F.replace(c, F.lit(FORGED), F.lit(BROKEN))
    shown = F.concat(F.lit(START), plain(F.col("role")), F.lit("\n"), plain(F.col("text")), F.lit(END + "\n"))
    rows = hashed.join(kept, hashed["conv"].eqNullSafe(kept["kept"]))
    parts = rows.groupBy("conv", F.expr(f"(place - 1) div {CHUNK}").alias("part")).agg(
        F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", shown.alias("s")))), lambda x: x["s"]), "").alias("rendered"))
    return parts.select(F.col("conv").alias(conv), "part", F.col("n_turns").cast("long").alias("n_turns"), "copies", "rendered")
