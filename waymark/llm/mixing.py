"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a seeded hash, once per pass over the source.
A document's virtual finish time is the running sum of its source's words, itself
included, over the source's target. All documents are ordered by that time and the mix is
the longest start of this order that stays within the total budget; so every source is
served in proportion to its target, up to one document.

No source is summed in one task: documents fall into hash ranges, small enough for a
window each, and only the ranges' sums are accumulated. Likewise the cut is found on sums
by ranges of finish time and then within the one range that holds it. As the documents
taken of a source and pass are those up to one place in its shuffle, ``mix`` filters by that
place and never joins texts by document.

Defined cases: a null source is one more source, after all others; null and blank texts have
size 0 and ride along free; a source without words gets target 0; equal rows
are one document, taken or left together; rows with a null key are drawn by their text, and those with an
equal key follow each other, ordered by their texts' hash; an empty table gives an empty mix; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize
from waymark.llm.text import words

WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words are used so often at most.
PASSES = 2


def n_ranges(rows: int) -> int:
    """Hash ranges per source and pass, and ranges of finish time: about the root of the number of rows, so that neither the ranges nor what one holds grow as fast as the data."""
    return 1 << max(6, math.ceil(math.log2(max(1, rows)) / 2))


def draw(key: Column, turn: Column, seed: str, h: Column) -> Column:
    """A number in [0, 2**32) for a document (its key or, without one, its text's hash ``h``) and pass, from SHA-256."""
    named = F.concat_ws("|", F.lit(seed), turn.cast("string"), F.coalesce(key.cast("string"), F.concat(F.lit("h"), h.cast("string"))))
    return F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, passes: int = PASSES) -> DataFrame:
    """``(source, source_size)`` per source → with weight and target.

    Sources in code point order, null last, take the weights in turn and share ``share``
    of all words. No target exceeds ``passes`` times its source's size: sources are filled up
    in order of cap over weight, the rest of the budget going to the others by weight.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    w = (sizes.withColumn("turn", F.pmod(F.row_number().over(place) - 1, F.lit(n)))
         .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
         .withColumn("cap", (passes * F.col("source_size")).cast("double")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = (w.withColumn("total", (F.sum("source_size").over(Window.partitionBy()) * share).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
         # the first source, in this order, that the level leaves below its cap sets the level for all after it
         .withColumn("free", F.col("weight") * F.col("level") < F.col("cap"))
         .withColumn("set", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))))
    return w.select("source", "source_size", "weight", F.coalesce(F.col("weight") * F.col("set"), F.col("cap")).alias("target"))


def schedule(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
             seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sized, plan, last)`` of the mix.

    sized: key, source, size per row. plan: targets per source. last: per source and pass, the
    place (u, h) in its shuffle up to which documents are taken.
    """
    size = F.size(words(F.col(text))) if size is None else size
    sized = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.cast("long").alias("size"),
                                    F.xxhash64(text).alias("h")), "sizes")
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "targets")
    rows = sized.groupBy("key", "source", "size", "h").agg(F.count("*").alias("n"))  # equal rows travel as one
    ranges = n_ranges(sized.count())
    turns = rows.withColumn("words", F.col("size") * F.col("n")).withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(PASSES)])))
    turns = turns.withColumn("u", draw(F.col("key"), F.col("pass"), seed, F.col("h"))).withColumn("range", F.expr(f"u div {2**32 // ranges}"))
    by = ["source", "pass", "range"]
    sums = turns.groupBy(*by).agg(F.sum("words").alias("words"))
    order = Window.partitionBy("source").orderBy("pass", "range")  # PASSES * ranges rows of a source
    sums = sums.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("range").alias("r"),
                       (F.sum("words").over(order) - F.col("words")).alias("earlier"))
    within = Window.partitionBy(*by).orderBy("u", "h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = (turns.withColumn("inside", F.sum("words").over(within))
             .join(sums, turns["source"].eqNullSafe(sums["s"]) & (turns["pass"] == sums["p"]) & (turns["range"] == sums["r"])))
    goal = plan.select(F.col("source").alias("t"), "target")
    timed = materialize(timed.join(goal, timed["source"].eqNullSafe(goal["t"]))
                        .select("source", "pass", "u", "h", "words",
                                F.when(F.col("target") > 0, (F.col("earlier") + F.col("inside")) / F.col("target")).otherwise(0.0).alias("finish")), "times")
    cut = _cut(timed, plan, ranges)
    taken = timed.where(F.col("finish") <= cut).groupBy("source", "pass").agg(F.max(F.struct("u", "h")).alias("last"))
    return sized, plan, materialize(taken.select("source", "pass", "last.u", "last.h"), "last")


def _cut(timed: DataFrame, plan: DataFrame, ranges: int) -> float:
    """The latest finish time within the budget: range-sort, accumulate, truncate. Three numbers reach the driver."""
    budget = (plan.agg(F.sum("target")).first()[0] or 0.0) + 1e-6
    # sources without oversized documents are done by a time of 1, give or take one document; later times share a few wide ranges
    slot = F.when(F.col("finish") < 4, F.floor(F.col("finish") * ranges)).otherwise(4 * ranges + F.floor(F.log2(F.greatest("finish", F.lit(4.0))) * 64))
    ranged = timed.withColumn("slot", slot.cast("long"))
    slots = ranged.groupBy("slot").agg(F.sum("words").alias("words"), F.max("finish").alias("last"))  # some 4 * ranges rows
    running = slots.withColumn("up_to", F.sum("words").over(Window.orderBy("slot")))
    over = running.where(F.col("up_to") > budget).orderBy("slot").select("slot", (F.col("up_to") - F.col("words")).alias("before")).first()
    if over is None:
        return float("inf")
    inside = (ranged.where(F.col("slot") == over["slot"]).groupBy("finish").agg(F.sum("words").alias("words"))
              .withColumn("up_to", over["before"] + F.sum("words").over(Window.orderBy("finish")))  # one range of finish times
              .where(F.col("up_to") <= budget).agg(F.max("finish")).first()[0])
    if inside is None:
        inside = slots.where(F.col("slot") < over["slot"]).agg(F.max("last")).first()[0]
    return inside if inside is not None else -1.0


def _served(rows: DataFrame, last: DataFrame, seed: str) -> Column:
    """Number of passes in which a row of (key, source, h) is taken, given last's places as columns."""
    total = F.lit(0)
    for i in range(PASSES):
        u = draw(F.col("key"), F.lit(i), seed, F.col("h"))
        end = F.col("ends")[i]
        total = total + F.when(F.struct(u.alias("u"), F.col("h").alias("h")) <= end, 1).otherwise(0)
    return total


def _with_ends(rows: DataFrame, last: DataFrame) -> DataFrame:
    ends = last.groupBy(F.col("source").alias("_s")).agg(
        F.map_from_entries(F.collect_list(F.struct("pass", F.struct("u", "h")))).alias("ends"))  # PASSES entries
    return rows.join(ends, rows["source"].eqNullSafe(ends["_s"]), "left").drop("_s")


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", **how) -> DataFrame:
    """Per row: key, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sized, plan, last = schedule(docs, key, source, text, seed=seed, **how)
    p = plan.select(F.col("source").alias("_p"), "source_size", "target")
    rows = _with_ends(sized, last)
    rows = rows.join(p, rows["source"].eqNullSafe(p["_p"]))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target",
                       (F.col("size") * _served(rows, last, seed)).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often as it takes them, with all their columns."""
    _, _, last = schedule(docs, key, source, text, seed=seed, **how)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
                       F.xxhash64(text).alias("h"))
    rows = _with_ends(rows, last)
    return (rows.withColumn("times", _served(rows, last, seed)).where("times > 0")
            .withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*"))
