"""A Merkle manifest of a dataset: a leaf per row, a tree per source, and a tree over the sources' roots.

H is the lower-case hex SHA-256 of its inputs one after another, digests as hex text. A leaf is H of the fields in order, each ``-`` if null,
else its UTF-8 length, a colon and its value. In a tree of ``FAN`` children, every FAN consecutive nodes (the last run may be shorter, or one alone) become
one parent, until one node is left; a lone leaf is its own root.

Per level, lag and lead columns of fixed offsets, masked by a node's slot in its run and the run's length, give its
siblings, and the first child's row hashes the parent. Windows go over blocks of whole runs, so a source of any size is
spread over tasks; places in the order come from counted ranges. Levels are written tables of digests alone, each a FAN-th of the one below;
siblings aren't stored but joined on the way down, from the root to the leaves.

Defined cases: null sources are a tree of their own, first in order; null keys come first in their source; rows with equal keys are
ordered by their leaves, equal rows have one proof each; a null text is ``-``, unlike an empty one; an empty table gives an
empty table; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.positions import numbered
from waymark.llm.text import ascii_lower
from waymark.plans.scratch import materialize, release

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs in a window's block.
BLOCK = 256


def leaf_digest(fields: list[Column]) -> Column:
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _siblings(level: DataFrame, fan: int) -> DataFrame:
    """``level`` (tree, pos, n, digest) with ``slot`` in the run and the digests ``left`` and ``right`` of it in the run, as text."""
    order = Window.partitionBy("tree", F.floor(F.col("pos") / (fan * BLOCK))).orderBy("pos")
    slot = F.col("pos") % fan
    run = F.least(F.lit(fan), F.col("n") - (F.col("pos") - slot))
    left = [F.when(slot >= k, F.lag("digest", k).over(order)).otherwise("") for k in range(fan - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("digest", k).over(order)).otherwise("") for k in range(1, fan)]
    return level.withColumns({"slot": slot, "left": F.concat(*left), "right": F.concat(*right)})


def _levels(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """Written tables of the levels, leaves first. A tree's last node is the row with ``n`` = 1."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = _siblings(levels[-1].where("n > 1").select("tree", "pos", "n", "digest"), fan).where("slot = 0")
        up = children.select("tree", F.expr(f"pos div {fan}").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"),
                             F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(materialize(up, "merkle"))
        most = (most + fan - 1) // fan
    return levels


def _proofs(levels: list[DataFrame], fan: int) -> DataFrame:
    """The leaves with ``top``, the root of their tree, and ``proof``: per level the digests on both sides, leaf level first."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    found = None
    for level in reversed(levels):
        alone = level.where("n = 1").withColumns({"top": F.col("digest"), "proof": none})
        if found is not None:
            up = found.select("tree", F.col("pos").alias("_up"), "top", F.col("proof").alias("_rest"))
            below = _siblings(level.where("n > 1"), fan).withColumn("_up", F.expr(f"pos div {fan}")).join(up, ["tree", "_up"])
            below = below.withColumn("proof", F.concat(F.array(F.struct("left", "right")), "_rest"))
            alone = alone.unionByName(below.select(*alone.columns))
        found = alone
    return found


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to along its proof."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def merkle_manifest(docs: DataFrame, also: dict[str, Column] | None = None, source: str = "source", key: str = "doc_id",
                    fields: tuple[str, ...] = FIELDS, fan: int = FAN) -> DataFrame:
    """Per row: the key as ``doc_id``, ``leaf``, ``subroot`` (of its source), ``root``, and ``proof``, siblings from the leaf to the root.

    ``also``: further columns to carry along, taken from ``docs``.
    """
    also = also or {}
    rows = materialize(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("tree"),  # null before all, never null itself
        F.col(key).alias("doc_id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), *[c.alias(name) for name, c in also.items()]), "leaves")
    leaves = materialize(numbered(rows, ["tree"], ["doc_id", "digest"]), "merkle")
    release(rows)
    levels = _levels(leaves, fan)
    roots = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.where("n = 1").select("tree", "digest"))
    roots = materialize(roots.select(F.lit("").alias("all"), F.col("tree").alias("of"), "digest"), "subroots")
    forest = materialize(numbered(roots, ["all"], ["of"]).select(F.col("all").alias("tree"), "pos", "n", "digest", "of"), "merkle")
    top = _proofs(_levels(forest, fan), fan).select(F.col("of").alias("tree"), F.col("top").alias("root"), F.col("proof").alias("_above"))
    out = _proofs(levels, fan).join(top, "tree")
    return out.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root",
                      F.concat("proof", "_above").alias("proof"), *also)


def audit_tampering(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` checked against a copy of it in which some texts lost their capitals.

    A row is tampered with where 5 divides the CRC-32 of its decimal doc_id (null: never); ``verified`` tells whether its leaf leads to the root.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, leaf_digest([ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    out = merkle_manifest(docs, {"claimed": changed})
    out = out.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
