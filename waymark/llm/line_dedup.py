"""Lines that many documents share are dropped from all of them.

Native: column expressions and joins only. Texts are split at line ends and exploded; each line's key is the line
without white space at both ends and with A-Z lower-cased. Keys are hashed, documents counted per hash, and lines whose
key is found in ``min_documents`` or more documents are dropped; the others are put together again by position.

A key travels as the first 128 bits of its SHA-256, so texts can't be planted that collide. A document
counts once for a key however often it holds it, so its keys are made distinct before they are exploded, and tasks send
one count a key. Of the shared keys, those in so many documents that there can be at most ``COMMON`` of them are
broadcast; rarer ones, if there are any, are joined by hash, where none of them is hot, as its documents are few. Only places of dropped lines go
back to the documents, by document key and text hash; documents that are equal in both fall alike and are split by AQE.

Defined cases: null text is one empty line; empty keys (blank lines) are never dropped; a row is a document, so equal rows count each
and are returned each; of a document all of whose lines fall the empty text stays; a null document key is a key like others; an empty table
gives an empty table; other columns are never read by ``shared_lines`` and pass through ``drop_shared_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import ascii_lower
from waymark.plans.scratch import materialize, release

SPACES = " \t\n\x0b\x0c\r"
MIN_DOCUMENTS = 10
MIN_LENGTH = 1
#: Most keys that are broadcast, 16 bytes each.
COMMON = 200_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column) -> Column:
    """128 bits as hex."""
    return F.left(F.sha2(key, 256), F.lit(32))


def shared_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, text: str = "text") -> DataFrame:
    """``(h, n)``: 16-byte hashes of the keys that ``min_documents`` rows or more hold, with their number."""
    keys = F.filter(F.transform(lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_length)
    hashes = F.array_distinct(F.transform(keys, _hash))
    one = docs.select(F.explode(hashes).alias("h")).select(F.unhex("h").alias("h"))
    return one.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)


def _dropped(placed: DataFrame, shared: DataFrame, common: int) -> DataFrame:
    """Rows of ``placed`` whose hash is shared."""
    found = shared.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
    if found["keys"] <= common:
        return placed.join(F.broadcast(shared.select("h")), "h", "left_semi")
    bar = found["places"] // common + 1  # at most `common` keys can be in so many documents
    frequent, rest = shared.where(F.col("n") >= bar).select("h"), shared.where(F.col("n") < bar).select("h")
    often = placed.join(F.broadcast(frequent), "h", "left_semi")
    # a hot key never meets the hash join: it is taken out first
    return often.unionByName(placed.join(F.broadcast(frequent), "h", "left_anti").join(rest, "h", "left_semi"))


def _places(docs: DataFrame, min_documents: int, min_length: int, key: str, text: str, common: int) -> DataFrame:
    """Per document key and text hash, the places of dropped lines, if there are any."""
    shared = materialize(shared_lines(docs, min_documents, min_length, text), "shared_lines")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null and _text <> ''")
    placed = (rows.select("_key", F.unhex(F.sha2("_text", 256)).alias("_text_hash"), F.posexplode(lines(F.col("_text"))).alias("_at", "_line"))
              .withColumn("_line", line_key(F.col("_line"))).where(F.char_length("_line") >= min_length)
              .select("_key", "_text_hash", "_at", F.unhex(_hash(F.col("_line"))).alias("h")))
    places = (_dropped(placed, shared, common).groupBy("_key", "_text_hash")
              .agg(F.sort_array(F.collect_set("_at")).alias("_dropped")))
    out = materialize(places, "dropped_lines")
    release(shared)
    return out


def drop_shared_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, key: str = "doc_id",
                      text: str = "text", common: int = COMMON) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept_text`` added; columns of these names are replaced."""
    places = _places(docs, min_documents, min_length, key, text, common)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    left = docs.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("_hash"))
    same = left["_key"].eqNullSafe(places["_key"]) & (left["_hash"] == places["_text_hash"])
    joined = left.join(places.select("_key", "_text_hash", "_dropped"), same, "left").select("_row", "_dropped")
    places_left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_dropped")
    kept = F.transform(places_left, lambda i: F.get("_lines", i))
    out = joined.withColumn("_lines", lines(F.col("_row")[text]))
    return out.select(
        *[F.col("_row")[c].alias(c) for c in names], F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_dropped").isNull(), F.coalesce(F.col("_row")[text], F.lit("")))
        .otherwise(F.array_join(kept, "\n")).alias("kept_text"))
