"""Benchmark decontamination by greedy string tiling.

Words are runs without white space or ASCII punctuation, A-Z lower-cased. Seeds are the
hashes of all runs of ``least`` words (running Karp-Rabin). Documents keep the seeds that
the benchmark has, these are joined with the benchmark's seeds, and for each document and
item with enough of them the longest match of unmarked words is marked again and again,
down to ``least`` words. Tiles may come in any order, so reordered passages count. A document
is contaminated when the tiles cover ``threshold`` of an item's words.

A document and an item meet only through seeds other than the item's most common ones, of which it can
spare as many as still leave a match; so a phrase that everybody uses doesn't pair all documents with all items.
Seeds of all documents never travel: each task looks its seeds up in the benchmark's,
which it holds BLOCK words at a time; a larger benchmark takes one pass per block.

Defined cases: null, empty and short texts (fewer than ``least`` words) have no seeds, so items
that short are never matched; equal items count each; rows with an equal or null key and other
texts are documents of their own, told apart by the hash of the text; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.hashing import shingles, word_hashes
from waymark.plans.scratch import materialize

LEAST, THRESHOLD = 5, 0.5
#: Pairs of places expanded at once.
PAIRS = 1_000_000
#: Benchmark words that a task holds at once (8 bytes a word).
BLOCK = 2_000_000


def tile(places: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in document, length) from seed places (item, document)."""
    q, p = np.array(sorted(set(places)), np.int64).reshape(-1, 2).T
    return tile_runs(_runs(q, p), least)


def _runs(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``(start in item, start in document, seeds)`` of the runs of seeds that go on in both texts."""
    order = np.lexsort((q, p - q))
    q, p = q[order], p[order]
    first = np.ones(len(q), bool)
    first[1:] = (p[1:] - q[1:] != p[:-1] - q[:-1]) | (q[1:] != q[:-1] + 1)
    at = np.flatnonzero(first)
    return np.stack([q[at], p[at], np.diff(np.append(at, len(q)))], axis=1)


def matched_runs(item: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs between an item's seeds (by place) and a document's (with their places).

    Where a text repeats itself so much that all pairs of places would not fit in memory, texts are compared shift by shift.
    """
    order = np.argsort(item, kind="stable")
    low, high = (np.searchsorted(item[order], seeds, side) for side in ("left", "right"))
    count = high - low
    if count.sum() <= PAIRS:
        ends = np.cumsum(count)
        q = order[np.repeat(low - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return _runs(q, np.repeat(places, count))
    dense, there = np.zeros(int(places.max()) + 1, item.dtype), np.zeros(int(places.max()) + 1, bool)
    dense[places], there[places] = seeds, True
    found = []
    for shift in range(1 - len(item), len(dense)):
        q0, p0 = max(0, -shift), max(0, shift)
        size = min(len(item) - q0, len(dense) - p0)
        q = q0 + np.flatnonzero((item[q0:q0 + size] == dense[p0:p0 + size]) & there[p0:p0 + size])
        if len(q):
            found.append(_runs(q, q + shift))
    return np.concatenate(found)


def tile_runs(runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Mark the longest run of unmarked words, cut the others by it, and so on down to ``least`` words."""
    heap = [(1 - least - n, q, p) for q, p, n in runs.tolist()]
    heapq.heapify(heap)
    marked_q, marked_p = (np.zeros(1 + max((x[i] - x[0] for x in heap), default=0), bool) for i in (1, 2))
    tiles = []
    while heap:
        size, q, p = heapq.heappop(heap)
        free = np.flatnonzero(~(marked_q[q:q - size] | marked_p[p:p - size]))
        if len(free) == -size:
            tiles.append((q, p, -size))
            marked_q[q:q - size] = marked_p[p:p - size] = True
            continue
        for part in np.split(free, np.flatnonzero(np.diff(free) != 1) + 1):  # what is left of it
            if len(part) >= least:
                heapq.heappush(heap, (-len(part), q + int(part[0]), p + int(part[0])))
    return tiles


def _seeds(rows: DataFrame, least: int, among: np.ndarray | None) -> DataFrame:
    """``(key, row, seed, place, words)`` of rows' seeds; ``among``: sorted, only these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words, offsets = word_hashes(part.column("text").to_pylist(), marks=True)
                index, seeds, places = [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if b - a < least:
                        continue
                    h = shingles(words[a:b], least)
                    hit = np.arange(len(h)) if among is None else np.flatnonzero(
                        among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h) if len(among) else np.empty(0, int)
                    if len(hit):
                        index.append(np.full(len(hit), i))
                        seeds.append(h[hit])
                        places.append(hit)
                if index:
                    who = np.concatenate(index)
                    sizes = np.diff(offsets)
                    yield pa.RecordBatch.from_arrays([
                        part.column("key").take(pa.array(who)), part.column("row").take(pa.array(who)),
                        pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64)), pa.array(sizes[who])],
                        names=["key", "row", "seed", "place", "words"])

    return rows.mapInArrow(run, "key long, row long, seed long, place long, words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, words_covered, item_words, coverage, tiles)`` per document and item at or above the threshold.

    tiles: array of (item_start, doc_start, words).
    """
    return _found(docs, benchmark, key, text, item, item_text, least, threshold).drop("row")


def _found(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """What ``contaminated`` returns, and row: the hash of the document's text."""
    def rows(df: DataFrame, k: str, t: str) -> DataFrame:
        return df.select(F.col(k).cast("long").alias("key"), F.xxhash64(t).alias("row"), F.col(t).alias("text"))

    items = materialize(_seeds(rows(benchmark, item, item_text), least, None)
                        .toDF("item", "item_row", "seed", "q", "item_words"), "items")
    n = items.count()
    blocks = max(1, -(-n // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
            out = []
            for r in batch.to_pylist():
                wanted = np.array([x["seed"] for x in sorted(r["wanted"], key=lambda x: x["q"])], np.int64)
                seeds, places = (np.array([x[c] for x in r["hits"]], np.int64) for c in ("seed", "place"))
                tiles = tile_runs(matched_runs(wanted, seeds, places), least)
                words = sum(size for _, _, size in tiles)
                if words >= threshold * r["item_words"]:
                    out.append((r["key"], r["row"], r["item"], words, r["item_words"], [{"item_start": q, "doc_start": p, "words": s} for q, p, s in sorted(tiles)]))
            kind = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([o[i] for o in out], pa.int64()) for i in range(5)), pa.array([o[5] for o in out], kind)],
                names=["key", "row", "item", "words_covered", "item_words", "tiles"])

    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "item_row"), F.lit(blocks)) == b)
        held = np.unique(np.array([r[0] for r in part.select("seed").distinct().collect()], np.int64).view(np.uint64))
        hits = materialize(_seeds(rows(docs, key, text), least, held).select("key", "row", "seed", "place").distinct(), "hits")
        # tiles that cover the threshold hold this many places of the item's at least, so one of them is not among its most common ones
        often = hits.groupBy("seed").agg(F.count("*").alias("often"))
        each = ["item", "item_row"]
        ranked = part.join(often, "seed", "left").withColumn("turn", F.row_number().over(Window.partitionBy(*each).orderBy(F.desc_nulls_last("often"), "q")))  # places of one item
        telling = ranked.where(F.col("turn") > F.ceil(threshold * F.col("item_words") / least) - 1)
        pairs = (hits.select("key", "row", "seed").distinct().join(telling.select(*each, "item_words", "seed").distinct(), "seed")
                 .select("key", "row", *each, "item_words").distinct())
        wanted = part.groupBy(*each).agg(F.collect_list(F.struct("q", "seed")).alias("wanted"))  # one item's places
        held_by = hits.groupBy("key", "row").agg(F.collect_list(F.struct("place", "seed")).alias("hits"))  # one document's places
        same = lambda x, y, names: reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[c]) for c in names])
        both = pairs.join(wanted, same(pairs, wanted, each)).select(pairs["*"], "wanted")
        both = both.join(held_by, same(both, held_by, ["key", "row"])).select(both["*"], "hits")
        tiled = both.select("key", "row", "item", "item_words", "wanted", "hits").mapInArrow(
            run, "key long, row long, item long, words_covered long, item_words long, tiles array<struct<item_start:long,doc_start:long,words:long>>")
        found = tiled if found is None else found.unionByName(tiled)
    return found.select(F.col("key").alias(key), "row", F.col("item").alias(item), "words_covered", "item_words",
                        (F.col("words_covered") / F.col("item_words")).alias("coverage"), "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without contaminated documents, judged by key and text; all columns stay."""
    found = _found(docs, benchmark, key, text, **how)
    gone = materialize(found.select(F.col(key).alias("_key"), F.col("row").alias("_row")).distinct(), "gone")
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["_key"]) & (F.xxhash64(docs[text]) == gone["_row"]), "left_anti")
