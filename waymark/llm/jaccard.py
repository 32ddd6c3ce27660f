"""Exact n-gram Jaccard self-join by PartEnum signatures, as links and components.

Sets with similarity g or more differ in at most k = floor((n + m) (1 - g) / (1 + g)) elements,
n and m being their sizes. Sizes fall into bands (n < 16, then doubling). In a band
the shingle domain is cut into parts; k differing elements touch at most k parts, so two
linked sets agree on all but k of their non-empty parts. PartEnum pairs parts up (first
level) and enumerates, within a pair, the subsets that one difference leaves whole (second level, of two
halves one): that is one signature a part, and k + 1 of them suffice. Below 16 shingles every pair of
the first k + 2 parts is enumerated. Each set lists its non-empty parts in one global order, so that
linked sets share a signature among their first ones. A set whose smaller
partner may lie in the band below signs for that band too. The global order puts parts
last that hold frequent shingles only, which keeps common passages out of the signatures
without touching the guarantee.

Most sets that share a signature aren't similar, and are told apart without their shingles: each set has a
parity bitmap of one to two bits a shingle, and two bitmaps differ in no more bits than their
sets differ in elements. Only pairs within k bits are verified, on the sets.

Buckets of equal members are one bucket. Buckets never emit all their pairs. In one of up to SMALL members, each
member first meets the smallest one within k bits; when the links found are joined into components, pairs within k bits
of different components follow. In larger ones every member is compared with the smallest
node, then with a node of the bucket's largest component. Buckets of one
component are settled. In the others, nodes that can't reach the threshold by the number
of their shingles that any other open node has are dropped, and the few that remain are
compared across components, block by block.

No bucket, shingle or group of any size is one task. Of a signature that several sets of a slice share, two sets go where all its
rows meet, and tell that it is shared; the others stay in parts. The same holds for the shingles of open nodes. What
a bucket's rows must know of it, its aggregates tell them part by part.

Defined cases: null, empty and blank texts have the empty set and link with nothing; fewer
words than n make one shingle; equal sets are one node and always link; rows with an equal
or null key are documents of their own, told apart by their texts; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.hashing import distinct_runs, mix, set_key, word_hashes
from waymark.llm.positions import numbered
from waymark.plans.components import connected_components
from waymark.plans.scratch import materialize, release

#: At most so many shingles are ordered last, and nodes with many copies sign once.
MAX_FREQUENT, MAX_COPIED = 200_000, 100_000
#: Rows worked on at once in a task.
SLICE = 1000
#: Largest bucket whose members are compared by their bitmaps in one task.
SMALL = 64
#: Nodes per block, and shingles per product, in the last comparison.
BLOCK, WIDE = 128, 16_384
#: Slices whose shingles are counted together.
COUNTED = 4
#: Bits of the filter that names the wanted texts (8 MB, whatever the number of texts).
FILTER = 1 << 26
#: A signature of so many sets of a slice is a crowd there, and a crowd's rows lie in so many parts.
CROWD, SPREAD = 4, 256
#: Bytes kept of a shingle's hash in verification.
KEPT = 6
#: Edges that a task joins into stars at once.
HELD = 500_000
_U = np.uint64
_SMALL = 16


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    return distinct_runs(*word_hashes(texts.to_pylist()), n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def parity(s: np.ndarray) -> bytes:
    """A bitmap of a set: bit i tells whether an odd number of elements fall on i. Widths are powers of two, 64 at least."""
    width = max(64, 1 << len(s).bit_length())
    odd = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """Per row: key, row (text hash), n_shingles, node, bits; and shingles frequent in some slices as (key = shingle, n_shingles = rows, others null)."""

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, rows = np.unique(np.concatenate(sets), return_counts=True)
        many = rows >= max(3, len(sets) // 500)
        size = int(many.sum())
        return pa.RecordBatch.from_arrays([
            pa.array(found[many].view(np.int64)), pa.nulls(size, pa.int64()), pa.array(rows[many].astype(np.int64)),
            pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names=["key", "row", "n_shingles", "node", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _slices(batches):
            sets = _sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())],
                names=["key", "row", "n_shingles", "node", "bits"])
            held += sets
            if len(held) >= COUNTED * SLICE:
                yield often(held)
                held = []
        if held:
            yield often(held)

    return docs.withColumn("row", F.xxhash64("text")).mapInArrow(run, "key long, row long, n_shingles long, node long, bits binary")


def signatures(sets: list[np.ndarray], frequent: np.ndarray, g: float) -> tuple[np.ndarray, np.ndarray]:
    """``(signature, index of its set)`` for all sets; ``frequent``: sorted shingles that go last."""
    sigs, owners = [], []
    large: list[tuple[int, int, int, int]] = []
    for i, s in enumerate(sets):
        size = len(s)
        if size < 2:
            continue  # links only with equal sets, which are one node
        band = size.bit_length() - 1 if size >= _SMALL else 3
        for b in (band, band - 1):
            if b < band and (band == 3 or -(-size * g // 1) > 2 ** band - 1):
                continue
            k = _differ(size, int(size / g + 1e-9) if b == band else 2 ** band - 1, g)
            if b > 3:
                large.append((i, b, size, k))
            else:
                last = _among(s, frequent)
                first = np.concatenate([s[~last], s[last]])[:k + 2]
                a, c = np.triu_indices(len(first), 1)
                sigs.append(mix(first[a] * _U(0x9E3779B97F4A7C15) + mix(first[c])))
                owners.append(np.full(len(a), i))
    if large:
        index, bands, sizes, differ = (np.array(x) for x in zip(*large, strict=True))
        flat = np.concatenate([sets[i] for i in index])
        turn = np.repeat(np.arange(len(index)), sizes)
        parts = 2 ** bands  # half of the band's upper size
        base = np.concatenate([[0], np.cumsum(parts)])
        h = mix(flat)
        slot = base[turn] + (h % parts[turn].astype(_U)).astype(np.int64)
        low = np.bincount(slot, (h & _U(0xFFFFFFFF)).astype(float), base[-1])
        high = np.bincount(slot, (h >> _U(32)).astype(float), base[-1])
        rare = np.bincount(slot, ~_among(flat, frequent), base[-1]) > 0
        full = np.flatnonzero(np.bincount(slot, minlength=base[-1]))
        who = np.searchsorted(base, full, "right") - 1
        sig = mix(low[full].astype(_U) + (high[full].astype(_U) << _U(32)))
        sig = mix(sig + (full - base[who]).astype(_U) * _U(0xD6E8FEB86659FD93) + bands[who].astype(_U))
        rare = rare[full]
        starts = np.searchsorted(who, np.arange(len(index) + 1))
        before = np.concatenate([[0], np.cumsum(rare)])
        n_rare = before[starts[1:]] - before[starts[:-1]]
        rank_rare = before[:-1] - before[starts[who]]
        rank_last = np.arange(len(who)) - starts[who] - rank_rare + n_rare[who]
        take = np.where(rare, rank_rare, rank_last) <= differ[who]
        sigs.append(sig[take])
        owners.append(index[who[take]])
        few = np.flatnonzero(np.diff(starts) <= differ)  # too few parts for the guarantee: these meet each other
        sigs.append(mix(bands[few].astype(_U) * _U(0xA24BAED4963EE407)))
        owners.append(index[few])
    if not sigs:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _differ(n: int, m: int, g: float) -> int:
    """Most elements in which linked sets of sizes n and m differ."""
    return int(np.floor((n + m) * (1 - g) / (1 + g) + 1e-9))


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def crowds(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sig, node, part)`` of a slice's rows. Part is 0 but for crowds: of these the smallest and the largest node are in part 0, the others in parts from 1."""
    if not len(sig):
        return sig, node, np.empty(0, np.int32)
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    counts = np.diff(np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True]))))
    many = np.repeat(counts >= CROWD, counts)
    s, v = sig[many], node[many]
    order = np.lexsort((v, s))
    s, v = s[order], v[order]
    other = np.concatenate(([True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])))[:len(s)]
    s, v = s[other], v[other]
    ends = np.concatenate(([True], s[1:] != s[:-1], [True]))
    part = np.where(ends[:-1] | ends[1:], 0, 1 + (mix(v.view(_U)) % _U(SPREAD)).astype(np.int32)) if len(s) else np.empty(0, np.int32)
    rest = np.zeros(int((~many).sum()), np.int32)
    return np.concatenate((sig[~many], s)), np.concatenate((node[~many], v)), np.concatenate((rest, part)).astype(np.int32)


def _sign(docs: DataFrame, n: int, g: float, frequent: np.ndarray, copied: dict[int, int | None]) -> DataFrame:
    """``(sig, node, part)`` as by ``crowds``; of a much-copied node, the row of its smallest key signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, sets = batch.column("key").to_pylist(), _sets(batch.column("text"), n)
            nodes = [set_key(s) for s in sets]
            own = [i for i, v in enumerate(nodes) if v not in copied or copied[v] == keys[i]]
            sig, who = signatures([sets[i] for i in own], frequent, g)
            sig, node, part = crowds(sig, np.array([nodes[i] for i in own], np.int64)[who])
            for at in range(0, len(sig), 500_000):
                yield pa.RecordBatch.from_arrays([
                    pa.array(x[at:at + 500_000]) for x in (sig.view(np.int64), node, part)], names=["sig", "node", "part"])

    return docs.mapInArrow(run, "sig long, node long, part int")


def _beside(rows: DataFrame, of: DataFrame, by: str, part: Column | None = None) -> DataFrame:
    """``rows``, a written table, with the columns of ``of``, which has a row per ``by`` or none (these rows go). A group's rows meet its row in up to SPREAD parts."""
    parted = rows.withColumn("__part", F.pmod(F.xxhash64("node"), F.lit(SPREAD)) if part is None else part)
    return parted.join(parted.select(by, "__part").distinct().join(of, by), [by, "__part"]).drop("__part")


def _folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def near(sizes: np.ndarray, maps: list[bytes], g: float) -> np.ndarray:
    """``(i, j)``, i < j: pairs of sets that sizes and bitmaps allow to be linked."""
    size = sizes.astype(float)
    ok = np.triu(np.minimum.outer(size, size) >= g * np.maximum.outer(size, size) - 1e-9, 1)
    most = (size[:, None] + size[None, :]) * (1 - g) / (1 + g) + 1e-9
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):  # linked sets' widths are equal or next to each other
        own = np.flatnonzero(width == w)
        bits = np.frombuffer(b"".join(maps[i] for i in own), _U).reshape(len(own), -1)
        for x, y, bx, by in ((own, own, bits, bits), (own, wide := np.flatnonzero(width == 2 * w), bits, None)):
            if by is None and len(y):
                by = _folded(np.frombuffer(b"".join(maps[i] for i in wide), _U).reshape(len(wide), -1))
            if len(y):
                step = max(1, (1 << 21) // by.size)  # some 16 MB at once, however long the sets
                apart = np.concatenate([np.bitwise_count(bx[i:i + step, None, :] ^ by[None, :, :]).sum(2, dtype=np.int64) for i in range(0, len(bx), step)])
                fits = apart <= most[np.ix_(x, y)]
                ok[np.ix_(x, y)] &= fits
                if y is not x:
                    ok[np.ix_(y, x)] &= fits.T
    return np.argwhere(ok)


def _met(groups: DataFrame, g: float, every: bool) -> DataFrame:
    """``(grp, a, b)`` of groups up to SMALL (grp, node, n, bits and, for ``every``, label).

    Nodes that may be linked with another of their group give a row (grp, node, null), and a row
    (null, a, b) with the smallest such other. ``every``: rows (null, a, b) for all of them with different labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
            rows: list[tuple] = []
            for grp, members in zip(batch.column("grp").to_pylist(), batch.column("members").to_pylist(), strict=True):
                node = [m["node"] for m in members]
                pairs = near(np.array([m["n"] for m in members]), [m["bits"] for m in members], g).tolist()
                if every:
                    label = [m["label"] for m in members]
                    rows += [(None, min(node[i], node[j]), max(node[i], node[j])) for i, j in pairs if label[i] != label[j]]
                    continue
                best: dict[int, int] = {}
                for i, j in pairs:
                    best[node[i]] = min(best.get(node[i], node[j]), node[j])
                    best[node[j]] = min(best.get(node[j], node[i]), node[i])
                rows += [(None, min(x, y), max(x, y)) for x, y in best.items()]
                rows += [(grp, x, None) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["grp", "a", "b"])

    fields = ["node", "n", "bits"] + ["label"] * every
    return groups.groupBy("grp").agg(F.collect_list(F.struct(*fields)).alias("members")).mapInArrow(run, "grp long, a long, b long")


def _within_bits(pairs: DataFrame, nodes: DataFrame, g: float) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and then bitmaps allow to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            na, nb, ba, bb = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            keep = [bool(len(near(np.array([x, y]), [p, q], g))) for x, y, p, q in zip(na, nb, ba, bb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = nodes.select("node", "n", "bits")
    return (pairs.join(of.toDF("a", "na", "bits_a"), "a").join(of.toDF("b", "nb", "bits_b"), "b")
            .where(F.least("na", "nb") >= g * F.greatest("na", "nb") - 1e-9)
            .select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long"))


def _filtered(rows: DataFrame, row: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` and ``__bit_maybe``: whether their hash ``row`` may be among ``wanted`` (row). A bit filter of fixed size, so it can be broadcast whatever the data."""
    place = lambda r: F.pmod(F.xxhash64(r), F.lit(FILTER))
    page = 1 << 15
    filled = wanted.select(place("row").alias("p")).groupBy(F.expr(f"p div {page}").alias("__bit_page")).agg(
        F.bitmap_construct_agg(F.pmod("p", F.lit(page))).alias("__bit_map"))  # FILTER / page rows of 4 KB
    placed = rows.withColumn("__bit_p", place(row))
    byte = F.expr(f"cast(conv(hex(substring(__bit_map, cast(pmod(__bit_p, {page}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(__bit_p, 8) as int))")) != 0
    return (placed.join(F.broadcast(filled), F.expr(f"__bit_p div {page}") == F.col("__bit_page"), "left")
            .withColumn("__bit_maybe", F.coalesce(hit, F.lit(False))).drop("__bit_p", "__bit_page", "__bit_map"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)`` of ``nodes`` (node, key, row: where its text is found). Texts that nobody asks for don't move."""
    asked = _filtered(docs.withColumn("r", F.xxhash64("text")), F.col("r"), nodes).where("__bit_maybe")
    wanted = nodes.select("node", F.col("key").alias("k"), F.col("row").alias("w"))
    return (asked.join(wanted, (asked["r"] == wanted["w"]) & asked["key"].eqNullSafe(wanted["k"]))
            .groupBy("node").agg(F.first("text").alias("text")))


def _pack(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return out.view(_U).ravel()


def _packed_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``(node, shingles)`` of ``nodes`` (node, key, row), KEPT bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = _sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([_pack(s) for s in sets], pa.binary())], names=["node", "shingles"])

    return _texts(docs, nodes).mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are similar enough, by exact sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                both = np.concatenate((x, y))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _possible(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``(node, shared)``: how many of its shingles another of these nodes (node, key, row) has too.

    A shingle that several nodes of a slice have is counted for them there. One row, which counts nothing, tells the other slices of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = _sets(batch.column("text").slice(at, 500), n)
                node = np.array([set_key(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                shingle, first, which, rows = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
                here = np.bincount(owner[rows[which] > 1], minlength=len(sets))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((np.ones(len(sets), bool), np.zeros(len(shingle), bool)))),
                    pa.array(np.concatenate((node, shingle.view(np.int64)))), pa.array(np.concatenate((node, node[owner[first]]))),
                    pa.array(np.concatenate((here, rows == 1)).astype(np.int64)), pa.array(np.concatenate((here > 0, rows > 1)))],
                    names=["sure", "shingle", "node", "counts", "several"])

    rows = _texts(docs, nodes).mapInArrow(run, "sure boolean, shingle long, node long, counts long, several boolean")
    w = Window.partitionBy("sure", "shingle")  # a row per slice and shingle, or one per node
    return (rows.withColumn("met", F.max("several").over(w) | (F.min("node").over(w) != F.max("node").over(w)))
            .where("met and counts > 0").groupBy("node").agg(F.sum("counts").alias("shared")))


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                  percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of the self-join at similarity ``percent`` / 100.

    members: (key, row, n_shingles, node) per row of ``docs``, row being the hash of its text and node the id of its set (0: empty).
    links: (a, b) pairs of nodes that connect every two linked sets, each verified; pairs
    within what is already one component need not be listed. ``percent`` must be above 50: linked
    sets then share two shingles at least, and lie in one band or two next to each other.
    """
    members, links, _, _ = _linked(docs, key, text, n, percent)
    return members, links


def _linked(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``jaccard_links``, and the ``_joined`` of all links but the last ones, and these if there are any."""
    if not 50 < percent <= 100:
        raise ValueError("the signatures' guarantee holds for a similarity above 50 and up to 100 percent")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    g = percent / 100
    both = materialize(_sketch(docs, n), "sketch")
    members = both.where("node is not null").drop("bits")
    frequent = np.sort(np.array([r[0] for r in (
        both.where("node is null").groupBy("key").agg(F.sum("n_shingles").alias("rows"))
        .orderBy(F.desc("rows"), "key").limit(MAX_FREQUENT).select("key").collect())], np.int64).view(_U))
    at = F.min(F.struct(F.isnull("key").alias("last"), "key", "row"))
    nodes = materialize(both.where("node <> 0").groupBy("node").agg(
        at.alias("at"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("rows"))
        .select("node", "at.key", "at.row", "n", "bits", "rows"), "nodes")
    copied = {r["node"]: r["key"] for r in nodes.where("rows >= 8 and key is not null").orderBy(F.desc("rows"), "node").limit(MAX_COPIED).select("node", "key").collect()}
    nodes = nodes.drop("rows")

    w = Window.partitionBy("sig", "part")  # a signature's part 0 holds a few rows a slice
    shared = materialize(_sign(docs, n, g, frequent, copied)
                         .withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w))
                         .where("part > 0 or low <> high").select("sig", "part", "node").distinct(), "shared")
    # buckets of equal members get one name, and are one from here on
    of = shared.select("sig", "node").distinct().groupBy("sig").agg(
        F.min("node").alias("low"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    named = _beside(shared, of.select("sig", F.xxhash64("low", "size", "x", "y").alias("grp"), "low", "size"), "sig", F.col("part"))
    groups = materialize(named.select("grp", "node", "low", "size").dropDuplicates(["grp", "node"]), "groups")
    release(shared)
    small, large = groups.where(F.col("size") <= SMALL), groups.where(F.col("size") > SMALL)

    # in a bucket sorted by size, a set without a neighbour of a fitting size has no partner there, and its bitmap needn't travel
    by_size = Window.partitionBy("grp").orderBy("n", "node")
    sized = small.select("grp", "node").join(nodes.select("node", "n"), "node")
    fits = (F.lag("n").over(by_size) >= g * F.col("n") - 1e-6) | (g * F.lead("n").over(by_size) <= F.col("n") + 1e-6)
    sized = sized.withColumn("fits", fits).where("fits").select("grp", "node", "n")
    met = materialize(_met(sized.join(nodes.select("node", "bits"), "node"), g, False), "met")
    stars = large.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    hot = not stars.isEmpty()
    pairs = met.where("grp is null").groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(
        met.where("grp is null").groupBy("a").agg(F.min("b").alias("b")))
    if hot:
        pairs = pairs.union(_within_bits(stars, nodes, g))
    pairs = materialize(pairs.distinct(), "pairs")
    sets = materialize(_packed_sets(docs, _where(nodes, pairs), n), "sets")
    links = materialize(_verified(pairs, sets, percent), "links")

    labels = _joined(links)
    alive = _open(met.where("grp is not null").select(F.col("grp").alias("sig"), F.col("a").alias("node")), labels)
    again = _met(alive.withColumnRenamed("sig", "grp").join(nodes.select("node", "n", "bits"), "node"), g, True)
    again = materialize(again.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "again")
    late, spare = [] if again.isEmpty() else [_verified(again, sets, percent)], [met, sets, again]
    open_ = _open_parts(large.where("node <> low").select(F.col("grp").alias("sig"), "node"), labels) if hot else None
    if hot:  # the largest component of a large bucket sends one node to meet the members of the others
        ahead = (open_.where(F.col("lead.label") != F.col("label"))
                 .select(F.least("node", "lead.top.node").alias("a"), F.greatest("node", "lead.top.node").alias("b")).distinct()
                 .join(pairs, ["a", "b"], "left_anti"))
        ahead = materialize(_within_bits(ahead, nodes, g), "pairs")
        if not ahead.isEmpty():
            others = materialize(_packed_sets(docs, _where(nodes, ahead), n), "sets")
            late.append(_verified(ahead, others, percent))
            spare += [others, ahead]
    if late:  # links of small and of large buckets are joined at once
        more = materialize(reduce(DataFrame.unionByName, late).distinct(), "links")
        links = links.unionByName(more)
        labels = _joined(labels.toDF("a", "b").unionByName(more))
        if hot:
            spare.append(open_)
            open_ = _open_parts(open_.select("sig", "node"), labels)
    for table in spare:
        release(table)
    found = None if not hot or open_.isEmpty() else _large(docs, nodes, open_, labels, n, percent)
    release(groups)
    return members, links if found is None else links.unionByName(found), labels, found


def _joined(edges: DataFrame) -> DataFrame:
    """``(node, label)``: components of the edges (a, b), as a written table; the smallest node of a component, which is its label, has no row.

    Tasks join the edges they read into stars, up to HELD at once, so that fewer edges and shorter ways are left to the rounds.
    """

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("a", "b")]
        node, which = np.unique(np.concatenate(ends), return_inverse=True)
        low, (x, y) = np.arange(len(node)), which.reshape(2, -1)
        while (low[x] != low[y]).any():
            np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
            while (low != low[low]).any():
                low = low[low]
        own = low != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[low[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                yield stars(held)
                held, rows = [], 0
        if held:
            yield stars(held)

    return connected_components(edges.select("a", "b").mapInArrow(run, "a long, b long"), "a", "b", smallest=False).toDF("node", "label")


def _where(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, key, row)`` of the nodes of ``pairs``."""
    return nodes.select("node", "key", "row").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")


def _large(docs: DataFrame, nodes: DataFrame, open_: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame | None:
    """The links still missing within buckets of more than SMALL nodes (as by ``_open_parts``), whose pairs with the bucket's smallest node and its lead are settled."""
    g = percent / 100
    # A partner of size m needs g / (1 + g) (n + m) common shingles: at least g n, and at least this with the bucket's smallest m.
    need = g / (1 + g)
    shared = _possible(docs, nodes.select("node", "key", "row").join(open_.select("node").distinct(), "node"), n)
    able = materialize(open_.select("sig", "node", "label").join(nodes.select("node", "n"), "node").join(shared, "node")
                       .where(F.col("shared") >= g * F.col("n") - 1e-9), "able")
    release(open_)
    least = able.groupBy("sig").agg(F.min("n").alias("n0"))
    alive = _mixed(_beside(able, least, "sig").where(F.col("shared") >= need * (F.col("n") + F.col("n0")) - 1e-6).select("sig", "node", "label"))
    release(able)
    if alive.isEmpty():
        return None
    found = _blockwise(docs, nodes, alive, n, percent)
    return None if found.isEmpty() else found


def _blockwise(docs: DataFrame, nodes: DataFrame, alive: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between different labels among ``alive`` (as by ``_mixed``).

    Nodes that share buckets, directly or through others, are dealt into blocks of BLOCK. A
    task takes two blocks of a group and gets all its intersection sizes from one sparse-to-dense product.
    Blocks of one label only don't meet.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        sets = _sets(table.column("text").combine_chunks(), n)
        good = [i for i, s in enumerate(sets) if set_key(s) == node[i]]
        sets, node, label = [sets[i] for i in good], node[good], label[good]
        size = np.array([len(s) for s in sets], np.int64)
        shingle, column, rows = np.unique(np.concatenate(sets) if sets else np.empty(0, _U), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        keep = rows[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
            x, y = np.searchsorted(column, (at, at + WIDE))
            part = np.zeros((len(sets), WIDE), np.float32)
            part[owner[x:y], column[x:y] - at] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (label[:, None] != label[None, :])
        i, j = np.nonzero(np.triu(linked, 1))
        return pa.table({"a": pa.array(np.minimum(node[i], node[j]), pa.int64()), "b": pa.array(np.maximum(node[i], node[j]), pa.int64())})

    groups = _joined(alive.select(F.col("node").alias("a"), F.col("first").alias("b"))).toDF("node", "group")
    seated = alive.select("node", "label").distinct().join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    seated = materialize(seated, "seated")
    dealt = numbered(seated, ["group"], ["label", "node"]).select("node", "label", "group", F.expr(f"pos div {BLOCK}").alias("block"))
    dealt = materialize(dealt, "dealt")
    blocks = dealt.groupBy("group", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    meet = (blocks.toDF("group", "b1", "l0", "l1").join(blocks.toDF("group", "b2", "m0", "m1"), "group")
            .where("b1 <= b2 and not (l0 = l1 and m0 = m1 and l0 = m0)").select("group", "b1", "b2"))
    seats = meet.withColumn("block", F.explode(F.array_distinct(F.array("b1", "b2"))))
    texts = materialize(_texts(docs, nodes.select("node", "key", "row").join(dealt.select("node"), "node")), "texts")
    table = seats.join(dealt, ["group", "block"]).join(texts, "node").select("group", "b1", "b2", "node", "label", "text")
    out = materialize(table.groupBy("group", "b1", "b2").applyInArrow(run, "a long, b long").distinct(), "links")
    release(texts)
    return out


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``(sig, node, label)`` of buckets (SMALL at most) whose members are not of one component."""
    w = Window.partitionBy("sig")
    return (_labelled(buckets, labels).withColumn("l0", F.min("label").over(w)).withColumn("l1", F.max("label").over(w))
            .where("l0 <> l1").select("sig", "node", "label"))


def _open_parts(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``_open`` for buckets of any size, as a written table."""
    return _mixed(_labelled(buckets, labels))


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows ``(sig, node, label)`` of buckets with several labels, with the bucket's smallest node as ``first`` and a node of its largest component in ``lead``, as a written table."""
    rows = materialize(rows, "labelled")
    of = (rows.groupBy("sig", "label").agg(F.count("*").alias("many"), F.max(F.struct(F.xxhash64("node").alias("draw"), "node")).alias("top"), F.min("node").alias("first"))
          .groupBy("sig").agg(F.count("*").alias("labels"), F.min("first").alias("first"), F.max(F.struct("many", "top", "label")).alias("lead"))
          .where("labels > 1").drop("labels"))
    out = materialize(_beside(rows, of, "sig"), "open")
    release(rows)
    return out


def _placed(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """``(key, row, n_shingles, node, label)`` per row of ``docs``; label is the component's smallest node."""
    members, _, labels, found = _linked(docs, key, text, n, percent)
    if found is not None:
        labels = _joined(labels.toDF("a", "b").unionByName(found))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links, itself included)."""
    placed = _placed(docs, key, text, n, percent)
    least = placed.where("node <> 0").groupBy("label").agg(F.min("key").alias("least"))
    return (placed.join(least, (placed["label"] == least["label"]) & (placed["node"] != 0), "left")
            .select(F.col("key").alias(key), "n_shingles", F.coalesce("least", "key").alias("component_id")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component: the one with the smallest key (null last), then text hash. All columns stay.

    Rows are told apart by key and text hash. Of rows equal in both, the one with the smallest
    hash of its columns (maps left out) stays.
    """
    rows = materialize(_placed(docs, key, text, n, percent).where("node <> 0")
                       .groupBy("label", "key", "row").agg(F.count("*").alias("copies")), "rows")
    best = rows.groupBy("label").agg(F.min(F.struct(F.isnull("key").alias("last"), "key", "row")).alias("best"))
    judged = rows.join(best, "label").withColumn("_stays", F.col("best.key").eqNullSafe(F.col("key")) & (F.col("best.row") == F.col("row")))
    named = materialize(judged.where("not _stays or copies > 1").select(F.col("key").alias("_key"), F.col("row").alias("_row"), "_stays"), "gone")
    release(rows)

    # rows that may be named join the names; the others, most of the texts, stay where they are
    marked = _filtered(docs, F.xxhash64(text), named.select(F.col("_row").alias("row")))
    some = marked.where("__bit_maybe").drop("__bit_maybe")

    def same(found: DataFrame) -> Column:
        return some[key].cast("long").eqNullSafe(found["_key"]) & (F.xxhash64(some[text]) == found["_row"])

    out = marked.where("not __bit_maybe").drop("__bit_maybe").unionByName(some.join(named, same(named), "left_anti"))
    repeated = named.where("_stays")
    if repeated.isEmpty():
        return out
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = (some.join(repeated, same(repeated), "left_semi").groupBy(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_row"))
           .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("_one")).select("_one.*"))
    return out.unionByName(one)
