"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Format of a ``.rec`` file, all numbers little-endian, one record per document:
    uint64 length of the payload | uint32 masked CRC-32 of those 8 bytes |
    payload | uint32 masked CRC-32 of the payload
The payload holds the ids as uint16 (vocabularies up to 65,536) or uint32. A mask turns a
checksum c into rotate_right(c, 15) + 0xa282ead8 mod 2**32, so that checksums of data
that holds checksums stay sound. The ``.idx`` file beside it has, per record, int64 byte
offset, int64 document key and int64 number of ids, for reads in any order.

Documents are range-partitioned by key; each task streams its range into one file of a
fresh name and returns one manifest row, which Spark commits once per partition. A retried
task writes another file, so lost executors leave at most an unreferenced one.

Defined cases: null text is empty, its record has the end id only; null keys come first;
rows with an equal key follow each other, ordered by their texts' hash; an empty table writes no
record; other columns are never read.
"""

from __future__ import annotations

import re
import struct
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.hashing import flat, range_keys, same_bytes
from waymark.plans.scratch import materialize, new_path

MASK = 0xA282EAD8
#: Pieces remembered per worker, some 50 bytes each.
MEMO = 3_000_000
#: Bytes of text encoded at once.
SLICE = 1_500_000
#: Seconds without work after which a worker gives its encoders' memory back.
IDLE_S = 3.0
_NULL = -(2**63)


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(data: Iterator[bytes] | object) -> Iterator[bytes]:
    """Payloads of a file object, both checksums verified."""
    while head := data.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("broken record length")
        size = struct.unpack("<Q", head[:8])[0]
        body = data.read(size + 4)
        if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("broken record payload")
        yield body[:size]


def read_at(folder: str, file: str, places: list[int], width: int = 2) -> list[tuple[int | None, np.ndarray]]:
    """``(key, ids)`` of a file's records at these places, in this order, by seeking to the offsets in its index."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{file}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    out = []
    with fs.open_input_file(f"{root}/{file}.rec") as f:
        for position, k, n in index[places].tolist():
            f.seek(position)
            ids = np.frombuffer(next(read_frames(f)), f"<u{width}")
            if len(ids) != n:
                raise ValueError("index and record differ")
            out.append((None if k == _NULL else k, ids))
    return out


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Of a plain path or a URI that Arrow knows (file, hdfs, s3, gs, abfs), Hadoop's names of S3 included."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    if urlparse(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(uri).path
    return pyarrow.fs.FileSystem.from_uri(uri)


#: Before a single space or line end between two other characters; no token crosses such a place.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PLAIN = re.compile(r"[ \n]?\S+")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: How characters begin in UTF-8 among which there is white space beyond ASCII's.
_LEADS = ((0xC2, 0x85, 2), (0xC2, 0xA0, 2), (0xE1, 0x9A, 3), (0xE2, 0x80, 3), (0xE2, 0x81, 3), (0xE3, 0x80, 3))


_MARKS = ",.;:!?"
#: How byte-level vocabularies show bytes: printable ones as they are, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: The same as a table of UTF-16 code units.
_SHOWN_AS = np.array([ord(_SHOWN[b]) for b in range(256)], "<u2")
#: Sorts of bytes: 1 ASCII letters, 2 white space, 3 beyond ASCII, 0 others.
_SORTS = np.where(np.arange(256) > 127, 3, np.where(_WHITE, 2, 0)).astype(np.uint8)
_SORTS[[*range(65, 91), *range(97, 123)]] = 1


class _Memo:
    """Ids of pieces by the pieces' 64-bit key and bytes: sorted arrays, one pool of ids and one of the bytes of pieces longer than 8."""

    def __init__(self, dtype: type) -> None:
        self.pool, self.used = np.empty(1 << 16, dtype), 0
        self.text, self.text_used = np.empty(1 << 16, np.uint8), 0
        none = np.empty(0, np.int64)
        self.tables = [self._table(none.astype(np.uint64), none, none, none, none) for _ in range(2)]  # settled and recent

    @staticmethod
    def _table(keys: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(keys)
        return keys[order], at[order].astype(np.int64), size[order].astype(np.int32), length[order].astype(np.int32), place[order].astype(np.int64)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece its place in the pool (-1: unknown), number of ids, and whether its key is another piece's."""
        at, size, clash = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, places, sizes, length, place in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                right = hit & (length[i] == lengths)
                long = np.flatnonzero(right & (lengths > 8))
                right[long] = same_bytes(buf, starts[long], self.text, place[i[long]], lengths[long])
                at[right], size[right] = places[i[right]], sizes[i[right]]
                clash |= hit & ~right
        return at, size, clash

    @staticmethod
    def _append(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(pool):
            pool = np.concatenate([pool[:used], np.empty(max(len(more), used // 2), pool.dtype)])
        pool[used:used + len(more)] = more
        return pool

    def append(self, ids: np.ndarray) -> int:
        """Put ids into the pool; returns their place."""
        self.pool = self._append(self.pool, self.used, ids)
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        place = np.zeros(len(keys), np.int64)
        long = np.flatnonzero(lengths > 8)
        if len(long):
            places, begins = flat(starts[long], lengths[long])
            place[long] = self.text_used + begins
            self.text = self._append(self.text, self.text_used, buf[places])
            self.text_used += len(places)
        settled, recent = self.tables
        recent = self._table(*(np.concatenate([x, y]) for x, y in zip(recent, (keys, at, size, lengths, place), strict=True)))
        if len(recent[0]) > 50_000 + len(settled[0]) // 4:
            settled = self._table(*(np.concatenate([x, y]) for x, y in zip(settled, recent, strict=True)))
            recent = tuple(x[:0] for x in recent)
        self.tables = [settled, recent]


class PieceEncoder:
    """Encodes texts piece by piece with the tokenizers library, remembering pieces.

    A byte-level BPE with the usual word pattern never joins a non-space character to a
    space that follows it, so a text may be cut at every such place. Pieces repeat far more
    often than texts do, so a batch of texts is cut, hashed and looked up as arrays, and only new pieces
    reach the library, many at a time, one to a line. Strings of added
    tokens, like <|endoftext|>, are these tokens, as by the library's default: texts are cut at them first.
    """

    def __init__(self, path: str, dtype: type) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.line_end = self._ids(["\n"])[0]
        self.words, self.usual = self._for_words(), self.tokenizer.pre_tokenizer
        self.marks = {ord(m): i[0] for m, i in zip(_MARKS, self._ids(list(_MARKS)), strict=True) if len(i) == 1}
        self.memo = _Memo(dtype)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self.added = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.added))})")
        for i, t in added.items():
            buf = np.frombuffer(t.content.encode(), np.uint8)
            start, size = np.array([0]), np.array([len(buf)])
            self.memo.add(range_keys(buf, start, size), np.array([self.memo.append(np.array([i], dtype))]), np.array([1]), buf, start, size)

    def _for_words(self):
        """Rules that take the place of the word pattern for lines of one word each, which the pattern leaves whole, and for those of a word and a mark; None if the tokenizer does more to texts than usual."""
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        usual = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        if self.tokenizer.normalizer is not None or str(self.tokenizer.pre_tokenizer) != usual:
            return None
        return Split(_SHOWN[10], "isolated"), Split(Regex(f"{_SHOWN[10]}|[{_MARKS}]"), "isolated")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: int) -> np.ndarray | None:
        """Ids of pieces (of kind 0: words, 1: words and a mark, 2: others), a line end before each that doesn't begin with one; None if a piece gave a line end of its own."""
        own = buf[starts] == 10
        places, begins = flat(starts - ~own, lengths + ~own)
        data = buf[places]
        data[begins] = 10
        if kind < 2:
            self.tokenizer.pre_tokenizer = self.words[kind]  # one tokenizer, as each holds its whole vocabulary
            try:
                ids = self._ids([_SHOWN_AS[data[1:]].tobytes().decode("utf-16-le")])[0]
            finally:
                self.tokenizer.pre_tokenizer = self.usual
        else:
            ids = self._ids([data[1:].tobytes().decode()])[0]
        ids = np.array([*self.line_end, *ids], self.dtype)
        return ids if np.count_nonzero(ids == self.line_end[0]) == len(starts) else None

    def _kind(self, piece: str) -> int:
        if self.words is not None:
            word = piece[1:] if piece[0] in " \n" else piece
            if word.isascii() or max(word) < "\u0530":
                if word.isalpha():
                    return 0
                if word[-1:] in _MARKS and word[:-1].isalpha():
                    return 1
        return 2 if _PLAIN.fullmatch(piece) else 3

    def _kinds(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``_kind`` of each piece; those of ASCII alone by arrays."""
        places, begins = flat(starts, lengths)
        sorts = _SORTS[buf[places]]
        letters, white, other = (np.add.reduceat(sorts == x, begins, dtype=np.int64) for x in (1, 2, 3))
        lead = np.isin(buf[starts], (10, 32))
        size = lengths - lead
        kinds = np.where((white == lead) & (size > 0), 2, 3)
        if self.words is not None:
            kinds[(size > 0) & (letters == size)] = 0
            kinds[(size > 1) & (letters == size - 1) & np.isin(buf[starts + lengths - 1], list(_MARKS.encode()))] = 1
        for i in np.flatnonzero(other).tolist():
            kinds[i] = self._kind(buf[starts[i]:starts[i] + lengths[i]].tobytes().decode())
        return kinds

    def _learn(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces; their places in the pool and numbers of ids."""
        at, size = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        kinds = self._kinds(buf, starts, lengths)
        for kind in range(3) if len(self.line_end) == 1 else ():
            mine = np.flatnonzero(kinds == kind)
            for some in np.split(mine, range(4000, len(mine), 4000)) if len(mine) else ():
                ids = self._lines(buf, starts[some], lengths[some], kind)
                if ids is not None:
                    breaks = np.flatnonzero(ids == self.line_end[0])
                    after = (buf[starts[some]] != 10).astype(np.int64)  # the break is a piece's own if it begins with one
                    at[some] = self.memo.append(ids) + breaks + after
                    size[some] = np.diff(np.append(breaks, len(ids))) - after
        rest = np.flatnonzero(size < 0).tolist()
        texts = [buf[starts[i]:starts[i] + lengths[i]].tobytes().decode() for i in rest]
        for i, ids in zip(rest, self._ids(texts), strict=True):
            at[i], size[i] = self.memo.append(np.array(ids, self.dtype)), len(ids)
        return at, size

    def _segments(self, text: str) -> list[bytes] | None:
        """The pieces of a text that holds added tokens; None for all others."""
        if not any(t in text for t in self.added):
            return None
        return [p.encode() for i, part in enumerate(self.cut.split(text)) if part for p in ([part] if i % 2 else _CUT.split(part))]

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, where pieces start, and where texts end."""
        raw, forced, whole, at = [], [], [], 0
        for t in texts:
            segments = self._segments(t)
            data = b"".join(segments) if segments else t.encode()
            if segments:
                forced.append(at + np.cumsum([0, *map(len, segments[:-1])]))
                whole.append((at, at + len(data)))
            raw.append(data)
            at += len(data)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        white = _WHITE[buf]
        for lead, second, size in _LEADS:  # next to these, white or not, nothing is cut, which is always right
            for i in range(size) if (at := np.flatnonzero(buf[:-1] == lead)).size and (at := at[buf[at + 1] == second]).size else ():
                white[at + i] = True
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            cut[1:-1] = ((buf[1:-1] == 32) | (buf[1:-1] == 10)) & ~white[:-2] & ~white[2:]
        cut[ends[ends > 0] - 1] = False  # white space at a text's end, though another text follows
        for a, b in whole:
            cut[a:b] = False
        for f in forced:
            cut[f] = True
        cut[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = True
        return buf, np.flatnonzero(cut), ends

    def encode(self, texts: list[str]) -> list[bytes]:
        buf, starts, ends = self._pieces(texts)
        if not len(buf):
            return [b""] * len(texts)
        lengths = np.diff(np.append(starts, len(buf)))
        which, keys = pd.factorize(range_keys(buf, starts, lengths))
        order = np.argsort(keys)  # sorted keys are found sooner
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        which, keys = rank[which], keys[order]
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        alone = self._unlike(buf, starts, lengths, first[which])  # pieces whose key another piece of this batch has
        at, size, clash = self.memo.find(keys, buf, starts[first], lengths[first])
        before = self.memo.used
        new = np.flatnonzero(at < 0)
        if len(new) or len(alone):
            known, place, count, mark = self._stems(buf, starts, lengths, first, new)
            if len(known):
                upto = np.cumsum(count + 1)
                ids = self.memo.pool[np.minimum(np.repeat(place - (upto - count - 1), count + 1) + np.arange(upto[-1]), self.memo.used - 1)]
                ids[upto - 1] = mark
                at[known], size[known] = self.memo.append(ids) + upto - count - 1, count + 1
            rest = np.flatnonzero(at < 0)
            for some, put in ((first[rest], rest), (alone, None)):
                if len(some):
                    learned = self._learn(buf, starts[some], lengths[some])
                    if put is not None:
                        at[put], size[put] = learned
                    else:
                        which[alone] = len(at) + np.arange(len(alone))
                        at, size = np.append(at, learned[0]), np.append(size, learned[1])
        counts, places = size[which], at[which]
        stops = np.cumsum(counts)
        ids = self.memo.pool[np.repeat(places - (stops - counts), counts) + np.arange(stops[-1])].tobytes()
        if len(self.memo) < MEMO:  # when full, it holds most of what is frequent
            fresh = new[~clash[new]]
            if len(fresh):
                self.memo.add(keys[fresh], at[fresh], size[fresh], buf, starts[first[fresh]], lengths[first[fresh]])
        else:
            self.memo.used = before
        width = np.dtype(self.dtype).itemsize
        bounds = (np.append(0, stops)[np.searchsorted(starts, np.append(0, ends))] * width).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    @staticmethod
    def _unlike(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, twin: np.ndarray) -> np.ndarray:
        """Pieces that differ from the one that stands for their key."""
        right = lengths == lengths[twin]
        long = np.flatnonzero(right & (lengths > 8) & (twin != np.arange(len(twin))))
        right[long] = same_bytes(buf, starts[long], buf, starts[twin[long]], lengths[long])
        return np.flatnonzero(~right)

    def _stems(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
        """New pieces that are a known one and a mark, which after a letter is a token of its own: index, place and number of ids, mark."""
        f = first[new]
        size = lengths[f]
        last, previous = buf[starts[f] + size - 1], buf[starts[f] + np.maximum(size - 2, 0)] | 32
        fits = np.isin(last, list(self.marks)) & (size > 1) & (previous >= 97) & (previous <= 122)
        at, count = np.full(len(new), -1, np.int64), np.zeros(len(new), np.int64)
        if fits.any():
            begin, shorter = starts[f[fits]], size[fits] - 1
            at[fits], count[fits], _ = self.memo.find(range_keys(buf, begin, shorter), buf, begin, shorter)
        known = at >= 0
        mark = np.array([self.marks.get(c, 0) for c in range(256)], self.dtype)[last[known]]
        return new[known], at[known], count[known], mark


_ENCODERS: dict[tuple, PieceEncoder] = {}
_LAST_USED = [0.0]


def _forget_when_idle() -> None:
    """Workers outlive the step, and the next steps' tasks find what it remembered as memory in use."""
    while (left := _LAST_USED[0] + IDLE_S - time.monotonic()) > 0:
        time.sleep(left)
    _ENCODERS.clear()


def _encoder(path: str, dtype: type) -> PieceEncoder:
    _LAST_USED[0] = time.monotonic()
    found = _ENCODERS.get((path, dtype))
    if found is None:
        first, found = not _ENCODERS, PieceEncoder(path, dtype)
        _ENCODERS[path, dtype] = found
        if first:
            threading.Thread(target=_forget_when_idle, daemon=True).start()
    return found


def byte_bpe(path: str, vocabulary: int = 50_257, end: int = 0) -> Callable[[list[str]], list[bytes]]:
    """An encoder of texts into id bytes with ``end`` appended, kept per worker process until it is idle."""
    dtype = np.uint16 if vocabulary <= 65_536 else np.uint32

    def encode(texts: list[str]) -> list[bytes]:
        last = np.array([end], dtype).tobytes()
        out = [b + last for b in _encoder(path, dtype).encode(texts)]
        _LAST_USED[0] = time.monotonic()
        return out

    encode.width = np.dtype(dtype).itemsize
    return encode


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at least one row, of up to SLICE bytes of text where rows are smaller."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_records(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], folder: str | None = None,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` in ascending order of ``key``; returns the manifest, one row per file.

    Manifest: file, first, last (keys), records, n_tokens, start (ids in all files before it).
    ``folder`` must be one that all executors reach; default: a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    width = encode.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, index, n_tokens = f"{root}/{uuid.uuid4().hex}", [], 0
        out = None
        for batch in batches:
            for part in _by_size(batch):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, position = fs.open_output_stream(f"{name}.rec"), 0
                keys = part.column("key").to_pylist()
                for k, ids in zip(keys, encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    out.write(record := frame(ids))
                    index.append((position, _NULL if k is None else k, len(ids) // width))
                    position += len(record)
                    n_tokens += len(ids) // width
        if out is None:
            return
        del batch, part
        pa.default_memory_pool().release_unused()  # Arrow gives back its own thread's memory only
        out.close()
        with fs.open_output_stream(f"{name}.idx") as f:
            f.write(np.array(index, "<i8").tobytes())
        known = [k for _, k, _ in index if k != _NULL]
        yield pa.RecordBatch.from_pylist([{
            "file": name.rsplit("/", 1)[1], "first": known[0] if known else None, "last": known[-1] if known else None,
            "records": len(index), "n_tokens": n_tokens, "place": index[0][1]}], pa.schema([
                ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("records", pa.int64()), ("n_tokens", pa.int64()), ("place", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ranged = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    files = materialize(ranged.mapInArrow(
        run, "file string, first long, last long, records long, n_tokens long, place long").withColumn("range", F.spark_partition_id()), "manifest")
    order = Window.orderBy("range")  # one row per file
    return (files.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))
            .select(F.lit(folder).alias("folder"), "file", "first", "last", "records", "n_tokens", "start"))


def read_records(manifest: DataFrame, width: int = 2, with_ids: bool = True) -> DataFrame:
    """Per record of the manifest's files, read back and verified: key, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``ids_crc32`` is the plain CRC-32 of the ids as little-endian uint32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = filesystem(row["folder"])
                with fs.open_input_file(f"{root}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                start, out, size = row["start"], [], 0
                with fs.open_input_stream(f"{root}/{row['file']}.rec") as f:
                    for (_, k, n), payload in zip(index.tolist(), read_frames(f), strict=True):
                        ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError("index and record differ")
                        out.append((None if k == _NULL else k, start, n, zlib.crc32(ids.tobytes()), ids if with_ids else None))
                        start += n
                        size += n
                        if size > 1 << 20:
                            yield _batch(out)
                            out, size = [], 0
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        if not with_ids:
            return pa.RecordBatch.from_arrays(numbers, names=["key", "start", "n_tokens", "ids_crc32"])
        ids = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32()),
            pa.array(np.concatenate([r[4] for r in rows]).astype(np.int32) if rows else np.empty(0, np.int32)))
        return pa.RecordBatch.from_arrays([*numbers, ids], names=["key", "start", "n_tokens", "ids_crc32", "ids"])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = manifest.repartition(tasks, "file")  # a number, so that the few small rows aren't put into one task
    return parts.select("folder", "file", "start").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
