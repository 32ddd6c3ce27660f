"""Word and shingle hashes of whole texts, vectorised over a batch of texts.

The hash of a word of up to 8 bytes is its bytes as one number, mixed, so such words never collide; a longer word's is
64 bits of BLAKE2b. A shingle's is a mixed chain of its words' hashes. Both depend on the
words alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_rng.integers(1, 2**63, 256, dtype=np.uint64)  # keeps the numbers below as they were
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARK = _SPACE.copy()
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = np.ones(1, np.uint64)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes hashed at once.
CHUNK = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        more = np.full(max(n, 64, 2 * len(_POWERS)), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(texts: list[str | None], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and ``offsets``: text i has those from offsets[i] to offsets[i + 1].

    ``marks``: ASCII punctuation separates words like white space does.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets, parts, total, at = np.zeros(len(raw) + 1, np.int64), [], 0, 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end]) + 1
            end += 1
        h, starts = _hash_words(np.frombuffer(b" ".join(raw[at:end]) + b" ", np.uint8), _MARK if marks else _SPACE)
        text_ends = np.cumsum([len(r) + 1 for r in raw[at:end]])
        offsets[at + 1:end + 1] = total + np.searchsorted(starts, text_ends)
        parts.append(h)
        total += len(h)
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), offsets


def _hash_words(buf: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = spaces[buf]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    last = ~space
    last[:-1] &= space[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    low = _LOWERED[buf]
    h = mix(_block(low, starts, lengths) + lengths.astype(_U) * _BASE)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        data = low.tobytes()
        h[long] = [_long_word(data[a:b]) for a, b in zip(starts[long].tolist(), (starts + lengths)[long].tolist(), strict=True)]
    return h, starts


_LONG: dict[bytes, int] = {}


def _long_word(word: bytes) -> int:
    h = _LONG.get(word)
    if h is None:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(_LONG) >= 500_000:
                _LONG.clear()
            _LONG[word] = h
    return h


def _block(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each range as a number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf),), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    return eights[starts] & _FIRST[np.minimum(lengths, 8)]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; all words as one if there are fewer; none if there is none."""
    k = min(n, len(words))
    if not k:
        return words
    h = np.full(len(words) - k + 1, _U(k))
    for i in range(k):
        h = (h ^ (h >> _U(29))) * _STEPS[i % 64] + words[i:len(words) - k + 1 + i]
    return mix(h)


def runs(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of each text, after one another, and their offsets."""
    parts = [shingles(words[a:b], n) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ends = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else words), ends


def distinct_runs(words: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text, the sorted distinct shingles."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        h = shingles(words[a:b], n)
        h.sort()
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def set_key(distinct: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes; the empty set's is 0."""
    if not len(distinct):
        return 0
    sums = np.array([[np.add.reduce(mix(distinct))], [np.add.reduce(mix(distinct ^ _BASE))]], np.uint64)
    return int(mix((sums[0] ^ (sums[1] * _BASE)) + _U(len(distinct))).view(np.int64)[0]) or 1


_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all ranges (none empty) after one another, and where each range begins among them."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0), stops - lengths


def range_keys(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit key per range of bytes. Ranges of up to 8 bytes and one length never share one; longer ones may, so compare them."""
    keys = mix(_block(buf, starts, lengths) + lengths.astype(_U) * _BASE)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        places, begins = flat(starts[long], lengths[long])
        at = places - np.repeat(starts[long], lengths[long])
        sums = np.add.reduceat(_EXACT[buf[places]] * _powers(int(lengths[long].max()))[at], begins)
        keys[long] = mix(sums + lengths[long].astype(_U) * _BASE)
    return keys


def same_bytes(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ranges of ``a`` and ``b`` of equal lengths hold the same bytes."""
    if not len(lengths):
        return np.empty(0, bool)
    places, begins = flat(starts_a, lengths)
    others = places + np.repeat(starts_b - starts_a, lengths)
    return np.add.reduceat((a[places] != b[others]).astype(np.int64), begins) == 0
