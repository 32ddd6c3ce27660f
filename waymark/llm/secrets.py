"""Secret scan: fixed patterns, and strings that a token vocabulary finds hard to spell.

Text that people write, code included, is cheap under a byte-pair vocabulary; random keys
are not. A candidate is a run of 20 or more characters of the key alphabet, letters among them. Its efficiency is characters per token; below LIMIT it is reported as
kind ``random``. Known digests (hex of a usual digest's length), UUIDs and identifiers
(words joined by _, -, ., / or case, with at most a short number each, unless no word could be that hard) are excluded first,
and so is what a fixed pattern has reported already. Readable names around a key would hide it,
so the parts of a candidate that isn't reported are scored too: parts between marks, of 20
characters or more, alone or, where neighbours joined by /, +, - or _ are hard to spell as
well, together (keys hold these marks).

Rows are scanned alone, so nothing is shuffled. Defined cases: null text is empty;
candidates of any length are scored whole, in windows; repeated rows give repeated rows;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_DIGESTS = {32, 40, 56, 64, 96, 128}
_PART = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
#: Characters per token below which a candidate counts as random: with digits, of letters alone, and built like an identifier.
LIMIT, PLAIN, HARD = 2.2, 1.95, 1.8
_WINDOW = 512
#: The vocabulary's own splitting rule.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict = {}


def encoding(path: str):
    """The tiktoken encoding of a ranks file, kept per worker process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def known(s: str) -> bool:
    """A digest or UUID, or no letters at all."""
    if not any(c.isalpha() for c in s):
        return True
    return len(s) in _DIGESTS and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s)) or bool(_UUID.fullmatch(s))


def random_like(s: str, enc) -> bool:
    """Whether the vocabulary finds a string too hard to spell for words: below LIMIT with digits, PLAIN without, HARD if it is built like an identifier."""
    found = efficiency(s, enc)
    if not any(c.isdigit() for c in s):
        return found < PLAIN
    return found < HARD or found < LIMIT and not _words_only(s)


def _words_only(s: str) -> bool:
    """Words of three letters or more on average, joined by marks or case, each with a short number at most."""
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", s)
    letters = [w for w in words if not w[0].isdigit()]
    numbers = [w for w in words if w[0].isdigit()]
    return bool(letters) and max(map(len, numbers), default=0) <= 8 and sum(map(len, letters)) >= 4 * len(letters) and len(numbers) <= len(letters)


def efficiency(s: str, enc) -> float:
    """Characters per token, over windows of at most 512 characters."""
    return len(s) / sum(len(enc.encode_ordinary(s[i:i + _WINDOW])) for i in range(0, len(s), _WINDOW))


def _overlap(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span meets one of these, by bisection over their union."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def meets(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # those before i begin before b
        return i > 0 and ends[i - 1] > a

    return meets


def hard_parts(text: str, start: int, end: int, enc) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring parts of text[start:end] that are hard to spell, as their spans.

    . and = end a run, and so do UUIDs and known strings of 20 characters or more. Parts of up
    to 3 characters, hard by their length alone, don't begin or end one.
    """
    in_uuid = _overlap([m.span() for m in _UUID.finditer(text, start, end)])
    run: list[tuple[int, int]] = []

    def trimmed() -> list[tuple[int, int]]:
        long = [i for i, (a, b) in enumerate(run) if b - a > 3]
        return run[long[0]:long[-1] + 1] if long else []

    for m in _PART.finditer(text, start, end):
        a, b = m.span()
        if run and any(c in ".=" for c in text[run[-1][1]:a]):
            yield trimmed()
            run = []
        s = m[0]
        if efficiency(s, enc) < LIMIT and not (len(s) >= 20 and (known(s) or not random_like(s, enc))) and not in_uuid(a, b):
            run.append((a, b))
        else:
            yield trimmed()
            run = []
    yield trimmed()


def scan(text: str, enc) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed patterns' spans, and all spans by start and then kind."""
    base = base_spans(text)
    more, in_base = [], _overlap([(a, b) for a, b, _ in base])

    def fresh(a: int, b: int) -> bool:
        return b - a >= 20 and not in_base(a, b) and not known(text[a:b]) and random_like(text[a:b], enc)

    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".=-/":  # closing marks of a sentence or path
            b -= 1
        if fresh(a, b):
            more.append((a, b, KINDS[3]))
        elif b - a > 20:
            for run in hard_parts(text, a, b, enc):
                # marks are rare in a key, but not in dates and versions
                if run and 16 * (len(run) - 1) <= run[-1][1] - run[0][0] and fresh(run[0][0], run[-1][1]):
                    more.append((run[0][0], run[-1][1], KINDS[3]))
                else:
                    more += [(x, y, KINDS[3]) for x, y in run if fresh(x, y)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_random.

    ``vocabulary``: a tiktoken ranks file that every executor has at this path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for at in range(0, batch.num_rows, 1000):
                for t in batch.column("text").slice(at, 1000).to_pylist():
                    base, spans = scan(t or "", enc)
                    kinds = [k for _, _, k in spans]
                    for column, value in zip(out, (*(kinds.count(k) for k in KINDS), digest(base), line(spans)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])],
                names=["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "key long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    return found.select(F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(line(spans).encode()).hexdigest()
