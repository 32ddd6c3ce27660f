"""Repair of conversations: the cheapest edits that make their roles alternate, found in one pass with bounded memory.

The roles of a repaired conversation read ``(system? (user assistant)+)?``. Rows are kept (cost 0), given the role user or assistant
(3) or deleted (4, required for blank rows and duplicates); empty rows of user or assistant are inserted anywhere (3); a truncated row that
stays costs 3 more. Of the cheapest lists of edits, that one wins whose initials (K, R, D, I), in order, come first in ASCII. Which role
an edit gives follows from the roles before it, so the initials say all.

Spark shuffles rows once by conversation, marks duplicates by a window and sorts; each task then streams its conversations
through a Viterbi search over four states (nothing yet, after system, after user, after assistant). Its survivors are leaves of a
tree of backpointers with reference counts: what no survivor leads to any more is freed, and once all survivors share an
ancestor, the edits up to it are certain and leave. Between equal costs the edits since the last common ancestor decide, in full. No one of
them can begin the other: lists for the same rows where one continues the other differ by insertions alone, hence in
cost. A survivor that another one can replace at a strictly smaller cost, whatever follows, is dropped, so survivors
of rows with usable roles meet soon and such a conversation takes little memory at any length. Rows whose roles fit nowhere (a thousand
system rows in a row) can leave two lists open until the next certain row, as one insertion right at their start may be the
first in ASCII; these rows are held so long, each once. A conversation is one task's stream, as each decision and the
digest of the repaired text depend on all rows before; it is never held whole otherwise.

Defined cases: null conv_id, turn, role or text are one space each where a value is needed; null turns come first; rows of equal
turns follow each other by role and text; a null conv_id is a conversation; equal rows are duplicates; a conversation without rows
left has zeros, no edits and the digest of the empty string; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and role that an inserted or renamed row gives, per state.
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What it costs at most more to go on from the first state in place of the second (absent: it can't).
_REPLACES = {(ASSISTANT, START): 4, (USER, START): 7, (SYSTEM, START): 6, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 3, (START, SYSTEM): 0,
             (ASSISTANT, USER): 3, (SYSTEM, USER): 3, (START, USER): 3, (START, ASSISTANT): 0, (SYSTEM, ASSISTANT): 6, (USER, ASSISTANT): 3}
PIECE = 1000


class _Node:
    """One edit; ``uses`` counts the survivors at it, ``after`` holds the edits that follow it."""

    __slots__ = ("before", "after", "uses", "edit", "row")

    def __init__(self, before: _Node | None, edit: str, row: object) -> None:
        self.before, self.after, self.uses, self.edit, self.row = before, [], 0, edit, row
        if before is not None:
            before.after.append(self)


class Search:
    """Viterbi search over one conversation; ``emit(edit, row)`` gets certain edits in order, ``row`` being (role, text) or None.

    ``best`` holds, per state, the survivor's cost, its place among the survivors' edits so far, and its node. A place is a rank
    and the edits since then: edits that already differ are ranked for good, so that ties over any length are settled at once, and survivors
    that are another one's edits and insertions more share its rank until their next edits tell.
    """

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]) -> None:
        self.emit, self.cost = emit, 0
        self.root = _Node(None, "", None)
        self.root.uses = 1
        self.best: dict[int, tuple[int, tuple[int, str], _Node]] = {START: (0, (0, ""), self.root)}
        self._insert()

    def _offer(self, to: dict, state: int, cost: int, survivor: tuple[int, tuple[int, str], _Node], edit: str, row: object) -> bool:
        """Let a survivor go on to ``state``, unless what is there is cheaper or as cheap and first in ASCII."""
        place = (survivor[1][0], survivor[1][1] + edit)
        if state in to:
            if (cost, place) > to[state][:2]:
                return False
            self._leave(to[state][2])
        node = _Node(survivor[2], edit, row)
        node.uses = 1
        to[state] = (cost, place, node)
        return True

    def _leave(self, node: _Node) -> None:
        """A survivor gives up its node; edits that nothing needs are freed."""
        node.uses -= 1
        while node.uses == 0 and not node.after and node.before is not None:
            node.before.after.remove(node)
            node = node.before

    def _insert(self) -> None:
        """Insertions between this row and the next; then survivors that can't win are dropped, and the others ranked."""
        best, todo = self.best, list(self.best)
        while todo:
            survivor = best[state := todo.pop()]
            to, role = _NEXT[state]
            cost = survivor[0] + INSERT
            if (to not in best or cost <= best[to][0]) and self._offer(best, to, cost, survivor, "I", (role, "")):
                todo.append(to)
        costs = {s: b[0] for s, b in best.items()}
        for s, c in costs.items():
            if any(t != s and (t, s) in _REPLACES and d + _REPLACES[t, s] < c for t, d in costs.items()):
                self._leave(best.pop(s)[2])
        rank, base = -1, None
        for state, (cost, place, node) in sorted(best.items(), key=lambda b: b[1][1]):
            if base is None or base[0] != place[0] or not place[1].startswith(base[1]):
                rank, base = rank + 1, place
            best[state] = (cost, (rank, place[1][len(base[1]):]), node)

    def add(self, role: str, text: str, delete: bool, truncated: bool) -> None:
        to: dict[int, tuple[int, tuple[int, str], _Node]] = {}
        extra, row, kept = TRUNCATED if truncated else 0, (role, text), _KEPT.get(role[:1], {})
        for state, survivor in self.best.items():
            cost = survivor[0]
            self._offer(to, state, cost + DELETE, survivor, "D", None)
            if not delete:
                if state in kept:
                    self._offer(to, kept[state], cost + extra, survivor, "K", row)
                after, other = _NEXT[state]
                self._offer(to, after, cost + REROLE + extra, survivor, "R", (other, text))
        for _, _, node in self.best.values():
            self._leave(node)
        self.best = to
        self._insert()
        self._settle()

    def _settle(self) -> None:
        while self.root.uses == 0 and len(self.root.after) == 1:
            self.root = self.root.after[0]
            self.root.before = None
            self.emit(self.root.edit, self.root.row)

    def end(self) -> None:
        self.cost, _, node = min((self.best[s] for s in (START, ASSISTANT) if s in self.best), key=lambda b: b[:2])
        for _, _, other in self.best.values():
            if other is not node:
                self._leave(other)
        node.uses = 0
        self._settle()


def last_mark(text: Column) -> Column:
    """The last character that is not white space."""
    return F.right(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with known faults: by CRC-32 of ``conv_id:turn`` modulo 20, 0 drops a row (it stays as ``gone``), 1 empties its text,
    2 removes full stops and the like, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("old_role"), F.coalesce("text", F.lit(" ")).alias("old_text"), kind.alias("kind"))
    out = rows.withColumns({
        "gone": F.col("kind") == 0,
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("old_role")),
        "text": F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("old_text", "[.!?]", "")).otherwise(F.col("old_text")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return out.select("conv_id", "turn", "role", "text", "gone", F.struct("old_role", "old_text", "copy").alias("place"))


def as_rows(conversations: DataFrame) -> DataFrame:
    """Undamaged conversations in the form that ``repair`` takes; null roles and texts are one space."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.select("*", F.lit(False).alias("gone"), F.struct("role", "text", F.lit(0).alias("copy")).alias("place"))


class _Conversation:
    """Figures and digest of one conversation as its rows go by; or its repaired rows, one by one, to ``each``."""

    def __init__(self, conv_id: int | None, each: Callable[[dict], None] | None) -> None:
        self.conv_id, self.each = conv_id, each
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = self.kept = 0
        self.low = self.high = self.last = None
        self.audit, self.digest = [], hashlib.sha256()
        self.search = Search(self._edit)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.high:  # turns ascend
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.search.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def _edit(self, edit: str, row: tuple[str, str] | None) -> None:
        if self.each is None:
            self.audit.append(edit)
            if row is not None:
                self.digest.update(("\n" * (self.kept > 0) + f"{row[0]}:{row[1]}").encode("utf-8", "surrogatepass"))
        elif row is not None:
            self.each({"conv_id": self.conv_id, "turn": self.kept, "role": row[0], "text": row[1], "edit": edit})
        self.kept += row is not None

    def end(self) -> dict:
        self.search.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.search.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _streamed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``, each conversation's rows in order in one partition."""
    alike = Window.partitionBy("conv_id", "gone", "role", F.unhex(F.sha2("text", 256)))
    order = [F.asc_nulls_first("turn"), F.asc("place")]
    placed = rows.repartition("conv_id").withColumn("_seen", F.row_number().over(alike.orderBy(*order)) > 1)
    mark = last_mark(F.col("text"))
    fault = F.when(mark == "", "blank").when(F.col("_seen"), "duplicate").when(~mark.isin(".", "!", "?"), "truncated")
    return (placed.withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), "gone", *order)
            .select("conv_id", "turn", "role", "text", "gone", "fault"))


def _walk(batches: Iterator[pa.RecordBatch], each: Callable[[dict], None] | None = None) -> Iterator[dict | None]:
    """A conversation's summary when it ends; None after each row, so that repaired rows can leave meanwhile."""
    now = None
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for conv_id, turn, role, text, gone, fault in zip(*[part.column(i).to_pylist() for i in range(6)], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.end()
                    now = _Conversation(conv_id, each)
                if not gone:
                    now.add(turn, role, text, fault)
                yield None
    if now is not None:
        yield now.end()


def _pieces(rows: Iterator[dict | None], schema: pa.Schema, full: list[dict] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the rows, or of those that pile up in ``full`` as the iterator goes on."""
    out = [] if full is None else full
    for row in rows:
        if full is None and row is not None:
            out.append(row)
        if len(out) >= PIECE:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    yield pa.RecordBatch.from_pylist(out, schema)


_SUMMARY = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
            ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def repair_summary(rows: DataFrame) -> DataFrame:
    """Per conversation of ``damage`` or ``as_rows``: faults, gaps, cost, the edits' initials and the digest of the repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(_walk(batches), pa.schema(_SUMMARY))

    return _streamed(rows).mapInArrow(
        run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``damage`` or ``as_rows``: ``conv_id``, ``turn`` (from 0), ``role``, ``text`` and ``edit`` (K, R or I)."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        certain: list[dict] = []
        yield from _pieces(_walk(batches, certain.append), schema, certain)

    return _streamed(rows).mapInArrow(run, "conv_id long, turn long, role string, text string, edit string")
