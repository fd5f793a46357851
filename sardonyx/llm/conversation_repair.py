"""Least-cost repair of role order in conversations, by Viterbi with rank convergence.

A conversation's rows, by turn, are edited until the first letters of their roles
read ``(s?(ua)+)?``.  Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert
of an empty user or assistant row 5; a row that stays although it is truncated costs
5 more, and blank and duplicate rows must go.  Of the cheapest edits the ones whose
letters (D, I, K, R) come first as a string are taken.  A state of the reading (0
nothing yet, 1 after s, 2 after u, 3 after a) and a letter leave one next state, so
those letters settle every repaired role.

How it is spread:

1. The rows are sorted by conversation and turn over ranges, so a conversation of any
   size is cut into *segments*, one a partition; each row becomes one symbol (role and
   fault) and ``CHUNK`` symbols one string.
2. Costs to the end run backwards as vectors of four.  Each segment starts from a
   speculative vector.  Fix-up passes give every segment the vector that the segment
   after it arrived at and run the old and the new one side by side; where they differ
   only by a constant all that lies before is right already.  Passes are repeated until
   no segment's vector changes.  Rows such as a thousand duplicates let vectors through
   unchanged; a conversation that is not settled after ``FIX_ROUNDS`` passes gets its
   vectors from its segments' four-by-four cost matrices instead (exact, one pass).
3. Every chunk is traced once from each possible state over the settled costs; a pass
   over these small records in order picks the traces that meet.

Vectors less their least entry are few, so a task keeps them in a table and a step is
one look-up.  ``repair`` gives the edits with the repaired rows, spread like the
segments.  ``audit`` gives one row per conversation.  The hash of a whole conversation
is sequential by definition, so there one task streams a conversation's rows; it holds
one batch and the audit string that it returns.

Defined results: a NULL role or text counts as one space; rows of one turn are ordered
by role, then by the SHA-256 of role and text, NULL turns first; rows that agree in
all are duplicates; a row whose role is empty has no first letter and cannot be kept
as it is; NULL ids are one conversation; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sardonyx.llm.common import arrow_map, stored

#: Symbols in one record, and so the most that a trace holds.
CHUNK = 4096
#: Fix-up passes before a conversation's segments are settled by their cost matrices.
FIX_ROUNDS = 6

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A difference that no cost vector of a true end reaches.
FAR = 1000
#: The state after the row that is wanted next, and after a kept s, u, a or other row (None: not allowed).
WANTED = (2, 2, 3, 2)
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
END = (0, 10, 5, 0)
WHITE = " \t\n\x0b\x0c\r"


class Costs:
    """Backward steps over cost vectors, each worked out once."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}

    def step(self, after: tuple, symbol: str) -> tuple[tuple, int, tuple]:
        """The vector before a row (least entry 0), what was taken off, and per state letters and next state."""
        got = self.steps.get((after, symbol))
        if got is None:
            got = self.steps[after, symbol] = self._work(after, symbol)
        return got

    @staticmethod
    def _work(after, symbol):
        role, fault = divmod(ord(symbol) - 65, 4)
        stays, more = fault in (0, 3), TRUNCATED if fault == 3 else 0

        def edits(q):
            yield "D", DELETE + after[q], q
            if stays:
                if KEPT[q][role] is not None:
                    yield "K", KEEP + more + after[KEPT[q][role]], KEPT[q][role]
                yield "R", REROLE + more + after[WANTED[q]], WANTED[q]

        row = [min(cost for _, cost, _ in edits(q)) for q in range(4)]
        before = list(row)
        for _ in range(3):  # inserts go 0 or 1 to 2, then round 2 and 3
            before = [min(row[q], INSERT + before[WANTED[q]]) for q in range(4)]
        moves = []
        for q in range(4):
            letters, at = "", q
            while True:
                deleted = DELETE + after[at] == before[at]
                if not deleted and INSERT + before[WANTED[at]] == before[at]:
                    letters, at = letters + "I", WANTED[at]
                    continue
                letter, _, nxt = next(e for e in edits(at) if e[1] == before[at])
                moves.append((letters + letter, nxt))
                break
        least = min(before)
        return tuple(min(b - least, FAR) for b in before), least, tuple(moves)

    def back(self, after: tuple, symbols: str) -> tuple[tuple, int]:
        total = 0
        for s in reversed(symbols):
            after, taken, _ = self.step(after, s)
            total += taken
        return after, total

    def trace(self, after: tuple, symbols: str, last: bool, starts) -> list[tuple[str, int]]:
        """Per start state the letters of a chunk and the state they end in; after the last row, inserts too."""
        moves = []
        for s in reversed(symbols):
            after, _, move = self.step(after, s)
            moves.append(move)
        moves.reverse()
        out = []
        for q in starts:
            letters = []
            for move in moves:
                said, q = move[q]
                letters.append(said)
            if last:
                letters.append("I" * (END[q] // INSERT))
            out.append(("".join(letters), q))
        return out


@lru_cache(maxsize=1)
def costs() -> Costs:
    return Costs()


def _spell(vector) -> str:
    return ",".join(map(str, vector))


def _read(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 500):  # as Python objects only a few rows at a time
            yield from b.slice(at, 500).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema)


def _arrow(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


# ---------------------------------------------------------------- rows, symbols, segments

def ordered(conversations: DataFrame) -> DataFrame:
    """The rows with ``pos``, their place in the order (partition, then row in it), written once."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select(
        # NULL is a conversation of its own, and a key that joins
        F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"),
                 F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("conv"), "turn", "role", "text",
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("same"),
        F.monotonically_increasing_id().alias("_any"))  # rows that agree in all, which any order serves
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "same", "_any"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any")
    return stored(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _conv_id(conversations: DataFrame):
    """The id that the key ``conv`` stands for."""
    kind = conversations.schema["conv_id"].dataType
    return F.when(F.col("conv") != "n", F.expr("substring(conv, 2)").cast(kind)).alias("conv_id")


def faults(rows: DataFrame) -> DataFrame:
    """``conv, pos, symbol``: each row's role letter and first fault as one character."""
    narrow = stored(rows.select(
        "conv", "pos", "same", F.substring("role", 1, 1).alias("letter"),
        F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1).alias("end")), "turn-marks")
    # one partially aggregated count per text; what joins is a place, which no two rows share
    firsts = narrow.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = (F.when(F.col("end") == "", 1).when(F.col("first").isNull(), 2)
             .when(F.col("end").isin(".", "!", "?"), 0).otherwise(3))
    role = F.when(F.col("letter") == "", 3)
    for k, ch in enumerate(ROLES):
        role = role.when(F.col("letter") == ch, k)
    return narrow.join(firsts, "pos", "left").select(
        "conv", "pos", F.char(F.lit(65) + role.otherwise(3) * 4 + fault).alias("symbol"))


def chunks(marks: DataFrame, size: int) -> DataFrame:
    """``conv, pid, sub, pos, symbols, first_pid, last_pid``: at most ``size`` rows a record."""
    low = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    found = (marks.groupBy("conv", F.shiftright("pos", 33).alias("pid"), F.floor(low / size).alias("sub"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("l"))
             .select("conv", "pid", "sub", F.col("l")[0]["pos"].alias("pos"),
                     F.array_join(F.col("l.symbol"), "").alias("symbols")))
    found = stored(found, "turn-chunks")
    ends = found.groupBy("conv").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return stored(found.join(ends, "conv").select(
        "*", F.shiftright("first_pos", 33).alias("first_pid"), F.shiftright("last_pos", 33).alias("last_pid")),
        "turn-segments")


def _by_segment(df: DataFrame) -> DataFrame:
    return df.repartition("pid").sortWithinPartitions("pid", "conv", F.desc("sub"))


def _segment_runs(batches) -> Iterator[list[dict]]:
    """Chunks of a segment, the last first, as an iterator per segment."""
    for _, run in groupby(_records(batches), key=lambda r: (r["pid"], r["conv"])):
        yield run


# ---------------------------------------------------------------- backward costs over segments

VECTORS = "conv string, pid bigint, end_vec string, start_vec string"
_VECTORS = _arrow(conv=pa.string(), pid=pa.int64(), end_vec=pa.string(), start_vec=pa.string())


def speculate(open_chunks: DataFrame) -> DataFrame:
    """Every segment from the vector of a conversation's end, which only its last one knows to be right."""
    def work(batches):
        def rows():
            for run in _segment_runs(batches):
                vector = END
                for r in run:
                    vector, _ = costs().back(vector, r["symbols"])
                yield r["conv"], r["pid"], _spell(END), _spell(vector)
        yield from _batches(rows(), _VECTORS)
    return stored(arrow_map(_by_segment(open_chunks.select("conv", "pid", "sub", "symbols")), work, VECTORS), "vectors")


def fix_up(open_chunks: DataFrame, wrong: DataFrame) -> DataFrame:
    """Segments of ``wrong`` (``end_vec`` was used, ``next_vec`` is right) until old and new are parallel."""
    def work(batches):
        def rows():
            for run in _segment_runs(batches):
                old = new = None
                for r in run:
                    if old is None:
                        old, new = _read(r["end_vec"]), _read(r["next_vec"])
                    for s in reversed(r["symbols"]) if old != new else ():
                        old, new = costs().step(old, s)[0], costs().step(new, s)[0]
                        if old == new:
                            break
                yield r["conv"], r["pid"], r["next_vec"], r["start_vec"] if old == new else _spell(new)
        yield from _batches(rows(), _VECTORS)
    again = open_chunks.select("conv", "pid", "sub", "symbols").join(wrong, ["conv", "pid"])
    return arrow_map(_by_segment(again), work, VECTORS)


def by_matrices(open_chunks: DataFrame, unsettled: DataFrame) -> DataFrame:
    """``conv, pid, end_vec`` of whole conversations from their segments' cost matrices, last to first."""
    units = [tuple(0 if i == j else FAR for i in range(4)) for j in range(4)]
    schema = _arrow(conv=pa.string(), pid=pa.int64(), columns=pa.list_(pa.string()), takens=pa.list_(pa.int64()))

    def matrices(batches):
        def rows():
            for run in _segment_runs(batches):
                columns, takens = list(units), [0] * 4
                for r in run:
                    for j in range(4):
                        columns[j], taken = costs().back(columns[j], r["symbols"])
                        takens[j] += taken
                yield r["conv"], r["pid"], list(map(_spell, columns)), takens
        yield from _batches(rows(), schema)

    def chain(batches):
        def rows():
            conv, vector = None, END
            for r in _records(batches):
                if r["conv"] != conv:
                    conv, vector = r["conv"], END
                yield conv, r["pid"], _spell(vector)
                columns = [_read(c) for c in r["columns"]]
                new = [min(columns[j][i] + r["takens"][j] + vector[j] for j in range(4)) for i in range(4)]
                vector = tuple(v - min(new) for v in new)
        yield from _batches(rows(), _arrow(conv=pa.string(), pid=pa.int64(), end_vec=pa.string()))

    those = open_chunks.select("conv", "pid", "sub", "symbols").join(unsettled.select("conv").distinct(), "conv")
    found = arrow_map(_by_segment(those), matrices,
                      "conv string, pid bigint, columns array<string>, takens array<bigint>")
    # a conversation has one small record per partition
    found = found.repartition("conv").sortWithinPartitions("conv", F.desc("pid"))
    return stored(arrow_map(found, chain, "conv string, pid bigint, end_vec string"), "chained")


def settle(open_chunks: DataFrame, rounds: int) -> DataFrame:
    """``conv, pid, end_vec``: the right vector after each segment."""
    vectors = speculate(open_chunks)
    after = Window.partitionBy("conv").orderBy("pid")  # at most one record per partition
    k = 0
    while True:
        told = vectors.withColumn("next_vec", F.coalesce(F.lead("start_vec").over(after), F.lit(_spell(END))))
        wrong = stored(told.where("next_vec != end_vec"), "wrong")
        if wrong.isEmpty():
            return vectors.select("conv", "pid", "end_vec")
        if k == rounds:
            break
        k += 1
        rest = vectors.join(wrong.select("conv", "pid"), ["conv", "pid"], "left_anti")
        vectors = stored(rest.unionByName(fix_up(open_chunks, wrong)), "vectors")
    settled = vectors.join(wrong.select("conv").distinct(), "conv", "left_anti").select("conv", "pid", "end_vec")
    return settled.unionByName(by_matrices(open_chunks, wrong))


# ---------------------------------------------------------------- traces

PIECES = "conv string, pos bigint, state int, letters string, symbols string"
_PIECES = _arrow(conv=pa.string(), pos=pa.int64(), state=pa.int32(), letters=pa.string(), symbols=pa.string())


def traces(conversations: DataFrame, chunk: int = CHUNK, rounds: int = FIX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The ordered rows, and ``conv, pos, state, letters, symbols`` of every chunk."""
    rows = ordered(conversations)
    parts = chunks(faults(rows), chunk)
    closed = parts.where("first_pid = last_pid").withColumn("end_vec", F.lit(_spell(END)))
    opened = parts.where("first_pid < last_pid")
    if not opened.isEmpty():
        closed = closed.unionByName(opened.join(settle(opened, rounds), ["conv", "pid"]))
    variants = _arrow(conv=pa.string(), pos=pa.int64(), symbols=pa.string(), letters=pa.list_(pa.string()),
                      ends=pa.list_(pa.int32()))

    def trace(batches):
        def found():
            for run in _segment_runs(batches):
                vector = None
                for r in run:
                    vector = vector or _read(r["end_vec"])
                    starts = (0,) if r["pos"] == r["first_pos"] else range(4)
                    ways = costs().trace(vector, r["symbols"], r["pos"] == r["last_pos"], starts)
                    yield r["conv"], r["pos"], r["symbols"], [w for w, _ in ways], [q for _, q in ways]
                    vector, _ = costs().back(vector, r["symbols"])
        yield from _batches(found(), variants)

    def meet(batches):
        def found():
            conv = q = None
            for r in _records(batches):
                if r["conv"] != conv:
                    conv, q = r["conv"], 0
                yield conv, r["pos"], q, r["letters"][q], r["symbols"]
                q = r["ends"][q]
        yield from _batches(found(), _PIECES)

    ways = arrow_map(_by_segment(closed), trace,
                     "conv string, pos bigint, symbols string, letters array<string>, ends array<int>")
    # one record per chunk, streamed in order
    ways = ways.repartition("conv").sortWithinPartitions("conv", "pos")
    return rows, stored(arrow_map(ways, meet, PIECES), "turn-traces")


def _edits(piece: dict, rows: Iterator[dict]) -> Iterator[tuple]:
    """``letter, row or None, repaired role or None`` of one chunk's edits, in order; a row has its ``fault``."""
    state, symbols = piece["state"], iter(piece["symbols"])
    for letter in piece["letters"]:
        row, role = None, 3
        if letter != "I":
            row = next(rows)
            role, row["fault"] = divmod(ord(next(symbols)) - 65, 4)
        if letter == "D":
            yield letter, row, None
        elif letter == "K":
            state = KEPT[state][role]
            yield letter, row, row["role"]
        else:
            state = WANTED[state]
            yield letter, row, "assistant" if state == 3 else "user"


def _events(rows: DataFrame, pieces: DataFrame, by: str) -> DataFrame:
    """Rows and the traces that apply to them, each trace before its rows, in order."""
    both = rows.select("conv", "pos", "turn", "role", "text").unionByName(pieces, allowMissingColumns=True)
    both = both.withColumn("pid", F.shiftright("pos", 33))
    return both.repartition(by).sortWithinPartitions("conv", "pos", F.col("letters").isNull()).drop("pid")


def _edit_stream(batches) -> Iterator[tuple[str, tuple]]:
    """``conversation, edit`` over a sorted stream of traces and rows."""
    stream = _records(batches)
    for r in stream:
        for edit in _edits(r, stream):
            yield r, edit


def repair(conversations: DataFrame, chunk: int = CHUNK, rounds: int = FIX_ROUNDS) -> DataFrame:
    """``conv_id, seq, edit, fault, role, text``: the edits in order (``seq`` ascending within a
    conversation) with the repaired row; a deleted row keeps its own role and text."""
    rows, pieces = traces(conversations, chunk, rounds)
    schema = _arrow(conv=pa.string(), pos=pa.int64(), n=pa.int64(), edit=pa.string(), fault=pa.string(),
                    role=pa.string(), text=pa.string())

    def work(batches):
        def found():
            for piece, (letter, row, role) in _edit_stream(batches):
                piece["n"] = piece.get("n", 0) + 1
                fault = FAULTS[row["fault"]] if row else ""
                yield (piece["conv"], piece["pos"], piece["n"], letter, fault or None,
                       row["role"] if role is None else role, row["text"] if row else "")
        yield from _batches(found(), schema, 500)

    found = arrow_map(_events(rows, pieces, "pid"), work,
                      "conv string, pos bigint, n bigint, edit string, fault string, role string, text string")
    # a place in the whole conversation without counting it: chunk, then edit in the chunk
    return found.select(
        _conv_id(conversations), F.struct("pos", "n").alias("seq"), "edit", "fault", "role", "text")


AUDIT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
         "audit string, repaired_sha256 string")
_AUDIT = _arrow(conv=pa.string(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
                audit=pa.string(), repaired_sha256=pa.string())


class _Tally:
    """What ``audit`` says of one conversation, row by row."""

    def __init__(self):
        self.low = self.high = self.turn = self.letter = None
        self.turns = self.illegal = self.cost = self.repaired = 0
        self.faults = [0] * 4
        self.letters: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, letter: str, row: dict | None, role: str | None) -> None:
        self.letters.append(letter)
        self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter]
        if row is not None:
            fault, first = row["fault"], row["role"][:1]
            self.faults[fault] += 1
            self.cost += TRUNCATED if fault == 3 and letter != "D" else 0
            if self.letter is not None and self.letter + first not in ("su", "ua", "au"):
                self.illegal += 1
            self.letter = first
            if row["turn"] is not None:
                self.turns += self.turn != row["turn"]
                self.low, self.high, self.turn = row["turn"] if self.low is None else self.low, row["turn"], row["turn"]
        if role is not None:
            self.digest.update(("\n" if self.repaired else "").encode() + f"{role}:{row['text'] if row else ''}".encode())
            self.repaired += 1

    def row(self, conv: str) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def audit(conversations: DataFrame, chunk: int = CHUNK, rounds: int = FIX_ROUNDS) -> DataFrame:
    """One row per conversation: its faults before and the edits, their cost and the repaired text's hash."""
    rows, pieces = traces(conversations, chunk, rounds)

    def work(batches):
        def found():
            conv, tally = None, None
            for piece, edit in _edit_stream(batches):
                if piece["conv"] != conv:
                    if tally:
                        yield tally.row(conv)
                    conv, tally = piece["conv"], _Tally()
                tally.add(*edit)
            if tally:
                yield tally.row(conv)
        yield from _batches(found(), _AUDIT)

    found = arrow_map(_events(rows, pieces, "conv"), work, "conv string, " + AUDIT)
    return found.select(_conv_id(conversations), "*").drop("conv")
