"""Repair of the structure of damaged conversations by the cheapest edits.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``.  Edits, in the
order of its rows: Keep (0), Rerole to user or assistant (1), Delete (2; the only edit of blank and
duplicate rows) and Insert an empty user or assistant row (5); a truncated row that is not deleted
costs 5 more.  Of the cheapest edits the first letters that are ASCII-least are taken.

Method: iterative-deepening A* (``cheapest``).  A depth-first search tries the edits in ASCII order
under a cost bound, which goes up to the least cost that the last search left out; states that failed
are kept with the cost that they are known to need, and what the rest costs at least is known from its
faults and from neighbours that can't follow each other.  The first path that is accepted is the answer.

A long conversation is no unit of work.  Rows are sorted by range, so a conversation may lie in many
partitions, and are cut to segments of ``size`` rows.  Before a segment the grammar can be in one of
four states, so the search runs for each pair of states at its two ends.  A pass over the segments
from the last to the first, which holds four numbers, picks the way through; strings of different
ends of a segment differ before one of them ends, so their order settles ties.  At last the texts are
moved once, in the order of the conversation, and hashed as they come; only the digest of one
conversation, which has no parallel form, and its audit are worked in one task, with bounded memory.

Defined results: nulls of any column are one space where text is needed (so a row without text is
blank, one without role fits nowhere); rows of one turn are taken in the order of role and digest of
the text, null turns first; equal rows are duplicates of the first; a role without any character fits
nowhere; null ``conv_id`` is a conversation of its own; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import cut

SIZE = 16
BLANKS = " \t\n\x0b\x0c\r"

#: States of the grammar: nothing yet, after s, after u, after a.
NOTHING, S, U, A = range(4)
KEEP = {(NOTHING, "s"): S, (NOTHING, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: What a row that is inserted or gets a new role becomes.
NEW = {NOTHING: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
#: Rows to insert at the end.
MISSING = {NOTHING: 0, S: 2, U: 1, A: 0}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 60


def moves(row: tuple[str, str], state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows gone by, state, cost) of the edits at a row, in ASCII order."""
    initial, fault = row
    out = [("D", 1, state, DELETE), ("I", 0, NEW[state][1], INSERT)]
    if fault in "-t":
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in KEEP:
            out.append(("K", 1, KEEP[state, initial], more))
        out.append(("R", 1, NEW[state][1], REROLE + more))
    return out


def reachable(rows: list[tuple[str, str]], entry: int, end: int) -> bool:
    if end in (U, A):
        return True
    return entry == end or end == S and entry == NOTHING and any(initial == "s" and fault in "-t" for initial, fault in rows)


def suffix_needs(rows: list[tuple[str, str]]) -> list[int]:
    """What the rows from each on cost at least, whatever the state: DELETE for a row with a fault, REROLE for two
    sound rows that can't follow each other, no row counted twice (rows that must go don't part others)."""
    n = len(rows)
    least = [0] * (n + 2)
    after, between = n, 0  # the next row that may stay, the cost of those before it
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        least[i] = least[i + 1] + (fault != "-") * DELETE
        if fault == "-" and after < n and rows[after][1] == "-" and initial + rows[after][0] not in ("su", "ua", "au"):
            least[i] = max(least[i], between + REROLE + least[after + 1])
        after, between = (i, 0) if fault in "-t" else (after, between + DELETE)
    return least[: n + 1]


def cheapest(rows: list[tuple[str, str]], entry: int, end: int) -> tuple[int, str] | None:
    """(cost, letters) of the ASCII-least cheapest edits that lead from ``entry`` to ``end``; the last is one of a row."""
    if not reachable(rows, entry, end):
        return None
    n = len(rows)
    least = suffix_needs(rows)
    failed: dict[tuple[int, int], int] = {}  # what a state needs at least

    def needs(i: int, state: int) -> int:
        if i == n:
            return 0 if state == end else NEVER
        return failed.get((i, state), least[i])

    bound = needs(0, entry)
    while True:
        path: list[str] = []
        stack = [[0, entry, 0, iter(moves(rows[0], entry)), NEVER, 0]]  # row, state, cost so far, edits left, need, cost of the edit
        while stack:
            top = stack[-1]
            i, state, cost, left = top[:4]
            for letter, by, after, price in left:
                need = price + needs(i + by, after)
                if cost + need > bound:
                    top[4] = min(top[4], need)
                    continue
                path.append(letter)
                if i + by == n:
                    return cost + price, "".join(path)
                stack.append([i + by, after, cost + price, iter(moves(rows[i + by], after)), NEVER, price])
                break
            else:
                stack.pop()
                failed[i, state] = max(needs(i, state), top[4])
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], top[5] + failed[i, state])
        bound = failed[0, entry]


@lru_cache(maxsize=1 << 14)
def ways(codes: str) -> tuple[list[int], list[str], list[int]]:
    """Of each entry and end (4 entry + end): cost (-1: none), letters, place among the entry's ends by letters.
    ``codes`` holds initial and fault of each row."""
    rows = [(codes[k], codes[k + 1]) for k in range(0, len(codes), 2)]
    found = [cheapest(rows, entry, end) for entry in range(4) for end in range(4)]
    place = [0] * 16
    for entry in range(0, 16, 4):
        for k, at in enumerate(sorted((at for at in range(entry, entry + 4) if found[at]), key=lambda at: found[at][1])):
            place[at] = k
    return [f[0] if f else -1 for f in found], [f[1] if f else "" for f in found], place


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows damaged by a hash of conversation and turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(plain(text_col), "[.!?]", "")).otherwise(plain(text_col))
    times = F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(what == 4, "user").otherwise(plain(role_col))
    out = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (what == 0).alias("gone"), times.alias("time"))
    return out.drop("time")


KEY = ["conv_id", "turn", "role", "digest"]


def row_faults(rows: DataFrame) -> DataFrame:
    """The distinct rows, without texts: ``KEY``, how often, initial of the role, ``fault`` (b, d, t or -)."""
    body = F.rtrim("text", F.lit(BLANKS))
    own = F.when(body == "", "b").when(F.substring(body, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    keyed = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", _digest(), own.alias("own"))
    seen = cut(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"), F.first("own").alias("own")), "conversation-rows")
    again = seen.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    again = again.agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("turns").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    initial = F.when(F.col("role") == "", "\0").otherwise(F.substring("role", 1, 1))
    return seen.join(again, same, "left").select(*KEY, "times", initial.alias("initial"), F.when(later & (F.col("own") != "b"), "d").otherwise(F.col("own")).alias("fault"))


def _digest():
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")


def segments(faults: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows sorted by range and cut to segments: key of the first row, place, ``codes`` and the searches' results."""
    kinds = {f.name: f.dataType.simpleString() for f in faults.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", part bigint, seg bigint, codes string, costs array<bigint>, letters array<string>, place array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, out = TaskContext.get().partitionId(), 0, []
        key, codes = None, []

        def close():
            nonlocal seg
            out.append((*key, part, seg, "".join(codes), *ways("".join(codes))))
            seg += 1

        for b in batches:
            names = pa.schema([*(b.schema.field(k) for k in KEY), ("part", pa.int64()), ("seg", pa.int64()), ("codes", pa.string()), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("place", pa.list_(pa.int32()))])
            for *row, times, initial, fault in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(times):
                    if key is not None and (row[0] != key[0] or len(codes) >= size):
                        close()
                        key = None
                    if key is None:
                        key, codes = row, []
                    codes.append(initial + (fault if k == 0 or fault == "b" else "d"))
                    if len(out) >= 2000:
                        yield _batch(out, names)
                        out = []
        if key is not None:
            close()
        if out:
            yield _batch(out, names)

    spread = faults.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return spread.select(*KEY, "times", "initial", "fault").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), names)], schema=names)


def way_through(parts: DataFrame) -> DataFrame:
    """Of each segment and state before it: the letters and the end that the cheapest whole edits take."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", part bigint, seg bigint, codes string, letters array<string>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rest = (), []
        for b in batches:
            names = pa.schema([*(b.schema.field(k) for k in (*KEY, "part", "seg", "codes", "letters")), ("ends", pa.list_(pa.int32()))])
            out = []
            for *row, costs, letters, place in zip(*(c.to_pylist() for c in b.columns)):
                if conv != (row[0],):
                    conv, rest = (row[0],), [INSERT * MISSING[s] for s in range(4)]
                whole = [c + rest[at % 4] if c >= 0 else NEVER for at, c in enumerate(costs)]
                best = [min(range(e, e + 4), key=lambda at: (whole[at], place[at])) for e in range(0, 16, 4)]
                rest = [whole[at] for at in best]
                out.append((*row, [letters[at] for at in best], [at % 4 for at in best]))
            if out:
                yield _batch(out, names)

    back = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    return back.select(*KEY, "part", "seg", "codes", "costs", "letters", "place").mapInArrow(run, schema)


class _Conversation:
    """One conversation as its rows come in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.state, self.end = conv, hashlib.sha256(), NOTHING, NOTHING
        self.n = self.out = self.cost = self.turns = self.illegal = 0
        self.faults = dict.fromkeys("-bdt", 0)
        self.low = self.high = self.last = None
        self.audit: list[str] = []
        self.plan: deque[tuple[str, str, str]] = deque()

    def segment(self, codes: str, letters: list[str], ends: list[int]) -> None:
        groups, lo = letters[self.end], 0
        for k in range(0, len(codes), 2):
            hi = lo
            while groups[hi] == "I":
                hi += 1
            self.plan.append((codes[k], codes[k + 1], groups[lo : hi + 1]))
            lo = hi + 1
        self.audit.append(groups)
        self.end = ends[self.end]

    def say(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.out > 0) + f"{role}:{text}").encode())
        self.out += 1

    def new(self, text: str) -> None:
        role, self.state = NEW[self.state]
        self.say(role, text)

    def row(self, turn, role: str, text: str) -> None:
        initial, fault, edits = self.plan.popleft()
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.n > 0 and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.n += 1
        self.faults[fault] += 1
        for x in edits[:-1]:
            self.cost += INSERT
            self.new("")
        if edits[-1] == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (fault == "t")
        if edits[-1] == "R":
            self.cost += REROLE
            self.new(text)
        else:
            self.state = KEEP[self.state, initial]
            self.say(role, text)

    def result(self) -> tuple:
        for _ in range(MISSING[self.state]):
            self.cost += INSERT
            self.audit.append("I")
            self.new("")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(damaged: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per conversation of ``damaged`` (see ``damage``): faults, cost and letters of its cheapest edits,
    SHA-256 of the repaired rows ``role:text`` with a line break between them."""
    plan = way_through(cut(segments(row_faults(damaged), size), "conversation-segments"))
    none = lambda kind: F.lit(None).cast(kind)
    kept = damaged.select("conv_id", "turn", "role", _digest(), F.when(F.col("gone"), 2).otherwise(1).alias("kind"), none("bigint").alias("part"), none("bigint").alias("seg"), F.when(~F.col("gone"), F.col("text")).alias("text"), none("string").alias("codes"), none("array<string>").alias("letters"), none("array<int>").alias("ends"))
    plan = plan.select(*KEY, F.lit(0).alias("kind"), "part", "seg", none("string").alias("text"), "codes", "letters", "ends")
    order = [*KEY, "kind", "part", "seg"]
    rows = plan.unionByName(kept).repartition("conv_id").sortWithinPartitions(*order)
    kind = damaged.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            names = pa.schema([b.schema.field(0), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, turn, role, what, text, codes, letters, ends in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                if what == 0:
                    now.segment(codes, letters, ends)
                elif what == 1:
                    now.row(turn, role, text)
            if out:
                yield _batch(out, names)
                out = []
        if now is not None:
            yield _batch([now.result()], names)

    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return rows.select("conv_id", "turn", "role", "kind", "text", "codes", "letters", "ends").mapInArrow(run, schema)
