import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from claimforge.llm import conversations as C
from tests.llm.helpers import rows_by

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 0:
            out.append((conv, None, None, None))
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def edits_of(rows):
    """Uniform-cost search by (cost, letters): the first whole path is the ASCII-least cheapest."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, letters
        if re.fullmatch("s?(ua)*u?", roles) is None:
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 5, letters + "I", i, roles + r))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, roles))
            if fault in "-t":
                more = 5 * (fault == "t")
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, roles + r))


def dp(rows):
    """The same for long ones: (cost, letters) by state, with inserts at the end counted."""
    grow = {0: (0, ""), 1: (10**9, ""), 2: (10**9, ""), 3: (10**9, "")}

    def inserts(best):
        for _ in range(4):
            for s in range(4):
                to = C.NEW[s][1]
                best[to] = min(best[to], (best[s][0] + 5, best[s][1] + "I"))
        return best

    best = inserts(grow)
    for row in rows:
        after = {s: (10**9, "") for s in range(4)}
        for s in range(4):
            for letter, by, to, price in C.moves(row, s):
                if by:
                    after[to] = min(after[to], (best[s][0] + price, best[s][1] + letter))
        best = inserts(after)
    return min(best[0], best[3])


def brute(rows, search):
    convs = {}
    for r in damaged(rows):
        convs.setdefault(r[0], []).extend([] if r[3] is None else [r])
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for r in own:
            body = r[3].strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if r[2:] in seen else "-" if body[-1] in ".!?" else "t")
            seen.add(r[2:])
        initials = [r[2][:1] for r in own]
        cost, letters = search([(i or "\0", f) for i, f in zip(initials, faults)]) if own else (0, "")
        turns = [r[1] for r in own if r[1] is not None]
        said, left, i = [], "", 0
        fill = lambda: "assistant" if left and left[-1] == "u" else "user"
        for x in letters:
            role = None if x == "D" else own[i][2] if x == "K" else fill()
            if role is not None:
                said.append(f"{role}:{'' if x == 'I' else own[i][3]}")
                left += role[0]
            i += x != "I"
        assert i == len(own) and GOOD.fullmatch(left)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def _rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Hi! ", "So?\n", "", "  \t", "x.y", "Ω.", None, "long " * 30 + ".", "a\x85."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.8 else ["system", "tool", "", None, "User", "ux"])
            turn = None if rng.random() < 0.06 else t + rng.choice([0, 0, 0, 1])
            rows.append((c if c else None, turn, role, rng.choice(texts)))
    return [*rows, rows[-1], rows[3], rows[3]]


def _got(df, **more):
    return {k: tuple(r[c] for c in COLUMNS) for k, r in rows_by(C.repair(C.damage(df), **more), "conv_id").items()}


@pytest.mark.parametrize("size", [2, 256])
def test_against_uniform_cost_search(spark, size):
    rows = _rows(7, 160, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, edits_of)
    got = _got(df, size=size)
    assert got == want
    assert {k for v in want.values() for k in v[6]} == set("DKR") and any(v[6] == "" for v in want.values())


def test_long_conversations(spark):
    """Segments of a conversation lie in several partitions."""
    rows = [(c, t, r, x) for c, t, r, x in _rows(9, 3, 400) if c is not None]
    rows += [(77, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t}.") for t in range(1500)]
    rows += [(78, 5, "user", "again.")] * 700
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _got(df, size=16) == brute(rows, dp)
        parts = C.segments(C.row_faults(C.damage(df)), 16)
        assert max(r["n"] for r in parts.groupBy("conv_id").agg({"part": "count"}).withColumnRenamed("count(part)", "n").collect()) > 20
        assert parts.filter("conv_id = 77").select("part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_search_against_dp():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("uuaasx"), rng.choice("---bdt")) for _ in range(rng.randrange(1, 14))]
        costs, letters, _ = C.ways("".join(i + f for i, f in rows))
        ends = [(costs[at] + 5 * C.MISSING[at], letters[at] + "I" * C.MISSING[at]) for at in range(4) if costs[at] >= 0]
        assert min(ends) == dp(rows)


def test_no_rows_empty_table_more_columns(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "x.")], SCHEMA)
    assert _got(df) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair(C.damage(df.limit(0))).count() == 0
    rows = _rows(2, 20, 6)
    plain = spark.createDataFrame(rows, SCHEMA)
    odd = plain.selectExpr("*", "1 as digest", "2 as gone", "3 as part", "4 as `a.b`", "5 as fault", "6 as kind")
    assert _got(odd) == _got(plain)
