"""MinHash near-dedup by a signature-coordinate inverted join.

1. *Sets and signatures.*  A document's set holds the 64-bit hashes of its distinct shingles
   of ``SHINGLE`` words (a shorter text: its whole word sequence); ``COORDINATES`` min-hashes
   are its signature.  Equal sets are one *node*, so exact copies are joined once.
2. *Postings.*  A node is posted under its (coordinate, value) pairs.  Two nodes that agree in
   ``MATCHES`` coordinates share a pair among the ``COORDINATES - MATCHES + 1`` pairs of each
   that come first in one global order, the rarest first (prefix filter).  Pairs that one node
   alone has come first of all and are never shuffled on, so most nodes post nothing, and the
   pairs of passages which many documents share come last.
3. *Bounds.*  Of a posted node's full set, ``lone`` shingles are in no other posted node's.  Two
   sets can't share more than the smaller of their other shingles, which rules out, exactly,
   most edited copies of one text for each other.
4. *Merging the lists.*  A node's home is the most widely shared leader of its lists: edited copies
   of one text have one home, however many lists they share.  Homes are cut into units of about
   ``CHUNK`` nodes, and two units meet in one task if any list has nodes of both: a pair of
   nodes is compared once, in a task of bounded size, not once for every list that has it.
5. *Counting and confirmation.*  A task counts the coordinates in which its pairs agree.  Pairs with
   ``MATCHES`` or more, best first, compare their full sets, as bit sets over the task's shared
   shingles, unless links already join them: linked if ``100 * intersection >= PERCENT *
   union``.  It returns one edge per linked node, to the least node of its local component.

A pair at the similarity limit agrees in fewer than ``MATCHES`` = 40 of 64 coordinates with a
probability of about 2e-6; links above it are lost more rarely still, and no false link is made.

Defined results: texts without words have an empty set and link with nothing; rows with a
null id link with nothing; rows that repeat a text are in one component with their equals, rows that repeat
an id with another text are documents of their own; ties of similarity do not matter, as every link counts;
an empty table gives an empty result; the input's other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from claimforge.llm.common import as_row, byte_slices, cut, from_row, mix64, named, release, split_by_keys, texts_of, word_hashes, word_tokens
from claimforge.llm.components import connected_components
from claimforge.session import passing_tables

SHINGLE = 5
PERCENT = 85
COORDINATES = 64
MATCHES = 40
CHUNK = 128
SEED = 12345
SLICE_BYTES = 2 << 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in byte_slices(texts, SLICE_BYTES):
        off, codes, words = word_tokens(texts[lo:hi], lower=True)
        h = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        rolled = mix64(rolled)
        for i in range(hi - lo):
            a, b = int(off[i]), int(off[i + 1])
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = mix64(np.array([one]))[0] ^ x
                out.append(mix64(np.array([one])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, seed: int = SEED) -> np.ndarray:
    """Minima of ``coordinates`` multiply-shift hashes, 32 bits each."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    best = np.full(coordinates, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        block = shingles[at : at + 2048]
        best = np.minimum(best, ((a[:, None] * block + b[:, None]) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32).view(np.int32)


def set_node(shingles: np.ndarray) -> int:
    """64-bit name of a set of shingles."""
    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sign(docs: DataFrame, id_col: str, text_col: str, size: int, coordinates: int, with_sets: bool = False, with_text: bool = False) -> DataFrame:
    """``id, n, node, sig`` of each row (node null for an empty set), with ``shingles`` or ``text`` if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                sets = shingle_sets(texts[lo:hi], size)
                cols = [
                    b.column(0)[lo:hi],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s, coordinates) if len(s) else [] for s in sets], pa.list_(pa.int32())),
                ]
                names = ["id", "n", "node", "sig"]
                if with_sets:
                    cols.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                    names.append("shingles")
                if with_text:
                    cols.append(b.column(1)[lo:hi])
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names)
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, node bigint, sig array<int>" + ", shingles array<bigint>" * with_sets + ", text string" * with_text
    return docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")).mapInArrow(run, schema)


def prefix_postings(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``token, node, wide``: the prefix of each node's (coordinate, value) pairs that other nodes share, and
    how widely all its pairs are shared."""
    pairs = nodes.select("node", F.posexplode("sig").alias("k", "value"))
    token = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = pairs.select("node", token.alias("token"))
    shared = cut(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "pair-counts")
    met = pairs.join(shared, "token").groupBy("node")
    met = met.agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"), F.sum("f").alias("wide"))
    first = F.size("s") - matches + 1  # of the prefix, the rest are pairs of this node alone
    met = met.filter(first > 0).select("node", "wide", F.explode(F.slice("s", 1, first)).alias("p"))
    return met.select("node", "wide", F.col("p.token").alias("token"))


def set_bounds(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, rest`` of the nodes that can be linked at all, ``rest`` being the shingles that another node has too."""
    lone = sets.select("node", F.explode("shingles").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    lone = lone.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    rest = sets.select("node", "n").join(lone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("rest"))
    return rest.filter(F.col("rest") * 100 >= F.col("n") * percent)


def task_members(postings: DataFrame, chunk: int) -> DataFrame:
    """``h1, c1, h2, c2, second, node``: the nodes of every two units that share a list."""
    leaders = postings.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.max(F.struct("wide", "node")).alias("leader"))
    leaders = cut(leaders.filter("f > 1").select("token", "leader"), "leaders")
    lists = cut(postings.join(leaders, "token").select("token", "node", "n", "leader"), "lists")
    homes = lists.groupBy("node").agg(F.first("n").alias("n"), F.max("leader").alias("leader"))
    homes = cut(homes.select("node", "n", F.col("leader.node").alias("home")), "homes")
    size = F.greatest(F.count(F.lit(1)) / F.lit(chunk), F.sum("n") / F.lit(chunk * 1024))
    crowd = cut(homes.groupBy("home").agg(F.ceil(size).cast("int").alias("units")), "home-sizes")
    units = homes.join(crowd, "home").select("node", "home", F.pmod(F.xxhash64("node"), "units").cast("int").alias("unit"))
    units = cut(units, "units")
    held = cut(lists.select("token", "node").join(units, "node").select("token", "home", "unit").distinct(), "units-of-lists")
    one = held.select("token", F.struct("home", "unit").alias("x"))
    met = one.join(one.select("token", F.col("x").alias("y")), "token").filter("x <= y").select("x", "y").distinct()
    sides = F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = met.select("x", "y", F.explode(sides).alias("second"))
    key = [F.col("x.home").alias("h1"), F.col("x.unit").alias("c1"), F.col("y.home").alias("h2"), F.col("y.unit").alias("c2")]
    own = F.when(F.col("second") == 1, F.col("y")).otherwise(F.col("x"))
    met = cut(met.select(*key, "second", own["home"].alias("home"), own["unit"].alias("unit")), "tasks")
    return met.join(units, ["home", "unit"]).select("h1", "c1", "h2", "c2", "second", "node")


def task_links(node, second, n, rest, sig, shingles, matches: int, percent: int) -> list[tuple[int, int]]:
    """One edge per linked node of a task, to the least node of its local component."""
    size = len(node)
    first = np.flatnonzero(~second)
    other = np.flatnonzero(second) if second.any() else first
    found = []
    for lo in range(0, len(first), 32):
        i = first[lo : lo + 32]
        agree = (sig[i][:, None, :] == sig[other][None, :, :]).sum(axis=2)
        most = np.minimum(rest[i][:, None], rest[other][None, :])
        p, q = np.nonzero((agree >= matches) & (most * 100 >= (n[i][:, None] + n[other][None, :] - most) * percent))
        found.append(np.column_stack([agree[p, q], i[p], other[q]]))
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    found = found[found[:, 1] != found[:, 2]] if not second.any() else found
    found = found[np.argsort(-found[:, 0], kind="stable")]
    root = list(range(size))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bits: dict[int, int] = {}
    if len(found):
        used = np.unique(found[:, 1:])
        every = np.concatenate([shingles[i] for i in used])
        _, place, times = np.unique(every, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # only shingles that two sets of the task have
        at = 0
        for i in used.tolist():
            own = place[at : at + len(shingles[i])]
            at += len(shingles[i])
            flags = np.zeros(int(number[-1]) + 1, np.uint8)
            flags[number[own[times[own] > 1]]] = 1
            bits[i] = int.from_bytes(np.packbits(flags).tobytes(), "big")
    for _, i, j in found.tolist():
        x, y = find(i), find(j)
        if x != y:
            both = (bits[i] & bits[j]).bit_count()
            if 100 * both >= percent * (n[i] + n[j] - both):
                root[max(x, y, key=lambda k: node[k])] = min(x, y, key=lambda k: node[k])
    return [(int(node[k]), int(node[find(k)])) for k in range(size) if root[k] != k]


def unit_links(members: DataFrame, sets: DataFrame, bounds: DataFrame, matches: int, percent: int) -> DataFrame:
    """``a, b``: the edges that all tasks return."""
    data = cut(sets.drop("n").join(bounds, "node"), "bounded-sets")
    key = ["h1", "c1", "h2", "c2"]
    rows = members.join(data, "node").select(*key, "second", "node", "n", "rest", "sig", "shingles")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def links():
            t = pa.Table.from_batches(held)
            get = lambda c: t[c].to_numpy()
            sig = np.stack(t["sig"].to_numpy())
            edges = task_links(get("node"), get("second") == 1, get("n"), get("rest"), sig, t["shingles"].to_numpy(), matches, percent)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            ids = np.column_stack([b[c].to_numpy() for c in key])
            edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                now = tuple(ids[lo].tolist())
                if held and now != last:
                    yield links()
                    held.clear()
                held.append(b.slice(lo, hi - lo))
                last = now
        if held:
            yield links()

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``."""
    return verdicts(docs, id_col, text_col, **how).drop("node")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
             coordinates: int = COORDINATES, matches: int = MATCHES, chunk: int = CHUNK) -> DataFrame:
    """``near_groups`` with ``node``, the name of the row's set."""
    signed = cut(sign(docs, id_col, text_col, size, coordinates), "signatures")
    by_node = signed.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node")
    nodes = cut(by_node.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig")), "nodes")
    postings = cut(prefix_postings(nodes, coordinates, matches), "postings")
    # the full sets of all nodes that can be in a candidate pair
    wanted = cut(postings.select("node").distinct().join(nodes.select("node", "first"), "node"), "posted-nodes")
    own = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text"))
    own = own.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    sets = sign(own, "id", "text", size, coordinates, with_sets=True).join(wanted.select("node"), "node", "left_semi")
    sets = cut(sets.dropDuplicates(["node"]), "sets")
    bounds = cut(set_bounds(sets, percent), "bounds")
    members = task_members(postings.join(bounds, "node"), chunk)
    links = unit_links(members, sets, bounds, matches, percent)
    # smallest id of each component, then of each node that stands for two rows or more
    parts = connected_components(links).join(nodes.select("node", "first"), "node")
    parts = cut(parts, "components")
    smallest = cut(parts.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    linked = parts.join(smallest, "component").select("node", "component_id")
    alone = nodes.filter("rows > 1").join(parts.select("node"), "node", "left_anti").select("node", F.col("first").alias("component_id"))
    groups = cut(linked.unionByName(alone), "groups")
    rows = signed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    out = rows.join(groups, "node", "left").select("id", "n_shingles", "node", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, **how) -> DataFrame:
    """The input rows that stay, one document of each group, with their own columns; rows that
    repeat the id and the set of a row that stays are one.

    Only ids decide while an id has one row.  Rows whose id is not among those that go stay where they are, as
    bitmaps of these ids show; the rest is joined.  Rows that share an id are told apart by their sets."""
    with passing_tables(docs.sparkSession) as keep:
        verdict = cut(verdicts(docs, id_col, text_col, size=size, **how).filter("id IS NOT NULL"), "verdicts")
        by_id = verdict.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
        doubtful = keep(by_id.filter("rows > 1 OR NOT kept").select("id", (F.col("rows") > 1).alias("shared")), "doubtful-ids")
        shared = doubtful.filter("shared").select("id")
        several = not shared.isEmpty()
        if several:
            good = keep(verdict.join(shared, "id", "left_semi").filter("kept").select("id", "node").distinct(), "kept-sets")
    rows = as_row(docs, F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text"))
    alone, maybe = split_by_keys(rows, F.col("id"), doubtful.select("id"))
    stay = maybe.join(doubtful.select("id"), "id", "left_anti").select("row")
    if alone is not None:
        stay = alone.select("row").unionByName(stay)
    if several:
        mine = cut(maybe.join(shared, "id", "left_semi"), "shared-ids")
        # rows of one id and text have one set; without words, the text is the set
        sets = sign(mine.select("id", "text").distinct(), "id", "text", size, 1, with_text=True)
        same = (sets["id"] == good["id"]) & sets["node"].eqNullSafe(good["node"])
        sets = sets.join(good, same, "left_semi")
        one = F.coalesce(F.col("node").cast("string"), F.concat(F.lit("text "), F.coalesce(sets["text"], F.lit(""))))
        met = mine.join(sets, mine["id"].eqNullSafe(sets["id"]) & mine["text"].eqNullSafe(sets["text"]))
        met = met.groupBy(sets["id"], one.alias("one")).agg(F.first("row").alias("row"))
        stay = stay.unionByName(met.select("row"))
    return from_row(stay, docs.columns)
