"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine at least ``c`` lie within squared distance ``2 - 2c``.  A seeded
rotation spreads that distance over all coordinates; they are split into ``BLOCKS`` blocks,
and by the pigeonhole principle a linked pair keeps at least one block within that block's
share of the budget, in proportion to its dimensions.

1. Equal vectors of a label are one *node* with a multiplicity.
2. Per block, a label's nodes are cut into slices of the block's first coordinate; a node is
   at home in one slice and a guest in every lower slice from which a node could still be in
   range.  The number of slices follows the label's size.  A crowded slice is cut into chunks
   of about ``CHUNK`` members, and every two chunks meet in a task of their own, so no task
   holds an unbounded group.
3. A task range-joins its two chunks in the block's coordinates, tile by tile.  A candidate is
   taken by the first block that has it in range (the union without a shuffle of pairs), and
   its cosine is computed in double precision from the vectors themselves.
4. Tasks return, per node, its number of links and one edge to the least node of its local
   component: linear in the nodes, however dense a group is.

Comparing vectors in high dimension prunes little when all directions are alike, so the work
in a label grows with the square of its nodes; what is moved does not, up to chunking.

Defined results: null labels, null, empty, zero or non-finite vectors, null components and
null ids link with nothing and stay; vectors of unequal length never link; rows that repeat
a vector are linked with one another; ties keep the smallest id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from claimforge.llm.common import cut
from claimforge.llm.components import connected_components

COSINE = 0.93
BLOCKS = 4
CHUNK = 2048
TILE = 512
PAIRS = 100_000
SEED = 99


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_starts(dim: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.unique(np.arange(blocks) * dim // blocks)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square is lost or beyond range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotated rows; every row comes out alike in any company (no blocked product)."""
    return np.einsum("ij,jk->ik", x, rotation(x.shape[1]), optimize=False)


def budgets(dim: int, cosine: float, blocks: int = BLOCKS) -> np.ndarray:
    """Squared-distance share of each block."""
    sizes = np.diff(np.append(block_starts(dim, blocks), dim))
    return (2 - 2 * cosine) * sizes / dim * (1 + 1e-9) + 1e-12


def slice_edges(dim: int, n: int, chunk: int, width: float) -> np.ndarray:
    """Upper edges of a label's slices but the last, of about equal mass for a random direction
    and none narrower than the range, beyond which guests would outnumber those at home."""
    for count in range(max(1, -(-n // chunk)), 1, -1):
        edges = np.array([NormalDist(0, dim**-0.5).inv_cdf(k / count) for k in range(1, count)])
        if count == 2 or np.diff(edges).min() >= width:
            return edges
    return np.zeros(0)


def valid_rows(vectors: pa.Array) -> np.ndarray:
    """Which vectors can link: finite, not empty, not all zero, no null inside."""
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        x = v.values
        if x is not None and len(x) and not x.null_count:
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            out[i] = np.isfinite(x).all() and (x != 0).any()
    return out


def named_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, dim, node, vector``; node and vector are null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, labels = b.column(2), b.column(1).to_pylist()
            ok = valid_rows(vectors) & ~np.array(b.column(0).is_null()) & ~np.array(b.column(1).is_null())
            node, dim = [None] * b.num_rows, [None] * b.num_rows
            for i in np.flatnonzero(ok).tolist():
                x = vectors[i].values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                dim[i] = len(x)
                node[i] = int.from_bytes(xxh3_128_digest(x.tobytes() + repr(labels[i]).encode())[:8], "little", signed=True)
            kept = pa.array([v.as_py() if o else None for v, o in zip(vectors, ok.tolist(), strict=True)], vectors.type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(node, pa.int64()), kept], ["id", "label", "dim", "node", "vector"])

    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kind = {c: t for c, t in rows.dtypes}
    return rows.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, dim int, node bigint, vector {kind['vector']}")


def members(nodes: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """``label, dim, block, slice, home, node, rows, vector``: every block and slice that a node is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, sizes = b["dim"].to_numpy(), b["size"].to_numpy()
            at, block, part, home = [], [], [], []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.stack([b["vector"][i].values.to_numpy(zero_copy_only=False) for i in own.tolist()]).astype(np.float64)
                lead = rotated(unit(x))[:, block_starts(dim)]
                reach = np.sqrt(budgets(dim, cosine)) + 1e-9
                for n in np.unique(sizes[own]).tolist():
                    same = sizes[own] == n
                    for k in range(lead.shape[1]):
                        edges = slice_edges(dim, n, chunk, reach[k])
                        high = np.searchsorted(edges, lead[same, k], side="left")
                        low = np.searchsorted(edges, lead[same, k] - reach[k], side="left")
                        for back in range(int((high - low).max(initial=0)) + 1):
                            there = high - back >= low
                            at.append(own[same][there])
                            block.append(np.full(there.sum(), k))
                            part.append((high - back)[there])
                            home.append(np.full(there.sum(), back == 0))
            order = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
            cols = [pa.array(np.concatenate(c)).cast(t) if c else pa.array([], t) for c, t in ((block, pa.int32()), (part, pa.int32()), (home, pa.bool_()))]
            for lo in range(0, len(order), 5000):  # small batches, as each row holds a vector
                take = order[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays(
                    [b[c].take(take) for c in ("label", "dim", "node", "rows", "vector")] + [c[lo : lo + 5000] for c in cols],
                    ["label", "dim", "node", "rows", "vector", "block", "slice", "home"],
                )

    kind = {c: t for c, t in nodes.dtypes}
    return nodes.select("label", "dim", "size", "node", "rows", "vector").mapInArrow(
        run, f"label {kind['label']}, dim int, node bigint, rows bigint, vector {kind['vector']}, block int, slice int, home boolean"
    )


def _least(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each of n points' components, given links and earlier labels."""
    label = label.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join_chunks(x: np.ndarray, chunk: np.ndarray, home: np.ndarray, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of one task, tile by tile: pairs within its one chunk or across its two."""
    x = unit(x.astype(np.float64))
    r = rotated(x)
    dim = x.shape[1]
    starts, budget = block_starts(dim), budgets(dim, cosine)
    own = r[:, starts[block] : np.append(starts, dim)[block + 1]]
    square = np.einsum("ij,ij->i", own, own)
    first, last = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    alone = chunk.min() == chunk.max()
    for lo in range(0, len(first), TILE):
        a = first[lo : lo + TILE]
        b = last[lo:] if alone else last
        near = square[a][:, None] + square[b] - 2 * own[a] @ own[b].T <= budget[block] + 1e-6
        near &= home[a][:, None] | home[b]
        p, q = np.nonzero(near)
        i, j = a[p], b[q]
        if alone:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), PAIRS):
            u, v = i[at : at + PAIRS], j[at : at + PAIRS]
            in_range = np.add.reduceat((r[u] - r[v]) ** 2, starts, axis=1) <= budget
            mine = in_range[:, block] & ~in_range[:, :block].any(axis=1)
            u, v = u[mine], v[mine]
            linked = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            yield u[linked], v[linked]


def task_links(table: pa.Table, cosine: float) -> pa.Table:
    """``node, links, root`` of a task's nodes that are linked there."""
    order = np.argsort(table["node"].to_numpy(), kind="stable")
    node, rows = table["node"].to_numpy()[order], table["rows"].to_numpy()[order]
    x = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)[order]
    chunk, home = table["chunk"].to_numpy()[order], np.array(table["home"])[order].astype(bool)
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for i, j in join_chunks(x, chunk, home, table["block"][0].as_py(), cosine):
        links += np.bincount(i, weights=rows[j], minlength=len(node)).astype(np.int64)
        links += np.bincount(j, weights=rows[i], minlength=len(node)).astype(np.int64)
        label = _least(len(node), i, j, label)
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "root": node[label[some]]})


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``."""
    named = cut(named_vectors(table, id_col, vector_col, label_col), "vectors")
    own = named.filter("node IS NOT NULL").groupBy("node", "label", "dim")
    nodes = cut(own.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("vector").alias("vector")), "nodes")
    sizes = cut(nodes.groupBy(F.col("label").alias("l"), F.col("dim").alias("d")).agg(F.count(F.lit(1)).alias("size")), "label-sizes")
    sized = nodes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    spread = cut(members(sized, cosine, chunk), "members")
    unit_key = ["label", "dim", "block", "slice"]
    crowd = spread.groupBy(*unit_key).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks")).filter("chunks > 1")
    crowd = cut(crowd, "crowded-slices")
    tasks = spread.join(crowd, unit_key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    tasks = tasks.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = tasks.withColumn("other", other).withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    kind = dict(nodes.dtypes)["node"]
    found = tasks.groupBy(*unit_key, "a", "b").applyInArrow(lambda t: task_links(t, cosine), f"node {kind}, links bigint, root {kind}")
    found = cut(found, "links")
    parts = cut(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    parts = parts.join(nodes.select("node", "first"), "node")
    smallest = cut(parts.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    linked = parts.join(smallest, "component").select("node", "component_id")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = nodes.select("node", "first", "rows").join(linked, "node", "left").join(counted, "node", "left")
    groups = groups.select("node", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = named.select("id", "node").join(cut(groups, "groups"), "node", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
