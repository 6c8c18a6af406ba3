"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

A text is cut into units ``white space run + word``: no piece of the vocabulary has a
white-space mark after another character (checked on load), so no merge crosses a unit.
Every distinct unit of a slice of texts is encoded once.  The symbols of all units lie in
one flat array; a round finds each unit's best pair (lowest rank, leftmost) by a segmented
minimum, merges them all at once, compacts the array and drops the units without a pair.
One merge per unit and round is the library's own order, so the ids are the same.
Units over ``LONG_UNIT`` symbols, for which whole-array rounds would be quadratic, take
the same merges from a heap.

The ids of a text are packed as little-endian unsigned 32-bit integers (binary), with
begin and end ids.  Defined results: null and empty texts encode to the begin and end
ids alone and decode to the empty string; repeated rows are encoded each; a text without white space
is one unit of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, char_codes, release, spread, texts_of
from claimforge.llm.token_counts import vocabulary_path

MODEL = "piece_bpe_32k.model"
SLICE_BYTES = 2 << 20
LONG_UNIT = 256
MARK = "▁"
NONE = np.int64(1) << 40  # rank of a pair that is no piece
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model file


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if key & 7 == 1 else 4
            if key & 7 == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Vocabulary:
    text: list[str]
    kind: np.ndarray
    rank: np.ndarray  # per piece; a lower rank merges first
    char_id: dict[int, int]  # code point -> piece of that one character
    byte_id: np.ndarray  # byte -> piece
    begin: int
    end: int
    slots: np.ndarray  # open-addressed table: left << 32 | right, -1 where free
    merged: np.ndarray  # piece made by the pair in that slot
    probes: int
    surface: np.ndarray  # bytes that each piece decodes to, one after another
    at: np.ndarray  # where they start (one more than pieces)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair merges to, -1 for none."""
        key = (left << 32) | right
        mask = len(self.slots) - 1
        slot = _slot(key, mask)
        out = np.where(self.slots[slot] == key, self.merged[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[slot] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot_ = slot[open_] = (slot[open_] + 1) & mask
            found = self.slots[slot_] == key[open_]
            out[open_[found]] = self.merged[slot_[found]]
            open_ = open_[~found & (self.slots[slot_] >= 0)]
        return out


def _slot(key: np.ndarray, mask: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask


@lru_cache(maxsize=2)
def load(name_or_path: str) -> Vocabulary:
    with open(vocabulary_path(name_or_path), "rb") as f:
        top = list(_fields(f.read()))
    parts = [dict(_fields(v)) for n, v in top if n == 1]
    trainer = dict(_fields(next(v for n, v in top if n == 2)))
    normal = dict(_fields(next(v for n, v in top if n == 3)))
    if trainer.get(3) != 2 or trainer.get(35) != 1 or normal.get(2) or normal.get(3, 1) != 1 or normal.get(4, 1) != 0:
        raise ValueError("needs a BPE model with byte fallback, dummy prefix and no text normalisation")
    text = [p[1].decode() for p in parts]
    kind = np.array([p.get(3, NORMAL) for p in parts])
    if not set(kind.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined pieces are not supported")
    score = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in parts])
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
    ids = {t: i for i, t in enumerate(text) if kind[i] == NORMAL}
    if any(MARK in t.lstrip(MARK) for t in ids):
        raise ValueError("a piece crosses white space")
    pairs = {}
    for t, i in ids.items():
        for k in range(1, len(t)):
            a, b = ids.get(t[:k]), ids.get(t[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = i
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    slots, merged = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    probes = 0
    keys = np.fromiter(pairs, np.int64, len(pairs))
    for key, slot, value in zip(keys.tolist(), _slot(keys, size - 1).tolist(), pairs.values(), strict=True):
        n = 0
        while slots[slot] >= 0:
            slot, n = (slot + 1) & (size - 1), n + 1
        slots[slot], merged[slot], probes = key, value, max(probes, n)
    byte_id = np.zeros(256, np.int64)
    surface = []
    for i, t in enumerate(text):
        if kind[i] == BYTE:
            byte_id[int(t[3:5], 16)] = i
            surface.append(bytes([int(t[3:5], 16)]))
        else:
            surface.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(int(kind[i]), t.replace(MARK, " ")).encode())
    return Vocabulary(
        text, kind, rank, {ord(t): i for t, i in ids.items() if len(t) == 1}, byte_id,
        trainer.get(41, 1), trainer.get(42, 2), slots, merged, probes,
        np.frombuffer(b"".join(surface), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in surface])]),
    )


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(unit offsets per text, unit codes, distinct units), a unit being marks and a word."""
    texts = pc.replace_substring(texts, MARK, " ")
    lists = pc.split_pattern(texts, " ")
    parts = lists.flatten()
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    ends = np.zeros(len(parts), bool)
    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    ends[off[1:][filled] - 1] = True  # marks that no word follows
    ends |= pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
    at = np.flatnonzero(ends)
    doc = np.searchsorted(off, at, side="right") - 1
    before = np.concatenate([[-1], at[:-1]])
    marks = at - np.maximum(before, off[doc] - 1)
    coded = parts.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
    key, inverse = np.unique(code << 32 | marks, return_inverse=True)
    words = coded.dictionary.take(pa.array(key >> 32)).to_pylist()
    units = [MARK * n + w for n, w in zip((key & 0xFFFFFFFF).tolist(), words, strict=True)]
    return np.searchsorted(at, off), inverse.astype(np.int64), pa.array(units, pa.large_string())


def merge_rounds(v: Vocabulary, sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all units after all merges: (symbols, start of each unit, length of each unit)."""
    n_units = len(off) - 1
    start, length, done, filled = np.zeros(n_units, np.int64), np.zeros(n_units, np.int64), [], 0
    unit = np.flatnonzero(np.diff(off) > 0)
    sym = sym.copy()
    lens = np.diff(off)[unit]

    def ranks(at):
        """Rank and merged piece of the pairs (at, at + 1); ``at`` is never a unit's last."""
        to = v.pair(sym[at], sym[at + 1])
        return np.where(to >= 0, v.rank[to], NONE), to

    last = np.zeros(len(sym), bool)
    last[np.cumsum(lens) - 1] = True
    rank, into = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
    inner = np.flatnonzero(~last)
    rank[inner], into[inner] = ranks(inner)
    while len(unit):
        heads = np.cumsum(lens) - lens
        n = len(sym)
        best = np.minimum.reduceat(rank * n + np.arange(n), heads)
        at, live = best % n, best < NONE * n
        if not live.all():  # units without a pair leave
            out = ~live
            done.append(sym[spread(heads[out], lens[out])])
            start[unit[out]] = filled + np.cumsum(lens[out]) - lens[out]
            length[unit[out]] = lens[out]
            filled += int(lens[out].sum())
        at = at[live]
        sym[at] = into[at]
        keep = np.repeat(live, lens)
        keep[at + 1] = False
        last[at] = last[at + 1]
        new = np.cumsum(keep) - 1
        at = new[at]
        sym, last, rank, into = sym[keep], last[keep], rank[keep], into[keep]
        unit, lens = unit[live], lens[live] - 1
        ended = last[at]
        rank[at[ended]] = NONE
        right = at[~ended]
        rank[right], into[right] = ranks(right)
        left = at[at > 0] - 1
        left = left[~last[left]]
        rank[left], into[left] = ranks(left)
    return (np.concatenate(done) if done else sym), start, length


def merge_heap(v: Vocabulary, sym: list[int]) -> list[int]:
    """The same merges for one long unit, from a heap of (rank, position)."""
    one = np.array(sym, np.int64)
    to = v.pair(one[:-1], one[1:])
    heap = [(int(v.rank[t]), i, i + 1, int(t)) for i, t in enumerate(to.tolist()) if t >= 0]
    heapq.heapify(heap)
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    sym, alive = list(sym), [True] * len(sym)
    known: dict[tuple[int, int], int] = {}

    def push(i, j):
        pair = sym[i], sym[j]
        if pair not in known:
            known[pair] = int(v.pair(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))[0])
        if (t := known[pair]) >= 0:
            heapq.heappush(heap, (int(v.rank[t]), i, j, t))

    made = {}  # (left, right) symbols when pushed are checked by the piece they make
    while heap:
        _, i, j, t = heapq.heappop(heap)
        if not alive[i] or j >= len(sym) or not alive[j] or nxt[i] != j:
            continue
        pair = sym[i], sym[j]
        if pair not in made:
            made[pair] = int(v.pair(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))[0])
        if made[pair] != t:
            continue
        sym[i], alive[j], nxt[i] = t, False, nxt[j]
        if nxt[j] < len(sym):
            prv[nxt[j]] = i
            push(i, nxt[j])
        if prv[i] >= 0:
            push(prv[i], i)
    return [s for s, a in zip(sym, alive, strict=True) if a]


def encode_units(v: Vocabulary, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, length) of each distinct unit, characters without a piece as bytes."""
    chars, off = char_codes(units)
    points, inverse = np.unique(chars, return_inverse=True)
    missing = len(v.text)  # such characters become missing + index, which no pair has
    char_sym = np.array([v.char_id.get(int(p), missing + i) for i, p in enumerate(points)], np.int64)
    sym = char_sym[inverse] if len(points) else np.zeros(0, np.int64)
    lens = np.diff(off)
    short = lens <= LONG_UNIT
    ids = np.flatnonzero(short)
    flat, start, length = merge_rounds(v, sym[spread(off[:-1][short], lens[short])], np.concatenate([[0], np.cumsum(lens[short])]))
    starts, lengths, parts, filled = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64), [flat], len(flat)
    starts[ids], lengths[ids] = start, length
    for u in np.flatnonzero(~short).tolist():
        got = np.array(merge_heap(v, sym[off[u] : off[u + 1]].tolist()), np.int64)
        starts[u], lengths[u], filled = filled, len(got), filled + len(got)
        parts.append(got)
    flat = np.concatenate(parts)
    if (flat >= missing).any():  # byte fallback
        coded = [v.byte_id[list(chr(int(p)).encode())] for p in points]
        size = np.array([len(c) for c in coded])
        place = np.cumsum(size) - size
        coded = np.concatenate(coded)
        lost = flat >= missing
        width = np.where(lost, size[np.where(lost, flat - missing, 0)], 1)
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(flat, width)
        out[spread(ends[:-1][lost], width[lost])] = coded[spread(place[flat[lost] - missing], width[lost])]
        lengths = ends[starts + lengths] - ends[starts]
        starts, flat = ends[starts], out
    return flat, starts, lengths


def encode_slice(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with begin and end ids, offsets)."""
    unit_off, codes, units = units_of(texts)
    flat, start, length = encode_units(v, units)
    sums = np.concatenate([[0], np.cumsum(length[codes])])
    sizes = sums[unit_off[1:]] - sums[unit_off[:-1]] + 2
    off = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(off[-1], np.uint32)
    inside = np.ones(off[-1], bool)
    inside[off[:-1]] = inside[off[1:] - 1] = False
    out[off[:-1]], out[off[1:] - 1] = v.begin, v.end
    out[inside] = flat[spread(start[codes], length[codes])]
    return out, off


def decode_slice(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """Text of each run of ids; one leading space, the dummy prefix, is dropped."""
    ids = ids.astype(np.int64)
    sizes = v.at[ids + 1] - v.at[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])[off]
    data = v.surface[spread(v.at[ids], sizes)].tobytes()
    out = []
    for i in range(len(off) - 1):
        own = ids[off[i] : off[i + 1]]
        raw = data[ends[i] : ends[i + 1]]
        head = own[:8][v.kind[own[:8]] != CONTROL] if len(own) else own
        if not len(head):
            head = own[v.kind[own] != CONTROL][:1]
        drop = len(head) and v.kind[head[0]] == NORMAL and v.text[head[0]].startswith(MARK)
        try:
            if (v.kind[own[1:-1]] == CONTROL).any():  # one ends a run of bytes
                raise ValueError
            out.append(raw[int(drop) :].decode())
        except ValueError:  # also of bytes that are no characters
            out.append(_decode_broken(v, own, bool(drop)))
    return out


def _decode_broken(v: Vocabulary, ids: np.ndarray, drop: bool) -> str:
    """As the library: every byte of a byte run that is no part of a character becomes U+FFFD."""
    out, run = [], bytearray()

    def flush():
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    if size == 4 or at + size >= len(run):
                        out.append("�")
                        at += 1
                        break
        run.clear()

    for i in ids.tolist():
        piece = v.surface[v.at[i] : v.at[i + 1]].tobytes()
        if v.kind[i] == BYTE:
            run += piece
        else:
            flush()
            out.append(piece.decode())
    flush()
    return "".join(out)[int(drop) :]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``id, n_tokens, ids (binary), decoded`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                ids, off = encode_slice(v, texts[lo:hi])
                packed = [ids[a:b_].astype("<u4").tobytes() for a, b_ in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array(np.diff(off)), pa.array(packed, pa.binary()), pa.array(decode_slice(v, ids, off), pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string")
        .withColumnRenamed("id", id_col)
    )


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``encode_decode``."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
