"""Katz backoff language model over words, trained and applied in one go.

Tokens of a text are its words (A-Z lowered) and one end mark.  The probability of a token after the
one before it (or the start of the text) is worked out by recursion:

* seen together ``r`` times in training: ``d(r) r / t``, where ``t`` counts what followed the context
  and ``d`` is the Good-Turing discount up to ``r = K`` (1 above);
* else ``alpha(context) P(token)``, ``alpha`` sharing out just what the discounts left, so that the
  probabilities after any context add up to one; an unknown context has ``alpha = 1``;
* ``P(token)`` is discounted the same way; what is left there is the probability of the unknown word.

Where the counts of counts give no discount between 0 and 1, a level takes half a count off every
count up to K; where nothing would be left, one count is added to ``t`` and left.

Counts grow with the corpus and are never in one place.  Texts are gathered in chunks of about
``CHUNK_BYTES``, stored as token codes.  A chunk asks for its distinct words, and then for its
distinct pairs, in parts dealt by hash: the task of a part holds that part of the count table, sums what
all chunks say of it, and answers each chunk in the order of its question.  The number of parts grows with
the tokens.  Pairs of one context are in one part, which knows the context's sums; contexts with
more than ``SPLIT`` tokens are dealt over several, and their sums are added up as rows.  Then every
chunk is scored with the answers to its own questions.  Blocks of integers go as byte planes.

Defined results: null or empty text is the end mark alone; a null id hashes as empty text; rows that
repeat an id are texts of their own; with no training rows every token is unknown, with probability 1;
an empty table gives an empty result; a text of any length is one piece of work, in the chunk that
it fills; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, cut, fold_bucket, mix64, release, texts_of, word_hashes, word_tokens

K = 5
FOLDS = 10
CHUNK_BYTES = 12 << 20
WORDS_A_PART = 1 << 20
TOKENS_A_PART = 2 << 20
SPLIT = 1 << 20
END = "\n"  # no word
START = 0  # the context of a first token; words have ids from 1
ADD = 0.1  # of the base score


# ---- blocks of integers ----

def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    head, planes = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, "<i8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(head, "<i8").tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    head = np.frombuffer(block, "<i8", 2 * n, 8).reshape(n, 2)
    size = int((head[:, 0] * head[:, 1]).sum())
    raw = np.frombuffer(pa.decompress(block[8 + 16 * n :], size, "zstd"), np.uint8)
    out, at = [], 0
    for length, width in head.tolist():
        x = np.zeros((length, 8), np.uint8)
        x[:, :width] = raw[at : at + length * width].reshape(width, length).T
        out.append(x.reshape(-1).view("<i8") if length else np.zeros(0, np.int64))
        at += length * width
    return out


def pack_words(words: pa.Array) -> bytes:
    raw = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
    return pack(pc.binary_length(words).to_numpy(zero_copy_only=False), raw)


def unpack_words(block: bytes) -> pa.Array:
    lens, raw = unpack(block)
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(ends), pa.py_buffer(raw.astype(np.uint8)))


def pack_ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], ["id"]))
    return sink.getvalue().to_pybytes()


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if held:
                    yield now, held
                    release()
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


# ---- the model's numbers ----

def discounts(counts: list[int]) -> np.ndarray:
    """``d(0), ..., d(K), 1`` from the numbers of items seen 1, ..., K + 1 times."""
    n = [0, *(int(c) for c in counts)]
    d = np.ones(K + 2)
    if all(n[1 : K + 2]):
        a = (K + 1) * n[K + 1] / n[1]
        if a != 1:
            d[1 : K + 1] = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, K + 1)]
            if ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all():
                return d
    d[1 : K + 1] = [1 - 0.5 / r for r in range(1, K + 1)]
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, K + 1)]


def left_over(total: np.ndarray, seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts that the discounts leave, counts to divide by); ``seen``: columns of how many items were seen 1, ..., K times."""
    r = np.arange(1, K + 1)
    left = seen[..., :K] @ ((1 - d[1 : K + 1]) * r)
    none = left <= 0
    return np.where(none, 1.0, left), np.where(none, total + 1.0, total)


class Unigrams:
    """Numbers of the words' level: ``counts`` has N, V and how many words were seen 1, ..., K + 1 times."""

    def __init__(self, counts: list[int]):
        self.n, self.v = int(counts[0]), int(counts[1])
        self.d = discounts(counts[2:])
        left, below = left_over(np.array(float(self.n)), np.array(counts[2 : K + 2], float), self.d)
        self.left, self.below = float(left), float(below)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words seen ``c`` times; 0: the unknown word."""
        return np.where(c > 0, discounted(c, self.d), self.left) / self.below

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.n + ADD * (self.v + 1)))


# ---- chunks ----

def chunk_table(docs: DataFrame, id_col: str, text_col: str, folds: int = FOLDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Texts in chunks: ``chunk, tokens, n_words, starts`` (training texts)``, ids, texts`` (held out, tokens of each text, codes) and ``words``
    (the words in the order of their codes, how often each is in training texts)."""

    def rows(seq: int, ids: list, held: list, texts: list) -> tuple:
        ids, held, texts = (pa.concat_arrays(x) for x in (ids, held, texts))
        off, codes, words = word_tokens(texts, lower=True)
        many = np.bincount(codes, minlength=len(words))
        rank = np.empty(len(words), np.int64)
        order = np.argsort(-many, kind="stable")
        rank[order] = np.arange(1, len(words) + 1)  # code 0: the end mark
        codes = rank[codes]
        held = held.to_numpy(zero_copy_only=False).astype(np.int64)
        train = np.bincount(codes[np.repeat(held == 0, np.diff(off))], minlength=len(words) + 1)
        train[0] = (held == 0).sum()
        names = pa.concat_arrays([pa.array([END], words.type), words.take(pa.array(order))])
        chunk = TaskContext.get().partitionId() << 32 | seq
        return chunk, len(codes) + len(held), len(names), int(train[0]), pack_ids(ids), pack(held, np.diff(off), codes), pack_words(names), pack(train)

    names = ["chunk", "tokens", "n_words", "starts", "ids", "texts", "words", "train"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, held = 0, 0, [[], [], []]
        for b in batches:
            texts = texts_of(b.column(2))
            for lo, hi in byte_slices(texts, chunk_bytes // 4):
                for k, x in enumerate((b.column(0), b.column(1), texts)):
                    held[k].append(x[lo:hi])
                size += pc.sum(pc.binary_length(texts[lo:hi])).as_py()
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, rows(seq, *held)))])
                    seq, size, held = seq + 1, 0, [[], [], []]
                    release()
        if held[0]:
            yield pa.RecordBatch.from_pylist([dict(zip(names, rows(seq, *held)))])

    plain = docs.select(F.col(id_col), fold_bucket(id_col, folds) == 0, F.col(text_col).cast("string"))
    return plain.mapInArrow(run, "chunk bigint, tokens bigint, n_words bigint, starts bigint, ids binary, texts binary, words binary, train binary")


def _dealt(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition, in order; as many partitions as the session wants, or the parts need."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    return df.repartition(n, key).sortWithinPartitions(key, *order)


# ---- words ----

def word_answers(chunks: DataFrame, parts: int) -> DataFrame:
    """Answers ``chunk, part, block`` (codes, ids, counts) and, where ``chunk`` is null, ``sums`` over the part's words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, train in zip(*(c.to_pylist() for c in b.columns)):
                words, (train,) = unpack_words(words), unpack(train)
                part = (word_hashes(words) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                got = [(int(p), order[ends[p] : ends[p + 1]]) for p in np.flatnonzero(np.diff(ends))]
                yield pa.record_batch(
                    [pa.array([p for p, _ in got], pa.int64()), pa.array([chunk] * len(got), pa.int64()), pa.array([pack(at, train[at]) for _, at in got], pa.binary()), pa.array([pack_words(words.take(pa.array(at))) for _, at in got], pa.binary())],
                    ["part", "chunk", "block", "words"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _groups(batches):
            asked = [unpack(block) for _, block, _ in rows]
            coded = pa.concat_arrays([unpack_words(words) for _, _, words in rows]).dictionary_encode()
            at = coded.indices.to_numpy().astype(np.int64)
            c = np.bincount(at, np.concatenate([n for _, n in asked]), len(coded.dictionary)).astype(np.int64)
            rank = np.empty(len(c), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
            ids = rank * parts + part + 1  # frequent words have small ids
            out, lo = [], 0
            for (chunk, _, _), (codes, _) in zip(rows, asked):
                own = at[lo : lo + len(codes)]
                lo += len(codes)
                out.append({"chunk": chunk, "part": part, "block": pack(codes, ids[own], c[own])})
            out.append({"part": part, "sums": [int(c.sum()), int((c > 0).sum()), *np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist()]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("block", pa.binary()), ("sums", pa.list_(pa.int64()))]))

    asked = chunks.select("chunk", "words", "train").mapInArrow(ask, "part bigint, chunk bigint, block binary, words binary")
    return _dealt(asked, parts, "part", "chunk").mapInArrow(answer, "chunk bigint, part bigint, block binary, sums array<bigint>")


# ---- pairs ----

class _Chunk:
    """A chunk's texts with the ids and counts of its words, and its distinct pairs in the order that they are asked."""

    def __init__(self, texts: bytes, answers: list[bytes], starts: int, parts: int, most: int):
        self.held, self.lens, codes = unpack(texts)
        words = [unpack(a) for a in answers]
        size = sum(len(w[0]) for w in words)
        self.ids, self.c = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for at, ids, c in words:
            self.ids[at], self.c[at] = ids, c
        n = len(codes) + len(self.lens)
        last = np.cumsum(self.lens + 1) - 1
        self.tokens = np.zeros(n, np.int64)  # the end mark's code is 0
        inner = np.ones(n, bool)
        inner[last] = False
        self.tokens[inner] = codes
        before = np.empty(n, np.int64)
        before[1:] = self.tokens[:-1]
        before[last - self.lens] = 0  # the end mark is no context: 0 is the start
        self.first = last - self.lens
        keys, self.pair = np.unique(before * size + self.tokens, return_inverse=True)
        h, w = keys // size, keys % size
        ids, count = self.ids.copy(), self.c.copy()
        ids[0], count[0] = START, starts
        split = 1 + count // most
        dealt = mix64(ids[h].astype(np.uint64)) + (self.ids[w] % split[h]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (mix64(dealt) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.order, self.part = order, part[order]
        self.h, self.w, self.split = ids[h][order], w[order], split[h][order] > 1
        self.known = self.c[w][order]

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(part, block) of each part: contexts, whether split, pairs of each; words, their counts, training counts of the pairs."""
        train = np.repeat(self.held == 0, self.lens + 1)
        n = np.bincount(self.pair, train, len(self.order)).astype(np.int64)[self.order]
        for lo, hi in self.ranges():
            run = self.runs(lo, hi)
            yield int(self.part[lo]), pack(self.h[run], self.split[run], np.diff(np.append(run, hi)), self.ids[self.w[lo:hi]], self.known[lo:hi], n[lo:hi])

    def ranges(self) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(self.part)) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.part)]))

    def runs(self, lo: int, hi: int) -> np.ndarray:
        """Where a context begins among the pairs of a part."""
        return lo + np.concatenate([[0], np.flatnonzero(np.diff(self.h[lo:hi])) + 1])

    def scores(self, pairs: dict[int, bytes], hot: dict[int, tuple], words: Unigrams, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        logs = np.empty(len(self.order))
        for lo, hi in self.ranges():
            run = self.runs(lo, hi)
            r, total, p, *seen = unpack(pairs[int(self.part[lo])])
            seen, p = np.array(seen).T.reshape(len(run), K), p.view(np.float64).copy()
            for k in np.flatnonzero(self.split[run]):
                total[k], p[k], seen[k] = hot[int(self.h[run[k]])]
            left, below = left_over(total.astype(float), seen.astype(float), d)
            unknown = float(words.p(np.zeros(1, np.int64))[0])
            alpha = np.where(total > 0, left / below / np.maximum(1 - p, unknown), 1.0)
            at = np.repeat(np.arange(len(run)), np.diff(np.append(run, hi)))
            logs[lo:hi] = np.log10(np.where(r > 0, discounted(r, d) / below[at], alpha[at] * words.p(self.known[lo:hi])))
        each = np.empty(len(logs))
        each[self.order] = logs
        c = self.c[self.tokens]
        return self.lens + 1, *(np.add.reduceat(x, self.first) if len(x) else x for x in ((c > 0).astype(np.int64), words.base(c), each[self.pair]))


def pair_answers(chunks: DataFrame, answers: DataFrame, words: Unigrams, starts: int, parts: int, tasks: int, split: int = SPLIT) -> DataFrame:
    """By ``kind``: 0 answers ``chunk, part, block`` (counts of the pairs; of each context total, probability of what
    followed it, how much was seen 1, ..., K times); 1 a split context's sums in a part; 2 a chunk that needs them;
    3 sums over the part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in _groups(batches):
            texts = next(block for kind, _, block in rows if kind == 0)
            got = list(_Chunk(texts, [block for kind, _, block in rows if kind == 1], starts, parts, split).questions())
            yield pa.record_batch([pa.array([p for p, _ in got], pa.int64()), pa.array([chunk] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], ["part", "chunk", "block"])

    names = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int64()), ("block", pa.binary()), ("h", pa.int64()), ("p", pa.float64()), ("sums", pa.list_(pa.int64()))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _groups(batches):
            asked = [unpack(block) for _, block in rows]
            h = np.concatenate([np.repeat(x[0], x[2]) for x in asked])
            w, known, n = (np.concatenate([x[k] for x in asked]) for k in (3, 4, 5))
            order = np.lexsort((w, h))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
            group = np.cumsum(new) - 1
            r = np.bincount(group, n[order]).astype(np.int64)
            first = order[new]
            own, context = np.unique(h[first], return_inverse=True)
            total = np.bincount(context, r, len(own)).astype(np.int64)
            p = np.bincount(context, np.where(r > 0, words.p(known[first]), 0.0), len(own))
            seen = np.stack([np.bincount(context, r == k, len(own)).astype(np.int64) for k in range(1, K + 2)])
            back = np.empty(len(h), np.int64)
            back[order] = r[group]
            out, lo, over = [], 0, set()
            for (chunk, _), x in zip(rows, asked):
                at = np.searchsorted(own, x[0])
                hi = lo + int(x[2].sum())
                out.append({"kind": 0, "chunk": chunk, "part": part, "block": pack(back[lo:hi], total[at], p[at].view(np.int64), *seen[:K, at])})
                lo = hi
                hot = x[0][x[1] > 0].tolist()
                over.update(hot)
                out += [{"kind": 2, "chunk": chunk, "h": c} for c in hot]
            for c in over:
                k = int(np.searchsorted(own, c))
                out.append({"kind": 1, "h": c, "p": float(p[k]), "sums": [int(total[k]), *seen[:K, k].tolist()]})
            out.append({"kind": 3, "part": part, "sums": seen.sum(axis=1).tolist()})
            yield pa.RecordBatch.from_pylist(out, names)

    told = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("part"), F.col("texts").alias("block"))
    told = told.unionByName(answers.filter("chunk is not null").select("chunk", F.lit(1).alias("kind"), "part", "block"))
    asked = _dealt(told, tasks, "chunk", "kind", "part").mapInArrow(ask, "part bigint, chunk bigint, block binary")
    return _dealt(asked, parts, "part", "chunk").mapInArrow(answer, "kind int, chunk bigint, part bigint, block binary, h bigint, p double, sums array<bigint>")


# ---- scores ----

def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
    chunk_bytes: int = CHUNK_BYTES, words_a_part: int = WORDS_A_PART, tokens_a_part: int = TOKENS_A_PART, split: int = SPLIT,
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows whose fold is 0 don't train."""
    chunks = cut(chunk_table(docs, id_col, text_col, folds, chunk_bytes), "chunks")
    size = chunks.agg(F.sum("tokens"), F.sum("n_words"), F.sum("starts"), F.count(F.lit(1))).first()
    tokens, n_words, starts, n_chunks = (int(x or 0) for x in size)
    answers = cut(word_answers(chunks, 1 + n_words // words_a_part), "word-answers")
    sums = answers.filter("chunk is null").agg(*(F.sum(F.col("sums")[k]) for k in range(K + 3))).first()
    words = Unigrams([int(x or 0) for x in sums])
    parts, tasks = 1 + tokens // tokens_a_part, 1 + n_chunks // 4
    pairs = cut(pair_answers(chunks, answers, words, starts, parts, tasks, split), "pair-answers")
    sums = pairs.filter("kind = 3").agg(*(F.sum(F.col("sums")[k]) for k in range(K + 1))).first()
    d = discounts([int(x or 0) for x in sums])

    none = lambda kind: F.lit(None).cast(kind)
    columns = {"kind": "int", "part": "bigint", "block": "binary", "ids": "binary", "h": "bigint", "p": "double", "sums": "array<bigint>"}

    def row(df: DataFrame, **given) -> DataFrame:
        return df.select("chunk", *(given.get(c, none(kind)).alias(c) for c, kind in columns.items()))

    sums_of = pairs.filter("kind = 1").groupBy("h").agg(F.sum("p").alias("p"), F.array(*(F.sum(F.col("sums")[k]) for k in range(K + 1))).alias("sums"))
    told = row(chunks, kind=F.lit(0), block=F.col("texts"), ids=F.col("ids"))
    told = told.unionByName(row(answers.filter("chunk is not null"), kind=F.lit(1), part=F.col("part"), block=F.col("block")))
    told = told.unionByName(row(pairs.filter("kind = 0"), kind=F.lit(2), part=F.col("part"), block=F.col("block")))
    told = told.unionByName(row(pairs.filter("kind = 2").select("chunk", "h").distinct().join(sums_of, "h"), kind=F.lit(3), h=F.col("h"), p=F.col("p"), sums=F.col("sums")))
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            texts, ids = next((block, ids) for kind, _, block, ids, *_ in rows if kind == 0)
            chunk = _Chunk(texts, [x[2] for x in rows if x[0] == 1], starts, parts, split)
            hot = {x[4]: (x[6][0], x[5], np.array(x[6][1:])) for x in rows if x[0] == 3}
            n, known, base, full = chunk.scores({x[1]: x[2] for x in rows if x[0] == 2}, hot, words, d)
            ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
            cols = [ids, pa.array(chunk.held == 1), pa.array(n), pa.array(known), pa.array(np.full(len(n), words.n)), pa.array(base), pa.array(full)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = _dealt(told, tasks, "chunk", "kind", "part").mapInArrow(run, f"id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
