"""Audit of how the sources of a language differ in their terms (exact integer arithmetic).

A *term* is a run of ASCII letters and characters beyond ASCII, A-Z lowered.  A language keeps
the terms that are in at least ``min_docs`` of its documents.  Every (language, source) group
and every language gives a kept term that it has ``n`` times the probability
``p = 1 + floor(10^9 (n + 5) / (N + 5 V))``; ``f`` is the difference of two such numbers.

* Counting: each task counts the terms of its documents by language and source and hands on sums;
  one shuffle by (language, term) gives counts and document frequencies.
* Part ``term``, by count cells: terms of a group that agree in (group count, language count)
  have the same ``f``.  ``f`` is worked out once a cell, cells of equal value are merged, values
  are ranked by the multiplicities before them, and only cells that begin among the first
  ``top`` ranks are expanded to terms, in UTF-8 order.
* Part ``pair``: the sum over all kept terms of the difference of two groups.  A language's terms
  are dealt to ``SALTS`` parts and its sources to blocks of ``BLOCK``; a task lays the terms of a
  part out as rows of a matrix, some at a time, and sums the differences of its columns.  Terms
  that no source of two blocks has differ as counts of zero do, so they are only counted.

Defined results: null text, lang and source are read as ''; repeated rows are documents of their
own; equal values rank in UTF-8 order of the item; a language with one source has no ``pair``
rows, one without kept terms has the value 0 for each pair; an empty table gives an empty result;
other columns are not read.  A source's share of the table does not matter: counts are summed in
the tasks, and pairs are dealt by term.  The result holds a row for each two sources of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimforge.llm.common import byte_slices, cut, texts_of, word_tokens

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
PRIOR = 5
SLICE_BYTES = 4 << 20
MOST_ROWS = 1 << 19  # sums that a task holds before it hands them on
SALTS = 64
BLOCK = 256
MATRIX_TERMS = 512

_LETTERS = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _LETTERS[_a : _b + 1] = np.arange(_a, _b + 1)


def only_terms(texts: pa.Array) -> pa.Array:
    """Texts with every character that is in no term made a space (all of them are single bytes)."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_LETTERS[raw]))


def slice_sums(group: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of some documents, ``group`` being a number per document."""
    off, codes, words = word_tokens(only_terms(texts), lower=True)
    width = max(len(words), 1)
    in_doc, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(off)) * width + codes, return_counts=True)
    key = group[in_doc // width] * width + in_doc % width
    keys, at = np.unique(key, return_inverse=True)
    return keys // width, words.take(pa.array(keys % width)), np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))


def term_counts(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``lang, source, term, n, docs`` as sums by task (columns lang, source, text of ``docs`` are never null)."""
    keys = ["lang", "source", "term"]

    def merged(held: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            texts = texts_of(b.column(2))
            lang, source = (b.column(i).dictionary_encode() for i in (0, 1))
            width = max(len(source.dictionary), 1)
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + source.indices.to_numpy(zero_copy_only=False)
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                g, terms, n, in_docs = slice_sums(group[lo:hi], texts[lo:hi])
                cols = [lang.dictionary.take(pa.array(g // width)), source.dictionary.take(pa.array(g % width)), terms.cast(pa.string()), pa.array(n), pa.array(in_docs)]
                held.append(pa.table(cols, [*keys, "n", "docs"]))
                if sum(map(len, held)) > most:
                    held = [merged(held)]
                    if len(held[0]) > most // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from merged(held).to_batches(1 << 16)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(n: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept))`` in exact integers; 0 if nothing is kept."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0))"
    below = f"(cast({total} as decimal(20,0)) + {PRIOR} * cast({kept} as decimal(17,0)))"
    return F.expr(f"if({kept} > 0, 1 + ({above}) div nullif({below}, 0), 0)")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n`` of the kept terms that a source has."""
    by_term = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")  # in the partitions that the sums are in: no shuffle
    both = by_term.select("lang", "source", "term", "n", F.sum("n").over(own).alias("lang_n"), F.sum("docs").over(own).alias("lang_docs"))
    return both.filter(F.col("lang_docs") >= min_docs).drop("lang_docs")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, idx, sources, total, lang_total, V, p0``: a row for each group, ``idx`` its place among the
    language's sources, ``p0`` the probability of a term that it does not have."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("V"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    many = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "V"])
    return out.select("*", place.alias("idx"), many.alias("sources"), share("0", "total", "V").alias("p0"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Part ``term``: the first ``top`` kept terms of each group by how far its probability is above the language's."""
    keys, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    cells = kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("terms")).join(groups.select(*keys, "total", "lang_total", "V"), keys)
    cells = cells.select(*cell, "terms", (share("n", "total", "V") - share("lang_n", "lang_total", "V")).alias("value")).filter("value > 0")
    cells = cut(cells, "term-cells")
    by_value = Window.partitionBy(*keys).orderBy(F.desc("value"))
    values = cells.groupBy(*keys, "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)  # a value has a term at least
    before = F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
    values = values.select(*keys, "value", before.alias("before")).filter(F.col("before") < top)
    chosen = cells.join(values, [*keys, "value"])
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "term"))
    ranked = kept.join(chosen, cell).select(*keys, F.col("term").alias("item"), "value", within.alias("rank"))
    return ranked.filter(F.col("rank") <= top).select(*keys, F.lit("term").alias("part"), "item", "value", "rank")


class _Columns:
    """Sums of differences of one part's rows, for two blocks of sources."""

    def __init__(self, block: int, most: int):
        self.key, self.block, self.most = None, block, most

    def begin(self, key):
        self.key, self.base, self.seen, self.term, self.rows = key, {}, 0, None, []

    def ready(self):
        left, right = self.key[1] * self.block, self.key[2] * self.block
        at = lambda lo: np.array([self.base[i] for i in range(lo, lo + self.block) if i in self.base], np.int64)
        self.left, self.right, self.lo = at(left), at(right), (left, right)
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def add(self, term, idx, p):
        """Some rows, in the order of their terms."""
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        new[0] = term[0] != self.term
        row, self.term = np.cumsum(new) - 1 + self.seen, term[-1]  # a term begun before has the row before
        self.seen = int(row[-1]) + 1
        self.rows.append((row, idx, p))
        if self.seen - self.rows[0][0][0] > self.most:
            self.close(last=False)

    def close(self, last=True):
        if not self.rows:
            return
        row, idx, p = (np.concatenate(x) for x in zip(*self.rows))
        until = len(row) if last else int(np.searchsorted(row, row[-1]))  # the last term may go on
        self.rows = [] if last else [(row[until:], idx[until:], p[until:])]
        for lo in range(int(row[0]), int(row[until - 1]) + 1 if until else 0, self.most):
            a, b = np.searchsorted(row[:until], [lo, lo + self.most])
            n = int(row[b - 1]) - lo + 1
            mats = []
            for base, first in ((self.left, self.lo[0]), (self.right, self.lo[1])):
                m, c = np.tile(base, (n, 1)), idx[a:b] - first
                ok = (c >= 0) & (c < len(base))
                m[row[a:b][ok] - lo, c[ok]] = p[a:b][ok]
                mats.append(m)
            for k in range(len(self.left)):
                self.sums[k] += np.abs(mats[1] - mats[0][:, k : k + 1]).sum(axis=0)

    def out(self):
        a, b = np.indices(self.sums.shape).reshape(2, -1)
        a, b = a + self.lo[0], b + self.lo[1]
        ok = a < b
        n = int(ok.sum())
        cols = [pa.array([self.key[0]] * n, pa.string()), pa.array(a[ok]), pa.array(b[ok]), pa.array(self.sums.reshape(-1)[ok]), pa.array(np.full(n, self.seen))]
        return pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "sum", "seen"])


def _pair_sums(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, i, j, salt, kind, term, idx, p`` in this order; kind 0 names a block's sources, kind 1 has terms."""
    now = _Columns(block, most)
    ready = False
    for b in batches:
        lang = b.column(0).to_pylist()
        i, j, salt, kind, idx, p = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4, 6, 7))
        term = np.array(b.column(5).to_pylist(), object)
        keys = list(zip(lang, i.tolist(), j.tolist(), salt.tolist(), kind.tolist()))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if keys[lo][:4] != now.key:
                if now.key is not None:
                    if not ready:
                        now.ready()
                    now.close()
                    yield now.out()
                now.begin(keys[lo][:4])
                ready = False
            if keys[lo][4] == 0:
                now.base.update(zip(idx[lo:hi].tolist(), p[lo:hi].tolist()))
            else:
                if not ready:
                    now.ready()
                    ready = True
                now.add(term[lo:hi], idx[lo:hi].astype(np.int64), p[lo:hi].astype(np.int64))
            lo = hi
    if now.key is not None:
        if not ready:
            now.ready()
        now.close()
        yield now.out()


def pair_sums(kept: DataFrame, groups: DataFrame, size: int = BLOCK, salts: int = SALTS, most: int = MATRIX_TERMS) -> DataFrame:
    """Part ``pair``: every two sources of a language and the sum of their differences over all kept terms."""
    keys = ["lang", "source"]
    block = F.floor(F.col("idx") / size).cast("int")
    others = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / size).cast("int"))
    two = F.explode(F.transform(others, lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))).alias("two")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    names = groups.select("lang", "idx", F.col("p0").alias("p"), two).select("*", every)
    names = names.select("lang", "two.i", "two.j", "salt", F.lit(0).alias("kind"), F.lit("").alias("term"), "idx", "p")
    salt = F.pmod(F.hash("term"), F.lit(salts)).alias("salt")
    rows = kept.join(groups.select(*keys, "idx", "sources", "total", "V"), keys).select("lang", "term", salt, "idx", share("n", "total", "V").alias("p"), two)
    rows = rows.select("lang", "two.i", "two.j", "salt", F.lit(1).alias("kind"), "term", "idx", "p")
    dealt = names.unionByName(rows).repartition("lang", "i", "j", "salt").sortWithinPartitions("lang", "i", "j", "salt", "kind", "term")
    part = dealt.mapInArrow(lambda batches: _pair_sums(batches, size, most), "lang string, a bigint, b bigint, sum bigint, seen bigint")
    sums = part.groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"), F.sum("seen").alias("seen"))
    side = lambda x: groups.select("lang", F.col("idx").alias(x), F.col("source").alias(f"{x}_source"), F.col("p0").alias(f"{x}_p0"), *([F.col("V")] if x == "a" else []))
    both = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    value = F.col("sum") + (F.col("V") - F.col("seen")) * F.abs(F.col("a_p0") - F.col("b_p0"))
    ways = F.array(*(F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba")))
    flat = both.select("lang", value.alias("value"), F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    return flat.select(*keys, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: both parts."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = cut(kept_terms(plain, min_docs), "kept-terms")
    groups = cut(group_table(plain, kept), "groups")
    return top_terms(kept, groups, top).unionByName(pair_sums(kept, groups))
