"""Helpers shared by the operators of this subpackage: tables, lineage cuts, word tokens.

A *word* is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``, the six ASCII
white-space characters.  Word tokens are handled as ``(doc offsets, word codes,
distinct words)`` per Arrow batch, so that per-word work runs once per distinct word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.session import ensure_checkpoint_dir, materialize

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def release() -> None:
    """Give back memory that a Python worker has freed: it stays up between stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (see session.materialize)."""
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(df, name)


def named(column: str) -> str:
    """A column's name as Spark reads it whatever signs are in it."""
    return "`" + column.replace("`", "``") + "`"


def as_row(df: DataFrame, *helpers, keep: str = "row") -> DataFrame:
    """The input's columns in one struct, beside helper columns: no name can clash."""
    return df.select(F.struct(*(F.col(named(c)) for c in df.columns)).alias(keep), *helpers)


def from_row(df: DataFrame, columns: list[str], *more, keep: str = "row") -> DataFrame:
    return df.select(*(F.col(keep)[c].alias(c) for c in columns), *more)


BITS_A_KEY = 16
MOST_BITS = 1 << 29  # 64 MB
_BITMAP = 32_768


def split_by_keys(rows: DataFrame, key, keys: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame | None, DataFrame]:
    """(rows whose ``key`` is surely not in ``keys``, a written table of one column; rows whose key may be there).

    The keys' hashes are set in bitmaps of ``BITS_A_KEY`` bits a key, which are broadcast, so the first rows need no
    shuffle.  Beyond ``most_bits`` the first part is None, and the second all rows."""
    n = keys.count()
    if n * BITS_A_KEY > most_bits:
        return None, rows
    pages = 1 + n * BITS_A_KEY // _BITMAP
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(pages * _BITMAP)) + 1
    at = place(F.col(named(keys.columns[0])))
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("__page"), "left")  # at most most_bits
    met = met.withColumn("__hit", hit).drop("__page", "__bits")
    return met.filter("NOT __hit").drop("__hit"), met.filter("__hit").drop("__hit")


def fold_bucket(col, mod: int):
    """``crc32(text of the id) mod n``: which labelled rows are held out of training."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with null read as empty, as large_string so that no batch is too big."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text gets a range of its own."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi


def word_tokens(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words): the words of text i are ``words[codes[offsets[i]:offsets[i+1]]]``."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():  # the splitter leaves empty strings at the ends
        keep = np.concatenate([[0], np.cumsum(real)])
        off = keep[off]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return off, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], ..., starts[i]+lens[i]-1`` of all i, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def char_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    text = "".join(words.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return codes, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer hash (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word's UTF-8 bytes."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
