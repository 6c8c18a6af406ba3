"""Token counts of whole texts under a ``tokenizers`` vocabulary.

Texts are cut at ASCII white space, which the vocabulary's normaliser and splitter
drop, so that no token crosses a cut: the count of a text is the sum over its words,
and a text of any length becomes many short pieces.  Each Arrow batch is worked in
slices of about ``slice_bytes``; every distinct word of a slice is encoded once, in
batches of about ``batch_bytes``, and only lengths leave the encoder.  That the
vocabulary drops white space is checked when it is loaded.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; a text without white space is one piece; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, texts_of, word_tokens

VOCABULARY = "word_bpe_49k.json"
SLICE_BYTES = 8 << 20
BATCH_BYTES = 256 << 10
LIMIT = 2048


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@lru_cache(maxsize=2)
def load(name_or_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(name_or_path))
    probe = ["a", "b.", "c"]
    whole = [len(e) for e in tok.encode_batch_fast(["a b.\n\tc", "a\x0b\x0cb.\r c "], add_special_tokens=False)]
    if any(n != sum(len(tok.encode(p, add_special_tokens=False)) for p in probe) for n in whole):
        raise ValueError(f"{name_or_path}: white space makes tokens, so texts can't be cut at it")
    return tok


def word_lengths(tok, words: pa.Array, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Token count of each distinct word, encoded in batches balanced by bytes."""
    out = np.zeros(len(words), np.int64)
    for lo, hi in byte_slices(words, batch_bytes):
        out[lo:hi] = [len(e) for e in tok.encode_batch_fast(words[lo:hi].to_pylist(), add_special_tokens=False)]
    return out


def count_batch(texts: pa.Array, vocabulary: str, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    tok, out = load(vocabulary), np.zeros(len(texts), np.int64)
    for lo, hi in byte_slices(texts, slice_bytes):
        off, codes, words = word_tokens(texts[lo:hi])
        sums = np.concatenate([[0], np.cumsum(word_lengths(tok, words)[codes])]) if len(words) else np.zeros(1, np.int64)
        out[lo:hi] = sums[off[1:]] - sums[off[:-1]]
    return out


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(count_batch(texts, vocabulary))],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
