import random

import numpy as np
import pyarrow as pa
import pytest

from claimforge.llm.token_counts import VOCABULARY, count_batch, count_tokens, load
from tests.llm.helpers import docs_frame

TEXTS = [
    None, "", " ", "don't stop", "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "á ́b", "ΑΣ ΣΑΣ.", "İstanbul ǅ",
    "a b c\x85d", "\x1c\x1d a", "tab\tnew\nline\x0b\x0c\r", "你好 世界", "𝔘𝔫𝔦 😀😀", "1234 5.6", "!!! ... ***", "q" * 5000, "\u0000 nul",
]


def test_matches_the_library(spark):
    tok = load(VOCABULARY)
    df = docs_frame(spark, TEXTS)
    got = {r["doc_id"]: r for r in count_tokens(df).collect()}
    for i, t in enumerate(TEXTS):
        want = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((t or "").encode()), want > 2048), repr(t)


def test_slices_do_not_matter():
    rng = random.Random(5)
    alphabet = list("ab'st \t\n.é́<|endoftext|>7ΣI ") + ["<|endoftext|>", "'re", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    arr = pa.array(texts, pa.large_string())
    tok = load(VOCABULARY)
    want = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    for size in (1, 50, 10**7):
        assert np.array_equal(count_batch(arr, VOCABULARY, size), want)


def test_empty_table(spark):
    assert count_tokens(docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_vocabulary_must_drop_white_space():
    with pytest.raises(ValueError):
        load("byte_bpe_50k.json")
