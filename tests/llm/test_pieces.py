import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from claimforge.llm import pieces
from claimforge.llm.token_counts import vocabulary_path
from tests.llm.helpers import docs_frame


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces.MODEL))


def _ids(v, texts):
    ids, off = pieces.encode_slice(v, pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])], ids, off


HARD = [
    "", " ", "  ", "a", " a ", "a  b   c", "\n", "\n\n x", "tab\t tab", "▁", "a▁b", "▁▁ a", "<s> </s> <0x41> <unk>", "日本語 テスト 😀",
    "x\u0000y", "ÀÉ é", " " * 1000, "a" * 3000, "ab" * 700 + " " + "=" * 900, " " * 300 + "end", "​﻿", "the the the " * 50, "१२३ ١٢٣",
]


def test_encode_as_library(library):
    v = pieces.load(pieces.MODEL)
    got, ids, off = _ids(v, HARD)
    want = library.encode(HARD, add_bos=True, add_eos=True)
    for t, a, b in zip(HARD, got, want):
        assert a == b, repr(t[:40])
    assert pieces.decode_slice(v, ids, off) == library.decode(want)


def test_encode_random_as_library(library):
    rng = random.Random(3)
    v = pieces.load(pieces.MODEL)
    words = [v.text[i].replace(pieces.MARK, " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(words if rng.random() < 0.7 else list(" aeti.\n=é你\t")) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeio") for _ in range(rng.randrange(200, 900))) for _ in range(60)]
    got, ids, off = _ids(v, texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert got == want
    assert pieces.decode_slice(v, ids, off) == library.decode(want)


def test_heap_and_rounds_agree():
    rng = random.Random(4)
    v = pieces.load(pieces.MODEL)
    for _ in range(50):
        sym = np.array([v.char_id[ord(c)] for c in "".join(rng.choice("aeionst=▁") for _ in range(rng.randrange(2, 250)))], np.int64)
        flat, start, length = pieces.merge_rounds(v, sym, np.array([0, len(sym)]))
        assert flat[start[0] : start[0] + length[0]].tolist() == pieces.merge_heap(v, sym.tolist())


def test_decode_any_ids(library):
    rng = random.Random(9)
    v = pieces.load(pieces.MODEL)
    runs = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(12))] for _ in range(3000)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    got = pieces.decode_slice(v, np.array([i for r in runs for i in r], np.int64), off)
    bad = [(r, a, library.decode(r)) for r, a in zip(runs, got) if a != library.decode(r)]
    assert not bad, bad[:3]


def test_rows(spark, library):
    texts = [None, "", "one two", "one two", "long " * 40000, "x" * 30000]
    df = docs_frame(spark, texts).selectExpr("*", "lang AS ids", "lang AS decoded", "lang AS id")
    out = {r["doc_id"]: r for r in pieces.digests(pieces.encode_decode(df)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(df.limit(0)).count() == 0
