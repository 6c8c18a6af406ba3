import hashlib
import random

import numpy as np
import sentencepiece

import corpus_pipeline
from claimforge.llm import pieces, toxicity
from claimforge.llm.mixing import mix_report
from claimforge.llm.token_counts import vocabulary_path
from tests.llm.helpers import DOC_SCHEMA, write_tables
from tests.llm.test_near_dups import brute


def _tables(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    rows, labels = [], []
    for i in range(420):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2 + len(own) // 30):
                own[rng.randrange(len(own))] = rng.choice(["zorg", "grumf"]) + rng.choice(["", "ab"])
        rows.append((i, " ".join(own), "en", rng.choice(["a", "b", "b", None]), 0))
        labels.append((i, 1, int(bad)))
    clean = [r for r, lab in zip(rows, labels) if not lab[2]]
    rows += [(1000 + k, clean[k % 9][1].replace(" ", "  "), "en", "a", 0) for k in range(40)]  # exact copies
    rows += [(2000 + k, clean[20 + k % 5][1] + f" tail{k}", "en", "b", 0) for k in range(30)]  # near copies
    rows += [(3000, None, None, None, None), (3001, "", "en", "c", 0), (3001, "", "en", "c", 0)]
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_stages_and_rows(spark, tmp_path):
    docs, labels, truth = _tables(spark)
    sf = write_tables(spark, tmp_path / "sf", documents=docs, labels=labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    kept, outs = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        outs.append([tuple(r) for r in kept.collect()])
        out = stage(spark, kept, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
    final = sorted(map(tuple, kept.collect()))
    # toxicity: as the scores say, and nearly all labels
    net = toxicity.fit(docs, labels)
    good = {r["doc_id"] for r in toxicity.score(docs, net).collect() if not r["predicted"]}
    assert {r[0] for r in outs[1]} == good
    assert sum(truth[i] for i in good if i in truth) < 0.1 * sum(truth.values())
    assert sum(1 - truth[i] for i in good if i in truth) > 0.97 * sum(1 - t for t in truth.values())
    # exact copies: one row for each text, the smallest id
    norm = lambda t: " ".join((t or "").split(" ")) if not t else __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)
    least = {}
    for r in outs[1]:
        least[norm(r[1])] = min(least.get(norm(r[1]), 10**9), r[0])
    assert sorted(r[0] for r in outs[2]) == sorted(least.values())
    # near copies
    groups = brute([(r[0], r[1]) for r in outs[2]])
    assert sorted(r[0] for r in outs[3]) == sorted(i for i, (_, c) in groups.items() if i == c)
    # mixing: each document as often as the report says
    report = {r["doc_id"]: len(r["shards"]) for r in mix_report(spark.createDataFrame(outs[3], DOC_SCHEMA)).collect()}
    drawn = {}
    for r in outs[4]:
        drawn[r[0]] = drawn.get(r[0], 0) + 1
    assert drawn == {i: n for i, n in report.items() if n}
    # encoding
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces.MODEL))
    want = []
    for r in outs[4]:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert final == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == final


def test_empty_documents(spark, tmp_path):
    docs, labels, _ = _tables(spark)
    sf = write_tables(spark, tmp_path / "sf", documents=docs.limit(0), labels=labels)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_near_copies_from_four_fifths_on(spark):
    rows = []
    for k in range(12):  # 100 shingles each; of a pair's sets n are the same: 2n / 200, similarity n / (200 - n)
        for side, own in enumerate(("p", "q")):
            same = 90 if k < 6 else 88
            words = [f"w{k}_{j}" for j in range(same + 4)] + [f"{own}{k}_{j}" for j in range(100 - same)]
            rows.append((2 * k + side, " ".join(words), "en", "a", 0))
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOC_SCHEMA), "")
    # 90 / 110 = 0.818 is a copy, 88 / 112 = 0.786 is none
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(0, 12, 2), *range(12, 24)]
