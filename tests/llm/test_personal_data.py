import hashlib
import random
import re
import time

import numpy as np

from claimforge.llm import personal_data as pd_
from tests.llm.helpers import docs_frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                d = [int(c) for c in reversed(digits)]
                total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
                if not 14 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_patterns():
    rng = random.Random(6)
    parts = ["a.b", "@", "c.d", ".", "1", "255", "256", "4111 1111 1111 1111", "+1 (555) 555-0100", "-", " ", "é", "x", "00", "4222222222222", "@@", "(", "+", "a@b.c@d.e"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pd_.base_spans(t)[0] == brute(t), t


def test_long_texts_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 200_000, "+1" * 100_000, "1 " * 200_000, "a@" * 100_000, "1:" * 100_000, "(at)" * 50_000):
        began = time.time()
        pd_.candidates(t)
        assert time.time() - began < 5, t[:4]


def _line(rng):
    return rng.choice(["", "call +1 (555) 555-%04d now" % rng.randrange(10_000), "mail bob.%d@mail.example.com" % rng.randrange(99), "write to bob%d (at) example (dot) com" % rng.randrange(99),
                       "phone 555-010-%04d today" % rng.randrange(10_000), "ip 10.0.%d.7" % rng.randrange(400), 'token = "%016d"' % rng.randrange(10**16)])


def test_report(spark):
    rng = random.Random(2)
    texts = [None, "", "x"] + ["é " + " . ".join(_line(rng) for _ in range(rng.randrange(6))) for _ in range(400)]
    df = docs_frame(spark, texts).selectExpr("*", "lang AS spans", "lang AS id", "lang AS base")
    rows = {r["doc_id"]: r for r in pd_.report(pd_.find(df)).collect()}
    assert len(rows) == len(texts)
    added = 0
    for i, t in enumerate(texts):
        base = [f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in brute(t)]
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in base) for k in pd_.KINDS]
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if s in base] == base
        keys = [(int(s.split(":")[1]), pd_.KINDS.index(s.split(":")[0])) for s in every]
        assert keys == sorted(keys)
        for s in set(every) - set(base):
            kind, a, b = s.split(":")
            added += 1
            assert "example" in t[int(a) : int(b)] or kind in ("phone", "card", "ip")
    assert added > 20
    assert pd_.find(df.limit(0)).count() == 0 and pd_.find(df.filter("text = 'x'")).first()["spans"] == []


def test_em_finds_good_and_bad_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    yes = np.where(truth, 1, 2)
    good = lambda p: np.where(rng.random(4000) < p, yes, 3 - yes)
    said = np.column_stack([good(0.95), good(0.9), good(0.85), np.zeros(4000, int), rng.integers(0, 3, 4000)])
    post = pd_._em(said, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95


def test_long_local_parts_are_whole():
    for n in (3, 64, 65, 500):
        text = f"write to {'b' * n} (at) example (dot) com or {'c' * n}[at]mail.example.com"
        spans = [text[a:b] for a, k, b in pd_.wider_spans(text) if k == pd_.EMAIL]
        assert spans == [f"{'b' * n} (at) example (dot) com", f"{'c' * n}[at]mail.example.com"]
