"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

*Candidates* of a text are its base spans (strict patterns of the four kinds, see ``base_spans``)
and spans of wider patterns that overlap no base span: addresses written with ``(at)`` and
``(dot)``, phone numbers without ``+``, card numbers with other separators, lengths or digits,
dotted and colon addresses out of the strict form.

*Labelers* say yes, no or nothing to a candidate: the strict pattern, a checksum or range
test, a gazetteer (top-level domains, card issuers, area codes, reserved networks), cue words
before the span, and the characters around it.

*Aggregation.*  Candidates of all texts are counted by kind, votes and features, a table whose
size is bounded by their codes.  From it, per kind, expectation-maximisation estimates the share of
personal data and each labeler's rates of yes and no given either class; the posteriors are the
soft labels on which one logistic regression over the features is trained.  A candidate is
kept if it is a base span or the classifier gives it 0.5 or more.

The texts are read once; positions count code points, ends are exclusive.  Defined results:
null and empty texts have no spans; a table without candidates needs no model.  All patterns
are linear in the text: none starts inside a run that it has already failed on.  Repeated rows are worked
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.common import byte_slices, cut, texts_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SLICE_BYTES = 8 << 20
PRIOR = 0.7  # of personal data among candidates, where EM starts

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[(\[](?:at|AT)[)\]] ?")
_DOMAIN_WORDS = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_OTHER_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

# Word lists of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk it nl eu ch at us ca".split())
CUES = {
    EMAIL: re.compile(r"mail|contact|write|reach|correo|courriel|kontakt", re.I),
    IP: re.compile(r"\bip\b|address|host|server|login|client|from", re.I),
    CARD: re.compile(r"card|visa|master|amex|pay|tarjeta|carte|karte", re.I),
    PHONE: re.compile(r"phone|call|tel|mobile|fax|dial|anruf|appel|llam", re.I),
}
COUNTER_CUES = re.compile(r"version|token|isbn|order|invoice|hash|serial|key|ref|\bno\.|\bid\b|[=#\"]\s*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: from each ``@`` back over its run, then the domain."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, strict matches that fail their test), as (start, kind, end), in that order."""
    good, bad = [(a, EMAIL, b) for a, b in _emails(text)], []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (good if all(map(_octet, m[0].split("."))) else bad).append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                ok = 14 <= len(d) <= 19 and luhn(d)
                if ok or 13 <= len(d) <= 19:
                    (good if ok else bad).append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 10 <= len(_digits(m[0])) <= 15 else bad).append((m.start(), PHONE, m.end()))
    return sorted(good), bad


def wider_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "at" in text or "AT" in text:
        low = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            low = m.end()
            d = _DOMAIN_WORDS.match(text, m.end()) if start < m.start() else None
            if d:
                out.append((start, EMAIL, d.end()))
    if _DIGIT.search(text):
        out += [(m.start(), PHONE, m.end()) for m in _LOCAL_PHONE.finditer(text)]
        out += [(m.start(), CARD, m.end()) for m in _OTHER_CARD.finditer(text)]
        if text.count(":") >= 7:
            out += [(m.start(), IP, m.end()) for m in _IP6.finditer(text)]
    return out


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[list[int], int]:
    """(vote of each labeler: 1 yes, 2 no, 0 nothing; feature bits) of one candidate."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = _digits(span)
    cue, counter = bool(CUES[kind].search(before)), bool(COUNTER_CUES.search(before))
    left, right = text[start - 1 : start], text[end : end + 1]
    apart = not (left.isalnum() or left in ('"', "=", "/", "_") and left) and not (right.isalnum() or right in ('"', "_", "/") and right)
    if kind == EMAIL:
        test = 1 if re.search(r"[A-Za-z]", span[:64]) else 2
        known = 1 if re.split(r"[.\])\s]+", span.lower())[-1] in TOP_DOMAINS else 0
    elif kind == IP:
        parts = span.split(".")
        test = 1 if len(parts) == 4 and all(map(_octet, parts)) or span.count(":") == 7 else 2
        known = 2 if span.startswith(("0.", "10.", "127.", "192.168.", "255.")) else 0
    elif kind == CARD:
        test = 1 if luhn(digits) else 2
        known = 1 if digits[:1] in "3456" and 15 <= len(digits) <= 16 else 2
    else:
        test = 1 if 10 <= len(digits) <= 15 else 2
        known = 1 if len(digits) == 10 and digits[0] >= "2" or len(digits) == 11 and digits[0] == "1" else 0
    said = [1 if strict else 2, test, known, 1 if cue and not counter else 2 if counter and not cue else 0, 1 if apart else 2]
    bits = [strict, test == 1, known == 1, known == 2, cue, counter, apart, len(digits) > 11, " " in span or "-" in span]
    return said, sum(1 << i for i, b in enumerate(bits) if b)


FEATURES = 9
LABELERS = 5


def candidates(text: str) -> list[dict]:
    base, failed = base_spans(text)
    wide, taken, at, free = [], sorted((a, b) for a, _, b in base), -1, 0
    for a, k, b in sorted(failed + wider_spans(text)):  # those that overlap nothing
        while at + 1 < len(taken) and taken[at + 1][0] < b:
            at += 1
            free = max(free, taken[at][1])
        if a >= free:
            wide.append((a, k, b))
            free = b
    out = []
    for strict, spans in ((True, base), (False, wide)):
        for a, k, b in spans:
            said, bits = votes(text, a, k, b, strict)
            code = 0
            for v in said:
                code = code * 3 + v
            out.append({"start": a, "kind": k, "end": b, "base": strict, "votes": code, "features": bits})
    return sorted(out, key=lambda c: (c["start"], c["kind"]))


def _em(votes_of: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of personal data for each row of votes (rows x labelers), n being the rows' counts."""
    share = PRIOR
    start = np.array([[0.3, 0.15, 0.55], [0.3, 0.6, 0.1]])  # class; nothing, yes, no
    rate = np.repeat(start.T[None], LABELERS, axis=0)  # labeler, vote, class
    post = np.full(len(n), share)
    for _ in range(rounds):
        log = np.log(np.array([1 - share, share]) + 1e-12) + sum(np.log(rate[j, votes_of[:, j]]) for j in range(LABELERS))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(LABELERS):
                seen = np.bincount(votes_of[:, j], weights=w, minlength=3) + start[c]  # as if seen once
                rate[j, :, c] = seen / seen.sum()
        share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
    return post


def _design(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    bits = (features[:, None] >> np.arange(FEATURES)) & 1
    return np.column_stack([bits, kind[:, None] == np.arange(4)]).astype(float)


def span_classifier(kind: np.ndarray, votes_code: np.ndarray, features: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression on EM's posteriors (Newton steps, ridge 1)."""
    said = np.column_stack([votes_code // 3**j % 3 for j in range(LABELERS - 1, -1, -1)])
    soft = np.zeros(len(n))
    for k in range(4):
        if (own := kind == k).any():
            soft[own] = _em(said[own], n[own])
    x, w = _design(kind, features), np.zeros(FEATURES + 4)
    n = n / max(1.0, n.max() / 1e6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (p - soft)) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans``: the kept spans of each row, ``(start, kind, end, base)`` by start, then kind."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                found = [candidates(t) for t in texts[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(found, pa.list_(span))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start:int,kind:int,end:int,base:boolean,votes:int,features:int>>"
    found = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "candidates")
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))
    table = counts.toPandas().sort_values(["kind", "votes", "features"])  # bounded by the codes
    keep = []
    if len(table):
        w = span_classifier(table.kind.to_numpy(), table.votes.to_numpy(), table.features.to_numpy(), table.n.to_numpy(float))
        yes = _design(table.kind.to_numpy(), table.features.to_numpy()) @ w >= 0
        keep = sorted(set((table.kind.to_numpy()[yes] * (1 << FEATURES) + table.features.to_numpy()[yes]).tolist()))
    kept = F.array(*[F.lit(int(k)) for k in keep]).cast("array<int>")
    code = lambda s: s["kind"] * F.lit(1 << FEATURES) + s["features"]
    spans = F.filter("spans", lambda s: s["base"] | F.array_contains(kept, code(s)))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans as a string."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(k):
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select(id_col, *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
