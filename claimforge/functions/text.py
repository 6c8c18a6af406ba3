"""Column-level text helpers: JVM-side built-in expressions, but for the word shuffle, which runs on Arrow batches."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


# Word separators used by word counting and word shuffling (ASCII whitespace).
WS_PATTERN = "[ \\t\\n\\r\\f]+"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def fill_template(template, values) -> Column:
    """Replace ``${1}``, ``${2}``, ... in sequence.

    Replacement is chained: text inserted for ``${1}`` that itself contains
    ``${2}`` is replaced in the next step, as in a loop of ``str.replace``.
    Placeholders are built with ``F.lit`` (SQL text would hit variable
    substitution on ``${...}``).
    """
    out = F.lit(template) if isinstance(template, str) else template
    for i, v in enumerate(values, start=1):
        out = F.replace(out, F.lit("${%d}" % i), _col(v))
    return out


def words(text) -> Column:
    """Whitespace-split words with empty pieces removed."""
    return F.filter(F.split(_col(text), WS_PATTERN), lambda w: w != F.lit(""))


WORD_PATTERN = "[^ \\t\\n\\r\\f]+"


def word_count(text) -> Column:
    """Default token counter for length filters: number of whitespace words."""
    return F.regexp_count(_col(text), F.lit(WORD_PATTERN))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True  # the bytes of WS_PATTERN
_SHUFFLE_BYTES = 2 << 20  # texts that are shuffled at once, so that a worker holds little beside its batch


def _row_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets): row k of the bytes has the words ``offsets[k]`` to ``offsets[k + 1]``."""
    space = np.append(_SPACE[data], True)
    row = np.zeros(len(data) + 1, bool)
    row[bounds] = True
    starts = np.flatnonzero(~space[:-1] & (np.append(True, space[:-2]) | row[:-1]))
    ends = np.flatnonzero(~space[:-1] & (space[1:] | row[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _shuffled(data: np.ndarray, bounds: np.ndarray, digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the rows' words in the order of their keys."""
    starts, ends, offsets = _row_words(data, bounds)
    counts = np.diff(offsets)
    base = np.repeat(offsets[:-1], counts)
    i = np.arange(len(starts)) - base
    a, b = (np.repeat(np.array([int(h[k : k + 8], 16) for h in digests], np.int64), counts) for k in (0, 8))
    left, right = (a + i * 2654435761) % 2147483647, (b + i * 40503) % 2147483629
    key = left * right % 2147483587 << 32 | i  # 31 bits of key, and the position
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        key[lo:hi].sort()
    pick = (key & 0xFFFFFFFF) + base
    sizes = (ends - starts)[pick] + 1  # with the space after the word
    last = offsets[1:][counts > 0] - 1
    sizes[last] -= 1
    stops = np.cumsum(sizes)
    out = np.append(data, np.uint8(32))[np.arange(sizes.sum()) + np.repeat(starts[pick] - (stops - sizes), sizes)]
    out[np.delete(stops, last) - 1] = 32
    return out, np.append(0, stops)[offsets]


def _shuffle_array(texts: pa.Array, keys: pa.Array, prefix: str) -> pa.Array:
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = plain.buffers()
    offsets = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    digests = [hashlib.md5((prefix if k is None else f"{prefix}:{k}").encode()).hexdigest() for k in keys.to_pylist()]
    parts, bounds, lo = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
    while lo < len(plain):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _SHUFFLE_BYTES, side="right")) - 1)
        out, rows = _shuffled(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], digests[lo:hi])
        parts.append(out)
        bounds.append(rows[1:] + bounds[-1][-1])
        lo = hi
    buffers = [pa.py_buffer(np.concatenate(x)) for x in (bounds, parts)]
    out = pa.Array.from_buffers(pa.large_string(), len(plain), [None, *buffers])
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.large_string()), out).cast(pa.string())


def shuffle_words(text, seed, salt: str, key) -> Column:
    """Seeded word shuffle: order words by a key mixed from md5(seed:salt:key) and their position, join by one space.

    One md5 per text; a word's key is a product of two position-dependent residues of it.  Runs on Arrow batches:
    lambda functions over arrays of words are interpreted word by word on the JVM.
    """
    prefix = f"{seed}:{salt}"

    @arrow_udf("string")
    def shuffled(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _shuffle_array(texts, keys, prefix)

    return shuffled(_col(text), _col(key).cast("string"))


def java_regex_quote(s: Column) -> Column:
    """``\\Q...\\E`` quoting of a column value for use inside a Java regex."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def java_replacement_quote(s: Column) -> Column:
    """Escape ``\\`` and ``$`` so a value is inserted literally by regexp_replace."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_word(sentence, word, replacement) -> Column:
    """Case-insensitive whole-word replacement with both sides quoted."""
    pattern = F.concat(F.lit("(?i)\\b"), java_regex_quote(_col(word)), F.lit("\\b"))
    return F.regexp_replace(_col(sentence), pattern, java_replacement_quote(_col(replacement)))


def parse_percent(c) -> Column:
    """'73.5%' -> 0.735; unparsable -> NULL."""
    stripped = F.regexp_replace(_col(c), "%+$", "")
    return stripped.try_cast("double") / F.lit(100.0)


def format_1f(c) -> Column:
    """Python ``'{:,.1f}'`` formatting (thousands separator, one decimal)."""
    return F.format_number(_col(c), 1)


def model_short_name(c) -> Column:
    """Second part of ``org/model``; NULL without a slash."""
    return F.get(F.split(_col(c), "/"), 1)


def token_count(c) -> Column:
    """Default token counter of the length filters: white-space words."""
    return word_count(c)


SPACES = (" ", "\t", "\n", "\r", "\f")


def _piece(text: str) -> tuple[int, bool, bool, bool]:
    """(words, begins with a word, ends with a word, empty) of a constant text."""
    edge = lambda c: c != "" and c not in SPACES
    return len(re.findall("[^ \t\n\r\f]+", text)), edge(text[:1]), edge(text[-1:]), text == ""


def _slot_piece(c: Column, shuffled: bool) -> tuple[Column, Column, Column, Column]:
    """The same of a column; a shuffled text has its words, one space apart."""
    n = word_count(c)
    if shuffled:
        return n, n > 0, n > 0, n == 0
    edge = lambda at: (F.length(c) > 0) & ~F.substring(c, at, 1).isin(*SPACES)
    return n, edge(1), edge(-1), F.length(c) == 0


def filled_word_count(template: str, values, shuffled: bool = False) -> Column:
    """Words of ``fill_template(template, values)``, without filling it in.

    The words of the template's pieces and of the values add up, less one for every place where two words touch.
    ``values`` are constants (str) or columns, which ``shuffled`` says will be shuffled by words first.  Not right for
    values that hold a placeholder themselves (``holds_placeholder``).
    """
    one = re.compile(r"\$\{(\d+)\}")
    parts, at = [], 0
    for m in one.finditer(template):
        if int(m.group(1)) <= len(values):
            v = values[int(m.group(1)) - 1]
            parts += [_piece(template[at : m.start()]), _piece(v) if isinstance(v, str) else _slot_piece(v, shuffled)]
            at = m.end()
    parts.append(_piece(template[at:]))
    total, ends = F.lit(0), F.lit(False)
    for n, first, last, empty in parts:
        n, first, last, empty = (x if isinstance(x, Column) else F.lit(x) for x in (n, first, last, empty))
        total = total + n - F.when(ends & first, 1).otherwise(0)
        ends = F.when(empty, ends).otherwise(last)
    return total


def holds_placeholder(columns) -> Column:
    """Whether any of the columns holds the beginning of a placeholder, which a later step of filling in would take."""
    return reduce(lambda a, b: a | b, [F.contains(_col(c), F.lit("${")) for c in columns])


SLOT_RE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def prompt_slots(template: str) -> list[str]:
    """Slot names of a ``{{ column }}`` prompt (driver-side, for plan-time constants)."""
    return SLOT_RE.findall(template)


def render_prompt(template: str, columns: dict | None = None) -> Column:
    """Fill every ``{{ name }}`` slot of a literal prompt with the column of that name.

    A template with expressions the slot pattern does not cover (``{{ [a, b]|join }}``)
    is rejected instead of rendering undefined values.
    """
    if re.search(r"\{\{(?!\s*\w+\s*\}\})", template):
        raise ValueError(f"prompt has a non-variable expression: {template!r}")
    columns = columns or {}
    out = F.lit(template)
    for m in SLOT_RE.finditer(template):
        name = m.group(1)
        out = F.replace(out, F.lit(m.group(0)), _col(columns.get(name, name)).cast("string"))
    return out
