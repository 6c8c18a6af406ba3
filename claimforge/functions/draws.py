"""Seeded, partition-independent pseudo-random draws.

A draw is a pure function of ``(seed, salt, key...)``: the first 32 bits of the
md5 of ``seed:salt:key...``.  It does not depend on partitioning, task order or
retries, so a lost executor recomputes exactly the same sample, and DuckDB can
reproduce every draw (``('0x' || substr(md5(...), 1, 8))::BIGINT``).

Rules: key draws by a row id, never by text; use a distinct salt per purpose.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Histogram resolution used by the exact top-k / dense-rank operators:
# the first four hex digits (16 bits) of the md5 order key.
BUCKET_HEX_DIGITS = 4
N_BUCKETS = 16 ** BUCKET_HEX_DIGITS


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.col(k)


def _sql_str(s: str) -> str:
    return "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash_sql(seed, salt: str, keys) -> str:
    ks = ", ".join(f"cast(`{k}` as string)" for k in keys)
    return f"md5(concat_ws(':', {_sql_str(seed)}, {_sql_str(salt)}, {ks}))"


def hash_key(seed, salt: str, *keys) -> Column:
    """md5 hex of ``seed:salt:key1:key2...`` (keys are columns or column names).

    With plain column names the expression is parsed on the JVM in one call (building it
    from many ``F.*`` calls costs a py4j round trip each).
    """
    if keys and all(isinstance(k, str) for k in keys):
        return F.expr(_hash_sql(seed, salt, keys))
    parts = [F.lit(str(seed)), F.lit(salt)] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hex_to_u32(hex_col: Column) -> Column:
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def draw(seed, salt: str, *keys) -> Column:
    """Uniform integer in [0, 2**32)."""
    if keys and all(isinstance(k, str) for k in keys):
        return F.expr(f"cast(conv(substring({_hash_sql(seed, salt, keys)}, 1, 8), 16, 10) as bigint)")
    return hex_to_u32(hash_key(seed, salt, *keys))


def draw_mod(seed, salt: str, k, *keys) -> Column:
    """Uniform integer in [0, k); ``k`` may be a column."""
    if not isinstance(k, Column) and keys and all(isinstance(x, str) for x in keys):
        return F.expr(f"pmod(cast(conv(substring({_hash_sql(seed, salt, keys)}, 1, 8), 16, 10) as bigint), {int(k)})")
    return F.pmod(draw(seed, salt, *keys), k if isinstance(k, Column) else F.lit(int(k)))


def draw_unit(seed, salt: str, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, salt, *keys) / F.lit(4294967296.0)


def bucket_of(hex_col: Column) -> Column:
    return F.conv(F.substring(hex_col, 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")


def py_hash_key(seed, salt: str, *keys) -> str:
    """Driver-side twin of :func:`hash_key` for plan-time constants."""
    return hashlib.md5(":".join([str(seed), salt] + [str(k) for k in keys]).encode()).hexdigest()


def py_draw(seed, salt: str, *keys) -> int:
    return int(py_hash_key(seed, salt, *keys)[:8], 16)
