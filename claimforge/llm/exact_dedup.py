"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. A digest per row: SHA-256 of the text with each white-space run made one space.
   The ``(id, digest)`` table is written once, so texts are read once.
2. Misra-Gries counters (``DataFrame.stat.freqItems``) name every digest that may
   fill more than ``support`` of the rows: at most ``1/support`` candidates.
3. An exact count and smallest id per candidate verifies them.  The winners, at most
   ``1/support`` rows by construction, are broadcast: their rows get the verdict on
   the map side and never meet in one task.
4. All other digests, each below ``support`` of the rows, take an ordinary shuffle.

Defined results: of equal texts the smallest id stays; a null text counts as empty; a null id never beats another id; rows
that repeat an id with the same text share one verdict, and ``drop_copies`` keeps one
of them; an empty table gives an empty result; the input's other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimforge.llm.common import SPACES, as_row, cut, from_row, named, split_by_keys
from claimforge.session import passing_tables

SUPPORT = 0.001


def text_digest(text: str = "text"):
    """SHA-256 (32 bytes) of the normalised text."""
    normal = F.regexp_replace(F.coalesce(F.col(named(text)), F.lit("")), SPACES, " ")
    return F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256))


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, keep_id, group_size)`` of the frequent digests, at most ``1/support`` rows."""
    found = digests.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    named = found.select(F.explode("digest_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    return (
        digests.join(F.broadcast(named), "digest", "left_semi")  # at most 1/support rows
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``id, digest, keep_id, group_size, kept``."""
    digests = cut(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")), "digests")
    heavy = cut(heavy_winners(digests, support), "heavy-digests")
    decided = digests.join(F.broadcast(heavy), "digest")  # at most 1/support rows
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest",
        "id",
        F.min("id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return decided.select(*rest.columns).unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The input rows that stay, one per distinct normalised text, with their own columns.

    Rows of heavy digests that lose go on the map side.  Of the others, rows whose digest is in no group of
    copies, as bitmaps of the groups' digests show, stay where they are; only the rest is shuffled."""
    spark = docs.sparkSession
    with passing_tables(spark) as keep:
        digests = cut(docs.select(F.col(named(id_col)).alias("id"), text_digest(text_col).alias("digest")), "digests")
        heavy = keep(heavy_winners(digests, support).select("digest", "keep_id"), "heavy-digests")
        light = digests.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        light = keep(light.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select("digest", "keep_id"), "light-groups")
    rows = as_row(docs, F.col(named(id_col)).alias("id"), text_digest(text_col).alias("digest"))
    won = heavy.select("digest", F.col("keep_id").alias("won"), F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(won), "digest", "left")  # at most 1/support rows
    rows = rows.filter(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("won")))
    alone, maybe = split_by_keys(rows.filter("heavy IS NULL").drop("won", "heavy"), F.col("digest"), light.select("digest"))
    groups = light.withColumn("copied", F.lit(True))
    stay = maybe.join(groups, "digest", "left").filter(F.col("copied").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    stay = stay.select("row", "id", "digest").unionByName(rows.filter("heavy").select("row", "id", "digest"))
    stay = stay.groupBy("id", "digest").agg(F.first("row").alias("row"))  # rows that repeat an id with the same text
    if alone is not None:
        stay = alone.select("row").unionByName(stay.select("row"))
    return from_row(stay, docs.columns)
