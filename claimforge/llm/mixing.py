"""Mixing sources to target weights (DataFrame functions only).

*Targets.*  The sources, by code point with null last, weigh ``WEIGHTS`` in turn and share
``share`` times all words.  A target stops at ``most`` times its source's words; what it
leaves is shared again by weight, which ends at ``min(most * words, level * weight)`` with
one common level, found on the table of sources.

*Draws.*  A source gives ``floor(target / words)`` whole passes over its documents and a
part of one more: its documents in the order of a seeded hash (a permutation) up to the
point nearest to the target.  Documents over ``target / LONG`` words are drawn first, by
the same order among themselves, and the others make up the difference, so that a long
document at the cut cannot push a source far off.  A draw is a threshold on ``(hash, id)``
per source, so a text is never moved to decide about it.

*Shards.*  The hash also deals every source's documents into ``BLOCKS`` blocks.  The drawn
block instances are split among the output shards by a tree: a node halves its shards and
takes, source by source, a hypergeometric number of its blocks to the left (inversion of
the exact law with a seeded uniform), so quotas are whole and add up at every node.  A
shard then gets the next blocks of each source's permuted list, disjoint from all others,
and its rows are sorted by a second hash: a local shuffle.

Every number depends on the rows alone: reruns, lost executors and other partitionings
give the same mix.  Tables by source, block or shard are bounded by sources x BLOCKS.

Defined results: null text has 0 words; null is a source of its own; documents without
words are drawn like others; rows that tie in hash and id are drawn together; a table without words or rows
gives target 0 and draws nothing; the input's other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimforge.llm.common import WORDS, as_row, cut, from_row, named
from claimforge.session import passing_tables

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 7
BLOCKS = 1024
LONG = 128
SHARDS = 16
WORDS_A_PIECE = 4_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    """The rows, each in a struct ``row``, with ``__id, __source, __size, __hash, __block``."""
    words = F.regexp_count(F.coalesce(F.col(named(text_col)), F.lit("")), F.lit(WORDS)).cast("long")
    place = F.xxhash64(F.col(named(id_col)), F.col(named(text_col)), F.lit(seed))
    return as_row(
        docs,
        F.col(named(id_col)).alias("__id"),
        F.col(named(source_col)).alias("__source"),
        words.alias("__size"),
        place.alias("__hash"),
        F.pmod(F.shiftrightunsigned(place, 32), F.lit(BLOCKS)).cast("int").alias("__block"),
    )


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """One row per source: ``source, words, target``."""
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("words"))
    whole = Window.partitionBy(F.lit(0))  # the table of sources
    turn = F.row_number().over(whole.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    table = by_source.withColumn("weight", weight).withColumn("most", F.col("words") * F.lit(float(most)))
    # sources in the order in which a rising level reaches their limit
    order = whole.orderBy(F.col("most") / F.col("weight"), F.col("__source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("words").over(whole) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    table = table.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.first("level", ignorenulls=True).over(every)  # null: every source is at its limit
    return table.select(
        F.col("__source").alias("source"),
        "words",
        F.least("most", F.coalesce(free * F.col("weight"), F.col("most"))).alias("target"),
    )


def draws(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """``targets`` with whole passes and the thresholds of the part pass, for long and other documents."""
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    table = table.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    table = cut(table, "mix-targets")
    rows = with_source(sizes, table).withColumn("long", is_long())
    # long documents: at most LONG * words / target of them in a source
    own = Window.partitionBy("__source").orderBy("__hash", "__id", "__size")
    goal = F.col("rest") / F.col("words") * F.sum("__size").over(Window.partitionBy("__source"))
    middle = F.sum("__size").over(own) - F.col("__size") / 2
    taken = rows.filter("long").select("*", (middle <= goal).alias("take")).filter("take AND rest > 0")
    long_cut = taken.groupBy("__source").agg(
        F.sum("__size").alias("long_words"), F.max(F.struct("__hash", "__id")).alias("long_cut")
    )
    table = cut(
        table.join(long_cut, table["source"].eqNullSafe(long_cut["__source"]), "left")
        .drop("__source")
        .withColumn("rest", F.col("rest") - F.coalesce("long_words", F.lit(0))),
        "mix-long",
    )
    # other documents: words by block, then the order within blocks
    rows = with_source(sizes, table).withColumn("long", is_long()).filter("NOT long AND rest > 0")
    blocks = rows.groupBy("__source", "__block").agg(F.sum("__size").alias("block_words"))
    up_to = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("before", F.coalesce(F.sum("block_words").over(up_to), F.lit(0))), "mix-blocks")
    blocks = blocks.select(F.col("__source").alias("b_source"), F.col("__block").alias("b_block"), "before")
    inside = Window.partitionBy("__source", "__block").orderBy("__hash", "__id", "__size")
    middle = F.col("before") + F.sum("__size").over(inside) - F.col("__size") / 2
    short_cut = (
        rows.join(blocks, F.col("__source").eqNullSafe(F.col("b_source")) & (F.col("__block") == F.col("b_block")))
        .select("*", (middle <= F.col("rest")).alias("take"))
        .filter("take")
        .groupBy("__source")
        .agg(F.max(F.struct("__block", "__hash", "__id")).alias("short_cut"))
    )
    return cut(
        table.join(short_cut, table["source"].eqNullSafe(short_cut["__source"]), "left").select(
            "source", "words", "target", "passes", "long_cut", "short_cut"
        ),
        "mix-draws",
    )


def is_long():
    return F.col("__size") * F.lit(LONG) > F.col("target")


def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join of rows with the table of sources, null being a source."""
    return rows.join(table, rows["__source"].eqNullSafe(table["source"])).drop("source")


def with_copies(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """The keyed rows with ``words, target, copies``."""
    long_part = F.struct("__hash", "__id") <= F.col("long_cut")
    short_part = F.struct("__block", "__hash", "__id") <= F.col("short_cut")
    part = F.coalesce(F.when(is_long(), long_part).otherwise(short_part), F.lit(False)).cast("int")
    out = with_source(rows, drawn)
    return out.withColumn("copies", F.col("passes") + part).drop("passes", "long_cut", "short_cut")


def _ln_factorial(x: str) -> str:
    stirling = f"{x} * ln({x}) - {x} + 0.5D * ln(2 * pi() * {x}) + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x})"
    return f"(CASE WHEN {x} <= 20 THEN ln(factorial(CAST({x} AS INT))) ELSE {stirling} END)"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(f'({n})')} - {_ln_factorial(f'({k})')} - {_ln_factorial(f'(({n}) - ({k}))')})"


def _hypergeometric(total: str, own: str, left: str, uniform: str) -> str:
    """Blocks of one source among ``left`` drawn of ``total``, ``own`` being its: inversion over the law's
    range, but for tails beyond 40 deviations."""
    mode = f"floor(({left} + 1D) * ({own} + 1D) / ({total} + 2D))"
    width = f"CAST(40 * sqrt(least({own}, {left}) + 1D) AS BIGINT)"
    low = f"greatest(0L, {left} - ({total} - {own}), {mode} - {width})"
    high = f"least({own}, {left}, {mode} + {width})"
    law = f"exp({_ln_choose(own, 'k')} + {_ln_choose(f'{total} - {own}', f'{left} - k')} - {_ln_choose(total, left)})"
    return (
        f"aggregate(sequence({low}, {high}), named_struct('sum', 0D, 'pick', {high}), "
        f"(d, k) -> IF(d.sum >= {uniform}, d, named_struct('sum', d.sum + {law}, 'pick', k)), d -> d.pick)"
    )


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Split ``(source, quota)`` block counts among shards: ``(shard, source, quota)``."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("own")).selectExpr("0L AS lo", f"{shards}L AS hi", "own")
    uniform = f"(shiftrightunsigned(xxhash64(lo, hi, q.source, {seed}), 11) / 9007199254740992D)"
    pick = _hypergeometric("s.total", "q.quota", "s.left", uniform)
    fold = (
        "aggregate(own, named_struct('total', total, 'left', CAST(floor(total * (mid - lo) / (hi - lo)) AS BIGINT), 'out', CAST(array() AS ARRAY<BIGINT>)), "
        f"(s, q) -> transform(array({pick}), p -> named_struct('total', s.total - q.quota, 'left', s.left - p, 'out', concat(s.out, array(p))))[0], s -> s.out)"
    )
    levels = max(0, (shards - 1).bit_length())
    for _ in range(levels):
        nodes = nodes.selectExpr("*", "(lo + hi) DIV 2 AS mid", "aggregate(own, 0L, (a, q) -> a + q.quota) AS total")
        nodes = nodes.selectExpr("lo", "mid", "hi", "own", f"IF(hi - lo > 1, {fold}, array()) AS taken")
        left = "zip_with(own, taken, (q, t) -> named_struct('source', q.source, 'quota', t))"
        right = "zip_with(own, taken, (q, t) -> named_struct('source', q.source, 'quota', q.quota - t))"
        nodes = nodes.selectExpr(
            f"inline(IF(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'own', {left}), named_struct('lo', mid, 'hi', hi, 'own', {right})), "
            "array(named_struct('lo', lo, 'hi', hi, 'own', own))))"
        )
    return nodes.selectExpr("lo AS shard", "inline(own)")


def block_shards(copied: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``b_source, b_block, shards``: the shard of every drawn copy of every block."""
    drawn = copied.filter("copies > 0").groupBy("__source", "__block").agg(F.max("copies").alias("copies"))
    instances = drawn.select("__source", "__block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    instances = cut(instances, "mix-instances")
    place = Window.partitionBy("__source").orderBy(F.xxhash64("__block", "copy", F.lit(seed)), "__block", "copy")
    instances = instances.withColumn("place", F.row_number().over(place))
    quotas = instances.groupBy(F.col("__source").alias("source")).agg(F.count(F.lit(1)).alias("quota"))
    split = cut(shard_quotas(quotas, shards, seed), "mix-quotas")
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    ranges = split.select("shard", "source", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    hit = F.col("__source").eqNullSafe(F.col("source")) & (F.col("place") > F.col("lo")) & (F.col("place") <= F.col("hi"))
    dealt = instances.join(ranges, hit).groupBy("__source", "__block")
    listed = dealt.agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("s"))
    return cut(
        listed.select(F.col("__source").alias("b_source"), F.col("__block").alias("b_block"), F.col("s.shard").alias("shards")),
        "mix-shards",
    )


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", shards: int = SHARDS, seed: int = SEED):
    """(keyed sizes, draws by source, shards by block): all that a mix needs, none of it with texts."""
    sizes = keyed(docs, id_col, text_col, source_col, seed).select("__id", "__source", "__size", "__hash", "__block")
    sizes = cut(sizes, "mix-sizes")
    drawn = draws(sizes, targets(sizes))
    return sizes, drawn, block_shards(with_copies(sizes, drawn), shards, seed)


def with_shards(copied: DataFrame, dealt: DataFrame) -> DataFrame:
    """Keyed rows with ``shards``, the shard of each of their copies."""
    met = copied.join(dealt, copied["__source"].eqNullSafe(dealt["b_source"]) & (F.col("__block") == F.col("b_block")), "left")
    own = F.when(F.col("copies") > 0, F.slice("shards", 1, F.col("copies"))).otherwise(F.array().cast("array<bigint>"))
    return met.drop("b_source", "b_block").withColumn("shards", own)


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", shards: int = SHARDS) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, shards of its copies."""
    sizes, drawn, dealt = plan(docs, id_col, text_col, source_col, shards)
    return with_shards(with_copies(sizes, drawn), dealt).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("words").alias("source_size"),
        "target",
        (F.col("__size") * F.col("copies")).alias("taken"),
        "shards",
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed rows (a document once per copy) with ``mix_shard``.  Partitions are shards, or pieces of about
    ``WORDS_A_PIECE`` words of one shard where it has more, in the order of a second hash."""
    with passing_tables(docs.sparkSession) as keep:
        _, drawn, dealt = plan(docs, id_col, text_col, source_col, shards, seed)
        drawn, dealt = keep(drawn, "draws"), keep(dealt, "dealt")
    words = drawn.agg(F.sum("target")).first()[0] or 0
    pieces = 1 + int(words / (shards * WORDS_A_PIECE))
    rows = with_shards(with_copies(keyed(docs, id_col, text_col, source_col, seed), drawn), dealt)
    rows = rows.select("row", "__hash", F.posexplode("shards").alias("__copy", "mix_shard"))
    rows = rows.withColumn("__key", F.xxhash64("__hash", "__copy", F.lit(seed + 1)))
    piece = F.col("mix_shard") * pieces + F.pmod(F.shiftrightunsigned("__key", 20), F.lit(pieces))
    rows = rows.repartitionById(shards * pieces, piece.cast("int")).sortWithinPartitions("mix_shard", "__key")
    return from_row(rows, docs.columns, "mix_shard")
