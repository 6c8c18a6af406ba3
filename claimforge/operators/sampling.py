"""Exact-size, seeded sampling without global sorts or single-task windows.

Every sampling operator orders rows by ``(md5(seed:salt:key), tie...)``.  The
reference semantics is "the first ``q`` rows of each group in that order"
(``row_number() over (partition by g order by md5, tie) <= q``), which is
what the DuckDB oracle computes.  Spark computes the same rows in a way that
survives skewed groups at any size:

1. a histogram of the first 16 bits of the md5 per group
   (partial aggregation map-side; at most 65536 rows per group);
2. per group, the bucket where the running count crosses ``q``: one row per
   group, written to the scratch folder, so that Spark plans the join with the
   input from its true size and broadcasts it when it is small;
3. rows beyond the crossing bucket are dropped before any exchange; the kept
   rows are ranked by a window partitioned by (group, bucket), which decides
   about those of the crossing bucket.

No task ever holds more than one bucket of one group, so a group holding a
third of all rows is split 65536 ways.  The dense rank used by the bootstrap
is built the same way (running count before the bucket + rank inside it).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.draws import N_BUCKETS, bucket_of, draw, hash_key
from claimforge.session import materialize

_ALL = "_cf_all"


def _groups(df: DataFrame, group_cols) -> tuple[DataFrame, list[str]]:
    g = list(group_cols or [])
    if not g:
        df = df.withColumn(_ALL, F.lit(0))
        g = [_ALL]
    return df, g


def take_first(
    df: DataFrame,
    order_hex: Column,
    tie_cols,
    quota,
    group_cols=(),
) -> DataFrame:
    """Keep the first ``quota`` rows of each group in ``(order_hex, tie_cols)`` order.

    ``quota`` is an int (same for every group), a DataFrame ``(group_cols..., quota)`` (groups
    missing from it keep nothing), or a function from per-group row counts
    ``(group_cols..., n)`` to such a DataFrame; the counts then come from the bucket
    histogram, so quotas cost no extra pass over the data.
    """
    tie_cols = list(tie_cols)
    d, g = _groups(df, group_cols)
    d = d.withColumns({"_cf_h": order_hex, "_cf_b": bucket_of(order_hex)})
    hist = d.groupBy(*g, "_cf_b").agg(F.count(F.lit(1)).alias("_cf_n"))
    # one row per group: its sorted bucket histogram (<= 65536 entries) and its size
    per_g = hist.groupBy(*g).agg(
        F.sort_array(F.collect_list(F.struct("_cf_b", "_cf_n"))).alias("_cf_hist"), F.sum("_cf_n").alias("n")
    )
    if callable(quota) and not isinstance(quota, DataFrame):
        quota = quota(per_g.select(*g, "n"))
    if isinstance(quota, DataFrame):
        # groups without a quota row keep nothing
        per_g = per_g.join(quota.select(*g, F.col("quota").alias("_cf_q")), g, "left")
        per_g = per_g.withColumn("_cf_q", F.coalesce(F.col("_cf_q"), F.lit(0)).cast("long"))
    else:
        per_g = per_g.withColumn("_cf_q", F.lit(int(quota)).cast("long"))
    # first bucket whose running count passes the quota, and how many of its rows are still needed
    init = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("int").alias("cb"), F.lit(None).cast("long").alias("rem"))

    def step(acc, x):
        cum = acc["cum"] + x["_cf_n"]
        crossing = acc["cb"].isNull() & (cum > F.col("_cf_q"))
        return F.struct(
            cum.alias("cum"),
            F.when(crossing, x["_cf_b"]).otherwise(acc["cb"]).alias("cb"),
            F.when(crossing, F.col("_cf_q") - acc["cum"]).otherwise(acc["rem"]).alias("rem"),
        )

    found = F.aggregate(F.col("_cf_hist"), init, step)
    # one row per group; written first, so that the join below is planned from its true size: a small
    # table is broadcast and the input is cut before any exchange, a large one is sort-merged
    cut = materialize(per_g.select(*g, found["cb"].alias("_cf_cb"), found["rem"].alias("_cf_rem")), "cuts")
    cb = F.coalesce(F.col("_cf_cb"), F.lit(N_BUCKETS))  # no crossing: the whole group fits
    wr = Window.partitionBy(*g, "_cf_b").orderBy("_cf_h", *tie_cols)
    j = d.join(cut, g, "left").filter(F.col("_cf_b") <= cb)
    keep = F.when(F.col("_cf_b") < cb, F.lit(True)).otherwise(F.row_number().over(wr) <= F.col("_cf_rem"))
    out = j.withColumn("_cf_keep", keep).filter("_cf_keep").drop("_cf_h", "_cf_b", "_cf_cb", "_cf_rem", "_cf_keep")
    return out.drop(_ALL) if _ALL in out.columns else out


def dense_rank(df: DataFrame, order_hex: Column, tie_cols, group_cols=(), name: str = "rank") -> DataFrame:
    """0-based position of every row in ``(order_hex, tie_cols)`` order within its group."""
    tie_cols = list(tie_cols)
    d, g = _groups(df, group_cols)
    d = d.withColumns({"_cf_h": order_hex, "_cf_b": bucket_of(order_hex)})
    hist = d.groupBy(*g, "_cf_b").agg(F.count(F.lit(1)).alias("_cf_n"))
    w = Window.partitionBy(*g).orderBy("_cf_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*g, "_cf_b", F.coalesce(F.sum("_cf_n").over(w), F.lit(0)).alias("_cf_before"))
    wr = Window.partitionBy(*g, "_cf_b").orderBy("_cf_h", *tie_cols)
    out = (
        d.join(offsets, g + ["_cf_b"])
        .withColumn(name, F.col("_cf_before") + F.row_number().over(wr) - 1)
        .drop("_cf_h", "_cf_b", "_cf_before")
    )
    return out.drop(_ALL) if _ALL in out.columns else out


# ---------------------------------------------------------------------------------------------
# B1 / B2 / B3 / B9 / B14
# ---------------------------------------------------------------------------------------------


def sample_exact(df: DataFrame, n: int, seed, salt: str, id_col: str = "id") -> DataFrame:
    """Exactly ``min(n, N)`` rows without replacement (B1); ``sample_idx`` = the row id."""
    out = take_first(df, hash_key(seed, salt, id_col), [id_col], n)
    return out.withColumn("sample_idx", F.col(id_col).cast("bigint"))


def bootstrap_exact(df: DataFrame, n: int, n_rows: int, seed, salt: str, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` rows drawn with replacement (B2).

    Draw ``i`` (``sample_idx``) picks position ``draw(seed, salt:boot, i) mod N`` of the
    table in md5 order; the pick list is a distributed ``range(n)`` equi-joined to the
    dense rank, so nothing passes through the driver.
    """
    if n_rows <= 0:
        raise ValueError("cannot bootstrap from an empty table")
    spark = df.sparkSession
    ranked = dense_rank(df, hash_key(seed, salt + ":rank", id_col), [id_col], name="_cf_pos")
    picks = spark.range(n).select(
        F.col("id").alias("sample_idx"), F.pmod(draw(seed, salt + ":boot", "id"), F.lit(n_rows)).alias("_cf_pos")
    )
    return picks.join(ranked, "_cf_pos").drop("_cf_pos")


def resize_to_n(df: DataFrame, n: int, seed, salt: str, id_col: str = "id", n_rows: int | None = None,
                materialize: bool = False) -> DataFrame:
    """More than ``n`` rows -> exact subsample; ``n`` or fewer -> bootstrap to ``n``.

    ``n_rows`` (the table size) chooses the branch; it is counted when not given (callers
    resizing many tables count them all in one job).  ``materialize`` writes the ``n``-row
    result below the checkpoint folder, cutting the lineage back to the source scan.
    """
    if n_rows is None:
        n_rows = df.count()
    if n_rows == 0:
        raise ValueError(f"{salt}: source table is empty")
    if n < n_rows:
        out = sample_exact(df, n, seed, salt, id_col)
    else:
        out = bootstrap_exact(df, n, n_rows, seed, salt, id_col)
    out = out.withColumn("source_id", F.col(id_col).cast("bigint"))
    if materialize:
        from claimforge.session import materialize as _mat

        out = _mat(out, "resize")
    return out


def count_many(frames: dict) -> dict:
    """Row counts of several tables in one job (one small row per table)."""
    parts = [df.groupBy().count().withColumn("_name", F.lit(name)) for name, df in frames.items()]
    return {r["_name"]: r["count"] for r in union_all(parts).collect()}


def head_n(df: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """First ``n`` rows by a key (storage order carries no meaning in Spark)."""
    return df.orderBy(order_col).limit(n)


def uniform_n(df: DataFrame, n: int, seed, salt: str, id_col: str = "id") -> DataFrame:
    """``n`` uniformly drawn rows (same operator as B1)."""
    return sample_exact(df, n, seed, salt, id_col).drop("sample_idx")


# ---------------------------------------------------------------------------------------------
# B4 and its uses
# ---------------------------------------------------------------------------------------------


def largest_remainder_quotas(counts: DataFrame, total, parent_cols, stratum_col: str) -> DataFrame:
    """Quotas per stratum: floor of the proportional share, leftovers to the largest remainders.

    ``counts`` has ``parent_cols + [stratum_col, "n"]``; ``total`` is an int or a column name
    holding the requested size per parent.  Each parent gets ``min(total, rows)``.
    Remainder ties go to the smaller stratum value.
    """
    p = list(parent_cols)
    wp = Window.partitionBy(*p) if p else Window.partitionBy(F.lit(0))
    c = counts.withColumn("_tot", F.sum("n").over(wp))
    req = F.lit(int(total)) if isinstance(total, int) else F.col(total)
    c = c.withColumn("_k", F.least(req.cast("bigint"), F.col("_tot")))
    c = c.withColumn("_base", F.expr("(_k * n) div _tot")).withColumn("_rem", F.expr("(_k * n) % _tot"))
    c = c.withColumn("_left", F.col("_k") - F.sum("_base").over(wp))
    wr = (Window.partitionBy(*p) if p else Window.partitionBy(F.lit(0))).orderBy(F.desc("_rem"), F.asc(stratum_col))
    c = c.withColumn("_rr", F.row_number().over(wr))
    quota = F.col("_base") + F.when(F.col("_rr") <= F.col("_left"), 1).otherwise(0)
    return c.select(*p, stratum_col, quota.cast("bigint").alias("quota"))


def stratified_exact(
    df: DataFrame,
    total,
    seed,
    salt: str,
    key_cols,
    stratum_col: str = "is_true",
    parent_cols=(),
) -> DataFrame:
    """Exactly ``min(total, N)`` rows per parent, proportional to ``stratum_col``.

    ``key_cols`` must identify a row; they key the md5 order and break its ties.
    """
    key_cols = list(key_cols)
    p = list(parent_cols)
    return take_first(
        df, hash_key(seed, salt, *key_cols), key_cols,
        lambda counts: largest_remainder_quotas(counts, total, p, stratum_col), p + [stratum_col],
    )


def few_shot_sets(df: DataFrame, shots, seed, salt: str, id_col: str = "id", label: str = "label", keep_back: int = 2) -> DataFrame:
    """B11 for several sizes at once: per ``shot`` a stratified draw of ``min(shot, n - keep_back)`` rows.

    All sizes use one order, ranked once on the candidates of the largest size (``shots`` bounds them), so the sets of
    a label nest as far as its quotas grow.
    """
    spark = df.sparkSession
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "label-counts")  # one row per label
    total = F.greatest(F.sum("n").over(Window.partitionBy(F.lit(0))) - keep_back, F.lit(0))  # over the labels
    sizes = spark.createDataFrame([(int(s),) for s in shots], "shot int")
    asked = counts.withColumn("_left", total).crossJoin(F.broadcast(sizes)).withColumn("_want", F.least("_left", "shot"))
    quotas = largest_remainder_quotas(asked, "_want", ["shot"], label)
    order = hash_key(seed, salt, id_col)
    top = quotas.groupBy(label).agg(F.max("quota").alias("quota"))
    cand = take_first(df, order, [id_col], top, [label])
    ranked = cand.withColumn("_rk", F.row_number().over(Window.partitionBy(label).orderBy(order, id_col)))
    return ranked.join(F.broadcast(quotas), label).filter(F.col("_rk") <= F.col("quota")).drop("_rk", "quota").select("shot", *df.columns)


def stratified_split(df: DataFrame, n_first: int, seed, salt: str, key_cols, stratum_col: str = "label") -> DataFrame:
    """Flag ``is_train`` on a stratified ``n_first``-row part; both sides are kept."""
    picked = stratified_exact(df, n_first, seed, salt, key_cols, stratum_col).select(
        *key_cols, F.lit(True).alias("is_train")
    )
    return df.join(picked, key_cols, "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))


def thresholds(df: DataFrame, order_hex: Column, key_cols, ranks: list[int]) -> list[tuple | None]:
    """The ``(hash, key)`` of the rows with the given ranks (from 1) in ``(order_hex, key_cols)`` order.

    One histogram of hash prefixes names the bucket of each rank; only those buckets' rows, keys and hash alone, are
    ordered.  None for rank 0; a rank beyond the table gives its last row.
    """
    key_cols = list(key_cols)
    d = df.select(order_hex.alias("_h"), bucket_of(order_hex).alias("_b"), *key_cols)
    per_bucket = d.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).orderBy("_b").collect()  # at most 65,536 rows
    found, need = [], {}
    for rank in ranks:
        before, hit = 0, None
        for b, n in per_bucket:
            if rank <= before + n or b == per_bucket[-1][0]:
                hit = (b, min(rank - before, n))
                break
            before += n
        found.append(hit if rank > 0 else None)
        if found[-1]:
            need.setdefault(hit[0], set()).add(hit[1])
    if not need:
        return [None] * len(ranks)
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key_cols))
    wanted = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, ks in need.items() for k in ks])
    rows = d.filter(F.col("_b").isin(list(need))).withColumn("_k", inside)
    rows = rows.filter(F.array_contains(wanted, F.struct(F.col("_b").alias("b"), F.col("_k").alias("k"))))
    at = {(r["_b"], r["_k"]): (r["_h"], *(r[c] for c in key_cols)) for r in rows.collect()}  # one row a rank
    return [at[hit] if hit else None for hit in found]


def _up_to(order_hex: Column, key_cols, limit: tuple | None, kinds) -> Column:
    """Whether a row is not after ``limit`` in the order."""
    if limit is None:
        return F.lit(False)
    names = ["h", *key_cols]
    own = F.struct(order_hex.alias("h"), *(F.col(c).alias(c) for c in key_cols))
    return own <= F.struct(*(F.lit(v).cast(k).alias(c) for c, v, k in zip(names, limit, ["string", *kinds])))


def fold_of(df: DataFrame, shares: list[float], seed, salt: str, key_cols, group: str | None = None, name: str = "fold") -> DataFrame:
    """Folds of exact sizes: fold ``i`` ends at row ``ceil(n (shares[0] + ... + shares[i]))`` of a seeded order, the rest is
    the last fold.  With ``group`` whole groups are dealt, and ``n`` counts them.  A flag by comparison: no join."""
    key_cols = [group] if group else list(key_cols)
    units = df.select(group).distinct() if group else df
    order = hash_key(seed, salt, *key_cols)
    n = units.count()
    ranks = [math.ceil(round(sum(shares[: i + 1]) * n, 9)) for i in range(len(shares))]
    limits = thresholds(units, order, key_cols, ranks)
    kinds = [df.schema[c].dataType.simpleString() for c in key_cols]
    fold = F.lit(len(shares))
    for i in range(len(shares) - 1, -1, -1):
        fold = F.when(_up_to(order, key_cols, limits[i], kinds), i).otherwise(fold)
    return df.withColumn(name, fold)


def split_flag(df: DataFrame, test_fraction: float, seed, salt: str, key_cols, group: str | None = None, name: str = "is_test") -> DataFrame:
    """The rows with a flag for the test side, which holds ``ceil(f * n)`` rows (or groups)."""
    return fold_of(df, [test_fraction], seed, salt, key_cols, group, name).withColumn(name, F.col(name) == 0)


def train_val_split(df: DataFrame, test_fraction: float, seed, salt: str, key_cols, group: str | None = None):
    """Unstratified split; returns (train, test).  ``test`` holds ``ceil(f * n)`` rows.

    With ``group`` the split is made on whole groups (e.g. ``source_id``), so bootstrap
    duplicates cannot leak from train into test.
    """
    flagged = split_flag(df, test_fraction, seed, salt, key_cols, group, "_is_test")
    return flagged.filter("NOT _is_test").drop("_is_test"), flagged.filter("_is_test").drop("_is_test")


def union_all(frames) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), frames)
