import numpy as np
import pytest

from claimforge.llm import embedding_dups as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=ed.COSINE):
    ok = {}
    for at, (i, v, lab) in enumerate(rows):
        if i is None or v is None or lab is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        ok[at] = (lab, x / np.sqrt((x * x).sum()))
    root, links = {at: at for at in range(len(rows))}, [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for at, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(at)] = min(least.get(find(at), i), i)
    return sorted((str(rows[at][0]), links[at], str(least.get(find(at)))) for at in range(len(rows)))


def _got(df, **how):
    return sorted((str(r["id"]), r["n_links"], str(r["component_id"])) for r in ed.near_vectors(df, **how).collect())


@pytest.mark.parametrize("chunk,dim", [(2048, 64), (25, 64), (25, 10)])
def test_links_match_brute_force(spark, chunk, dim):
    rng = np.random.default_rng(chunk + dim)
    rows = []
    for base in range(12):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 25)):
            v = centre + rng.normal(size=dim) * rng.choice([0.05, 0.15, 0.25, 0.3])
            rows.append((len(rows), [float(x) for x in v], int(base % 3)))
    rows += [(len(rows) + k, [float(x) for x in rng.normal(size=dim)], 0) for k in range(120)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(6)] + [(2000, rows[0][1], 1)]
    rows += [(2001, [2 * x for x in rows[0][1]], 0)]  # the same direction
    assert _got(spark.createDataFrame(rows, SCHEMA), chunk=chunk) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [None, 1.0, 1.0], 1),
            (8, [float("inf"), 1.0, 1.0], 1), (9, v + [0.0], 1), (10, v, 1), (10, v, 1), (None, v, 1), (11, [1.0, 2.0, 3.01], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [5.0], 1), (14, [-5.0], 1), (15, [7.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS links", "3 AS id", "4 AS rows")
    assert _got(df) == brute(rows)
    assert ed.near_vectors(df.limit(0)).count() == 0


def test_every_linked_pair_is_in_range_of_a_block():
    rng = np.random.default_rng(4)
    x = ed.unit(rng.normal(size=(4000, 64)))
    y = ed.unit(x + 0.045 * rng.normal(size=x.shape))
    cos = np.einsum("ij,ij->i", x, y)
    near = np.add.reduceat((ed.rotated(x) - ed.rotated(y)) ** 2, ed.block_starts(64), axis=1) <= ed.budgets(64, ed.COSINE)
    assert near[cos >= ed.COSINE].any(axis=1).all() and (cos >= ed.COSINE).sum() > 500


def test_very_long_and_short_vectors(spark):
    rows = [(1, 0, [1e200, 0.0]), (2, 0, [1e300, 1e298]), (3, 0, [5e-324, 0.0]), (4, 0, [1e-200, 1e-203]), (5, 0, [0.0, 1e-300]), (6, 0, [3.0, 0.1]), (7, 0, [0.0, 0.0]), (8, 0, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (4, 1), 7: (0, 7), 8: (0, 8)}
