import random

import numpy as np
import pytest
from helpers import VECTORS, rows_of
from pyspark.sql import functions as F

from kgspark.llm.components import components
from kgspark.llm.kdtree import KDTree, exact_type, search, top_k
from kgspark.llm.vector_links import _tiles, links, principal_axes, tile_links, unit


def planted(n, d, seed=1, groups=6, size=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    at = 0
    for _ in range(groups):
        for _ in range(size):
            x[at] = x[at - at % size] + rng.normal(size=d) * rng.choice([0.05, 0.3, 0.45])
            at += 1
    return x.astype(np.float32)


def brute(x):
    """Link counts and smallest reachable position of every row; unusable rows are given as None."""
    ok = [i for i, v in enumerate(x) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    linked = {i: [] for i in range(len(x))}
    for a in ok:
        for b in ok:
            if a < b and len(x[a]) == len(x[b]):
                p, q = np.array(x[a], float), np.array(x[b], float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.9:
                    linked[a].append(b)
                    linked[b].append(a)
    low = {}
    for i in range(len(x)):
        if i not in low:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in low:
                    low[j] = i
                    todo += linked[j]
    return [(i, len(linked[i]), low[i], low[i] == i) for i in range(len(x))]


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_equal_brute_force(spark, tile):
    x = [v.tolist() for v in planted(200, 24)]
    x += [x[3], x[3], [c * 2 for c in x[60]], None, [], [0.0] * 24, [None] + x[0][1:], [float("nan")] * 24, [float("inf")] + x[0][1:], [1.0, 2.0], [1.0, 2.1], [1e-30] * 24, [1e30] * 24]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in enumerate(x)], VECTORS + ", kept string")
    assert sorted(tuple(r) for r in links(df, tile=tile).collect()) == brute(x)


def test_links_of_odd_tables(spark):
    assert links(spark.createDataFrame([], VECTORS)).count() == 0
    got = rows_of(links(spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1)], VECTORS)))
    assert got == sorted([(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True)], key=repr)
    # A group of copies that is a third of all rows.
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), -1.0 / i], 0) for i in range(1, 91)]
    hot = [r for r in links(spark.createDataFrame(rows, VECTORS)).collect() if r["vec_id"] % 3 == 0]
    assert {r["component_id"] for r in hot} == {3} and len({r["n_links"] for r in hot}) == 1 and hot[0]["n_links"] >= 29


def test_hundreds_of_tiles(spark):
    x = np.random.default_rng(5).normal(size=(820, 2))
    near = unit(x) @ unit(x).T >= 0.999
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    low = np.arange(len(x))
    while (now := np.where(near, low, len(x)).min(axis=1)).tolist() != low.tolist():
        low = now
    got = links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), 0.999, tile=2).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want
    assert {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(low.tolist()))


def test_equal_angles_do_not_share_one_tile(spark):
    x = [[1.0 * k, 2.0 * k, 0.5 * k] for k in range(1, 81)] + planted(60, 3, seed=9).tolist()
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], VECTORS)
    vectors = df.select("embedding", F.col("vec_id").alias("id"), F.lit(1).cast("bigint").alias("n"), F.size("embedding").alias("dim"))
    for side in _tiles(vectors, principal_axes(vectors), 0.9, 8):
        assert max(r["count"] for r in side.groupBy("dim", "i", "j").count().collect()) <= 24
    assert sorted(tuple(r) for r in links(df, tile=8).collect()) == brute(x)


def test_tiles_find_each_pair_once():
    x = unit(planted(150, 20, seed=4).astype(float))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    want = {(i, j) for i in range(150) for j in range(i) if x[i] @ x[j] >= 0.9}
    for step in (3, 16, 40):
        got = [(max(i, j), min(i, j)) for a, b in tile_links(x, x, True, axes, 0.9, step) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        cross = {(i, j + 70) for a, b in tile_links(x[:70], x[70:], False, axes, 0.9, step) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert cross == {(j, i) for i, j in want if j < 70 <= i}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain, star = [(i, i + 1) for i in range(1, 60)], [(100, i) for i in range(101, 400)]
    loose = [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(80)]
    edges = [*chain, *star, *loose, (5, 5), (2, 1)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((i, root(i)) for i in parent if root(i) != i)
    assert sorted(tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()) == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_top(x, k, step, scale=1024):
    ok = {i: [int(np.floor(float(np.float32(c)) * scale)) for c in v] for i, v in x if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in sorted(ok):
        if q % step == 0:
            scored = sorted(((sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])), key=lambda s: (-s[0], s[1]))
            out += [(q, n, i, s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [8192, 40])
def test_top_k_equals_brute_force(spark, shard):
    x = [(i, v.tolist()) for i, v in enumerate(planted(230, 12))]
    x += [(i, x[5][1]) for i in range(300, 330)]  # many ties
    x += [(400, None), (405, []), (410, [float("nan")] * 12), (415, [None] * 12), (420, [0.0] * 12), (425, [1.0, 2.0]), (430, [2.0, 1.0]), (None, x[0][1])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in x], VECTORS + ", rank int")
    got = sorted(tuple(r) for r in top_k(df, step=5, shard=shard, block=16, leaf=8).collect())
    assert got == brute_top(x, 10, 5)


def test_top_k_of_odd_tables(spark):
    assert top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0], 0)], VECTORS)).count() == 0
    twice = top_k(spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 0), (1, [2.0], 0)], VECTORS)).collect()
    assert sorted(tuple(r) for r in twice) == [(0, 1, 1, 1024 * 2048)] * 2
    # Sums beyond 2**53 stay exact, beyond 2**63 they are refused.
    wide = [(0, [float(2**17), 1.0], 0), (1, [float(2**17), 1.0], 0), (2, [float(2**17), 1.0 + 2**-10], 0)]
    assert [tuple(r) for r in top_k(spark.createDataFrame(wide, VECTORS)).collect()] == [(0, 1, 2, 2**54 + 1024 * 1025), (0, 2, 1, 2**54 + 1024 * 1024)]
    with pytest.raises(ValueError):
        exact_type(np.array([[2**40]]), np.array([[2**40]]))


def test_traversal_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 1000
    points = np.concatenate([c + rng.normal(size=(64, 6)) for c in centres]).round()
    tree, looked = KDTree(points, 16), []

    class Watched(KDTree):
        @property
        def points(self):
            looked.append(1)
            return self.rows

        @points.setter
        def points(self, rows):
            self.rows = rows

    watched = Watched(points, 16)
    assert (tree.order == watched.order).all() and all((tree.low[0] <= points.min(axis=0)).tolist())
    q = points[:1]
    [(ids, scores)] = search(watched, watched.order, q, np.array([-1]), np.array([-np.inf]), 5)
    want = np.lexsort((np.arange(len(points)), -(points @ q[0])))[:5]
    assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == [(-(points[i] @ q[0]), i) for i in want.tolist()]
    assert len(looked) < sum(c is None for c in watched.children) / 2
