import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.operators import clusters, graph, nearby

AXES = ["a", "b"]


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, v)) for i, v in enumerate(x)], "idx long, " + ", ".join(f"{c} double" for c in AXES))


def plain_tree(x):
    """Kruskal over all pairs: edges by (distance, smaller, larger), and the merges."""
    d = nearby.direct(x, x)
    up = list(range(len(x)))
    size = [1] * len(x)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    tree, merges = [], []
    for h, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        a, b = sorted((top(i), top(j)))
        if a != b:
            tree.append((h, i, j))
            up[b], size[a] = a, size[a] + size[b]
            merges.append((len(tree), a, b, h, size[a]))
    return tree, merges


def shapes(kind):
    r = np.random.default_rng(5)
    if kind == "clumps":  # more rows a clump than neighbours are known, in several blocks
        return r.normal(size=(5, 2))[r.integers(0, 5, 90)] * 30 + r.normal(size=(90, 2))
    if kind == "copies":
        x = r.integers(0, 4, (70, 2)).astype(float)  # many equal rows and equal distances
        x[40:] = x[0]
        return x
    return np.stack([np.arange(50) * 1.1 ** np.arange(50), np.zeros(50)], 1)  # a chain


@pytest.mark.parametrize("kind", ["clumps", "copies", "chain"])
def test_tree_of_one_block(spark, kind):
    x = shapes(kind)
    tree, merges = plain_tree(x)
    edges = clusters.spanning_tree(frame(spark, x), AXES, "idx")
    got = sorted(map(tuple, edges.collect()))
    whole = sorted(map(tuple, clusters.dendrogram(edges).collect()))
    if kind == "copies":  # copies hang on the first of them, so equal edges may differ; heights don't
        assert [e[0] for e in got] == [e[0] for e in tree] and [m[3] for m in whole] == [m[3] for m in merges]
    else:
        assert got == tree and whole == merges
    assert whole[-1][4] == len(x)


def test_tree_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 24)
    x = shapes("clumps")
    tree, merges = plain_tree(x)
    df = frame(spark, x)
    edges = clusters.spanning_tree(df, AXES, "idx", near=3)
    assert sorted(map(tuple, edges.collect())) == tree
    assert sorted(map(tuple, clusters.dendrogram(edges, segment=40).collect())) == merges
    cut = {r.idx: r.cluster for r in clusters.cut_tree(edges, df, "idx", clusters=5).collect()}
    assert len(set(cut.values())) == 5 and all(v <= k for k, v in cut.items())
    of = {r.idx: r.cluster for r in clusters.cut_tree(edges, df, "idx", height=(tree[-4][0] + tree[-5][0]) / 2).collect()}
    assert of == cut


def test_trees_of_nothing(spark):
    df = frame(spark, np.zeros((3, 2)))
    assert clusters.spanning_tree(df.limit(0), AXES, "idx").collect() == [] and clusters.spanning_tree(df.where("idx = 0"), AXES, "idx").collect() == []
    assert sorted(map(tuple, clusters.spanning_tree(df, AXES, "idx").collect())) == [(0.0, 0, 1), (0.0, 0, 2)]
    assert clusters.dendrogram(clusters.spanning_tree(df.limit(0), AXES, "idx")).collect() == []


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000, i) for i in range(400, 460)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a is not None and a != b:
            one, other = want.setdefault(a, {a}), want.setdefault(b, {b})
            one |= other
            for n in other:
                want[n] = one
    assert got == {n: min(s) for n, s in want.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_means(x, start, rounds):
    at = np.array(start, float)
    for _ in range(rounds):
        k = [min(range(len(at)), key=lambda i: (sum((p[j] - at[i][j]) ** 2 for j in range(len(p))), i)) for p in x]
        new = at.copy()
        for i in set(k):
            mine = [p for p, c in zip(x, k, strict=True) if c == i]
            new[i] = [sum(math.floor(p[j] * clusters.FIXED + 0.5) for p in mine) / len(mine) / clusters.FIXED for j in range(x.shape[1])]
        at = new
    return at


def test_k_means(spark):
    r = np.random.default_rng(9)
    x = np.vstack([r.normal(size=(6, 2))[r.integers(0, 6, 200)] * 10 + r.normal(size=(200, 2)), np.full((80, 2), 3.0)])
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None, 1.0), (901, math.nan, 1.0)], "idx long, a double, b double"))
    start = x[[0, 1, 2, 3, 3]]  # one centre twice: the second gets no rows and stays
    got = clusters.k_means(df, AXES, 5, start, rounds=4, shift=-1.0)
    assert np.array_equal(got.at, plain_means(x, start, 4)) and got.rounds == 4
    of = {v.idx: (v.cluster, v.distance) for v in clusters.assigned(df, AXES, "idx", got.at).collect()}
    d = nearby.direct(x, got.at)
    assert [of[i][0] for i in range(len(x))] == d.argmin(1).tolist() and np.allclose([of[i][1] for i in range(len(x))], d.min(1)) and of[900] == of[901] == (None, None)
    assert clusters.k_means(df.limit(0), AXES, 3).at.shape == (0, 2)
    assert {v.cluster for v in clusters.assigned(df, AXES, "idx", np.zeros((0, 2))).collect()} == {None}


def test_k_means_starts_alike_in_any_order(spark):
    r = np.random.default_rng(10)
    middles = np.array([[0, 0], [50, 0], [0, 50], [50, 50], [25, 25]], float)
    x = middles[r.integers(0, 5, 400)] + r.normal(size=(400, 2))
    one = clusters.k_means(frame(spark, x).repartition(3), AXES, 5)
    other = clusters.k_means(frame(spark, x[::-1]).repartition(7), AXES, 5)
    assert np.array_equal(one.at, other.at) and one.rounds < 50
    assert nearby.direct(middles, one.at).min(1).max() < 1  # one centre in each clump
    assert len(clusters.first_centres(frame(spark, np.ones((30, 2))), AXES, 4)) == 1
    assert not np.array_equal(clusters.first_centres(frame(spark, x), AXES, 5, seed=1), clusters.first_centres(frame(spark, x), AXES, 5, seed=2))


def test_alignment(spark):
    def told(pairs):
        return clusters.alignment(spark.createDataFrame(pairs, "x string, y string"), "x", "y").first()

    same = told([(c, c * 2) for c in "aabbbc"] + [(None, "z"), ("z", None)])
    assert (same.n, same.rand) == (6, 1.0) and abs(same.mutual - 1) < 1e-12
    assert told([("a", "x")] * 4).rand == 1.0 and told([("a", "x")] * 4).mutual == 1.0
    one = told([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])
    assert abs(one.rand + 0.5) < 1e-12 and abs(one.mutual) < 1e-12
    split = told([("a", "x"), ("a", "y"), ("b", "z"), ("b", "w")])
    assert abs(split.homogeneity - 1) < 1e-12 and abs(split.completeness - 0.5) < 1e-12 and abs(split.mutual - 2 / 3) < 1e-12
    none = clusters.alignment(spark.createDataFrame([], "x string, y string"), "x", "y").first()
    assert none.n == 0 and none.rand == 1.0
    assert clusters.contingency(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "x string, y string"), "x", "y").select(F.sum("n")).first()[0] == 2
