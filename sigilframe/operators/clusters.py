"""Clusters of feature rows: single linkage with its dendrogram, k-means, and how well two labellings agree.

Single linkage needs the minimum spanning tree alone. A single block of rows grows its own; else it grows in Borůvka rounds: every component's least edge to another one joins the tree. The rounds look into the NEAR nearest
neighbours of each row; only rows whose neighbours are all in their own component, and nearer than the best edge known to leave it, are searched for again, in those blocks that can hold
something nearer (`nearby`). No table of all pairs exists, and every order of ties is by (distance, smaller index, larger index), so the tree is unique.

The dendrogram is a walk along the tree's edges in order. It is cut into segments of edges: half of a segment waits for the components of the other half, which Spark works out for
all segments at once, until a segment is small enough for one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilframe.operators.graph import components, rooted, written
from sigilframe.operators.nearby import Blocked, Some, blocked, direct, nearest, vectors, visited, visits
from sigilframe.operators.records import numbered

NEAR = 8
SEGMENT = 200_000  # tree edges that one task walks
FIXED = 1 << 20  # k-means adds up components in units of 1 / FIXED, so that sums don't depend on their order


def _least_other(here: Some, asking: Some) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each visitor its nearest vector of another component (g), at most its bound away; ties by the edge's indices."""
    d = direct(asking.v, here.v)
    d[(asking.g.astype(np.int64)[:, None] == here.g.astype(np.int64)[None]) | (d > asking.bound[:, None])] = np.inf
    least = d.min(1)
    r, c = ((d == least[:, None]) & (d < np.inf)).nonzero()
    one, other = asking.qid[r], here.qid[c]
    order = np.lexsort((np.maximum(one, other), np.minimum(one, other), r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r) == np.arange(len(r))
    return asking.qid[r[first]], here.qid[c[first]], d[r[first], c[first]]


def spanning_tree(rows: DataFrame, columns: list[str], index: str, near: int = NEAR) -> DataFrame:
    """(height, lo, hi): the edges of the minimum spanning tree of rows by Euclidean distance, copies tied to the first of them at height 0. Indices are unique; rows with a
    null or non-finite component take no part."""
    at = blocked(rows, columns, index, near + 1)
    ids = at.table.select("qid", "v")
    v = rows.select(F.col(index).cast("long").alias("hi"), F.transform(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x + 0.0).alias("v"))
    copies = v.join(ids, "v").where("hi <> qid").select(F.lit(0.0).alias("height"), F.col("qid").alias("lo"), "hi")
    one = replace(at, table=at.table.withColumn("ids", F.array("qid")))  # of copies only the first goes on
    if len(at.low) < 2:  # a single block has its own tree
        return written(copies.unionByName(one.table.groupBy("block").applyInArrow(_grown, "height double, lo long, hi long")))
    links = written(nearest(one, near + 1).where("qid <> target"))
    radius = links.groupBy("qid").agg(F.when(F.count(F.lit(1)) == near, F.max("distance")).otherwise(float("inf")).alias("radius"))
    comp = written(at.table.select("qid", F.col("qid").alias("comp")))
    tree = [copies]
    while comp.select("comp").distinct().count() > 1:
        inside = _between(links, comp).withColumn("leaves", F.col("comp") != F.col("other"))
        found = written(inside.where("leaves"))
        shut = comp.join(found.select("qid").distinct(), "qid", "left_anti").join(radius, "qid")
        here = replace(one, table=one.table.drop("g").join(comp.select("qid", F.col("comp").cast("string").alias("g")), "qid"))
        lone = _asking(shut, _best(found), here).where("bound = double('infinity') and g = string(qid)")  # one vector of each component that no known edge leaves
        if not lone.isEmpty():
            found = written(found.unionByName(_searched(here, lone, comp)))
        found = found.unionByName(_searched(here, _asking(shut, _best(found), here), comp))
        best = written(_best(found))
        tree.append(best.select("height", "lo", "hi").distinct())
        up = best.select(F.col("comp").alias("node"), F.col("other").alias("up"))
        back = up.select(F.col("node").alias("up"), F.col("up").alias("back"))  # two components that chose each other: the smaller one is the root
        root = rooted(up.join(back, "up").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
        comp = written(comp.join(root.withColumnRenamed("node", "comp"), "comp").select("qid", F.col("root").alias("comp")))
    out = tree[0]
    for t in tree[1:]:
        out = out.unionByName(t)
    return written(out)


def _grown(t: pa.Table) -> pa.Table:
    """The spanning tree of one block, grown from its first vector."""
    x, q = vectors(t.column("v").combine_chunks()), np.asarray(t.column("qid"))
    best, to, out = np.full(len(q), np.inf), np.full(len(q), -1), []
    left, at = np.ones(len(q), bool), int(np.argmin(q))
    left[at] = False
    while left.any():
        d = direct(x[at : at + 1], x)[0]
        lo, hi = np.minimum(q[at], q), np.maximum(q[at], q)
        was = np.where(to >= 0, q[to], q)
        before = (lo < np.minimum(was, q)) | ((lo == np.minimum(was, q)) & (hi < np.maximum(was, q)))
        nearer = left & ((d < best) | ((d == best) & before))
        best[nearer], to[nearer] = d[nearer], at
        some = np.flatnonzero(left & (best == best[left].min()))
        one, other = np.minimum(q[some], q[to[some]]), np.maximum(q[some], q[to[some]])
        k = np.lexsort((other, one))[0]
        at = int(some[k])
        out.append((best[at], one[k], other[k]))
        left[at] = False
    height, lo, hi = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"height": pa.array(height, pa.float64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """(qid, comp, other, distance, lo, hi) of links (qid, target, distance): the components of both ends."""
    e = links.join(comp, "qid").join(comp.select(F.col("qid").alias("target"), F.col("comp").alias("other")), "target")
    return e.select("qid", "comp", "other", "distance", F.least("qid", "target").alias("lo"), F.greatest("qid", "target").alias("hi"))


def _best(found: DataFrame) -> DataFrame:
    """(comp, other, height, lo, hi): each component's least edge; an edge counts for both of its ends."""
    edge = lambda c: F.struct(F.col("distance").alias("height"), "lo", "hi", F.col(c).alias("other")).alias("e")
    both = found.select("comp", edge("other")).unionByName(found.select(F.col("other").alias("comp"), edge("comp")))
    return both.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*")


def _asking(shut: DataFrame, best: DataFrame, here: Blocked) -> DataFrame:
    """Rows whose known neighbours are all in their component and nearer than its best edge, bounded by that."""
    bound = F.coalesce("height", F.lit(float("inf")))
    open_ = shut.join(best.select("comp", "height"), "comp", "left").where(F.col("radius") <= bound).select("qid", bound.alias("bound"))
    return here.table.join(open_, "qid")


def _searched(here: Blocked, asking: DataFrame, comp: DataFrame) -> DataFrame:
    sole = here.table.groupBy("block").agg(F.min(F.col("g").cast("long")).alias("a"), F.max(F.col("g").cast("long")).alias("b")).collect()  # a row a block
    skip = np.full(len(here.low), -(1 << 62))
    for r in sole:
        if r.a == r.b:
            skip[r.block] = r.a
    found = visited(here, visits(here, asking, own=True, skip=skip), _least_other)
    return _between(found, comp).withColumn("leaves", F.lit(True))


def dendrogram(edges: DataFrame, segment: int | None = None) -> DataFrame:
    """(place, left, right, height, size): the merges of a tree (height, lo, hi), lowest first; a cluster is named by its smallest index, left is the smaller of the two, and
    size counts the rows of both."""
    e = written(numbered(edges.select("height", "lo", "hi"), ["height", "lo", "hi"], "place").withColumns({"u": F.col("lo"), "v": F.col("hi"), "seg": F.lit(0).cast("long")}))
    total, parts = e.count(), 1
    sizes = e.sparkSession.createDataFrame([], "seg long, node long, size long")  # of nodes that stand for several rows
    while total > parts * (segment or SEGMENT):
        parts *= 2
        half = F.floor((F.col("place") - 1) * parts / total)
        e = e.withColumn("seg2", half)
        low, high = e.where("seg2 % 2 = 0"), e.where("seg2 % 2 = 1")
        node = lambda c: F.struct("seg", F.col(c).alias("node"))
        root = components(low.select(node("u").alias("a"), node("v").alias("b"))).select(F.col("node.seg").alias("seg"), F.col("node.node").alias("node"), F.col("root.node").alias("root"))
        grown = sizes.join(root, ["seg", "node"], "full_outer").groupBy("seg", F.coalesce("root", "node").alias("node")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("size"))
        for c in ("u", "v"):
            high = high.join(root.select("seg", F.col("node").alias(c), "root"), ["seg", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")
        sizes = written(sizes.withColumn("seg", F.col("seg") * 2).unionByName(grown.withColumn("seg", F.col("seg") * 2 + 1)))
        e = written(low.unionByName(high).withColumn("seg", F.col("seg2")).drop("seg2"))
    for c in ("u", "v"):
        e = e.join(sizes.select("seg", F.col("node").alias(c), F.col("size").alias(f"size_{c}")), ["seg", c], "left")
    e = e.select("seg", "place", "height", "u", "v", *(F.coalesce(f"size_{c}", F.lit(1)).alias(f"size_{c}") for c in ("u", "v")))
    return e.groupBy("seg").applyInArrow(_walk, "place long, left long, right long, height double, size long")


def _walk(t: pa.Table) -> pa.Table:
    """Joins the ends of a segment's edges in order."""
    t = t.sort_by("place")
    up: dict[int, int] = {}
    size: dict[int, int] = {}

    def top(x: int) -> int:
        way = []
        while (y := up.get(x, x)) != x:
            way.append(x)
            x = y
        for w in way:
            up[w] = x
        return x

    out = []
    for u, v, su, sv in zip(*(t.column(c).to_pylist() for c in ("u", "v", "size_u", "size_v")), strict=True):
        size.setdefault(u, su)
        size.setdefault(v, sv)
        a, b = sorted((top(u), top(v)))
        up[b] = a
        size[a] += size[b]
        out.append((a, b, size[a]))
    left, right, n = zip(*out, strict=True)
    return pa.table({"place": t.column("place"), "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()), "height": t.column("height"), "size": pa.array(n, pa.int64())})


def cut_tree(edges: DataFrame, rows: DataFrame, index: str, clusters: int | None = None, height: float | None = None) -> DataFrame:
    """(index, cluster): flat clusters without the tree's edges above a height, or without its last ones, so that `clusters` are left; named by their smallest index."""
    kept = edges
    if height is not None:
        kept = kept.where(F.col("height") <= height)
    if clusters is not None:
        n = edges.count()
        kept = numbered(kept, ["height", "lo", "hi"], "_n").where(F.col("_n") <= n + 1 - clusters)
    of = components(kept, "lo", "hi")
    return rows.select(F.col(index).cast("long").alias(index)).join(of.withColumnRenamed("node", index), index, "left").select(index, F.coalesce("root", index).alias("cluster"))


@dataclass(frozen=True)
class Centres:
    """Centres of k-means by row, how often they moved, and the sum of squared distances before the last move."""

    at: np.ndarray
    rounds: int
    inertia: float


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lower one at a tie) and squared distance of each row's nearest centre."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for k, c in enumerate(centres):
        d = np.zeros(len(x))
        for j in range(len(c)):
            d += (x[:, j] - c[j]) ** 2
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def _points(rows: DataFrame, columns: list[str]) -> DataFrame:
    v = F.array(*(F.col(c).cast("double") for c in columns))
    return rows.select(v.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _totals(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and sums of components by centre, and the sum of squared distances; a task sends one row a centre."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, off = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for b in batches:
            x = vectors(b.column(0))
            at, d = _near(x, centres)
            n += np.bincount(at, minlength=len(centres))
            np.add.at(total, at, np.floor(x * FIXED + 0.5).astype(np.int64))
            np.add.at(off, at, np.floor(d * FIXED + 0.5).astype(np.int64))
        some = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array(off[some])], names=["k", "n", "total", "off"])

    sums = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(centres.shape[1])]
    n, total, off = np.zeros(len(centres), np.int64), np.zeros(centres.shape), 0
    for r in points.mapInArrow(add, "k long, n long, total array<long>, off long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("off").alias("off"), *sums).collect():  # one row a centre
        n[r.k], off = r.n, off + r.off
        total[r.k] = [r[f"t{j}"] for j in range(centres.shape[1])]
    return n, total, off / FIXED


def _share(seed: int, turn: int) -> Column:
    """A number from 0 to 1 that a vector, a seed and a turn decide."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "v"), F.lit(1 << 53)) / float(1 << 53)


def first_centres(rows: DataFrame, columns: list[str], k: int, seed: int = 7, turns: int = 3) -> np.ndarray:
    """k starting centres that don't depend on the order of rows: candidates are drawn in turns by a hash of vector and seed, with a chance that grows with the squared distance
    from those before (2 k a turn are expected); k of them are then chosen one after the other by the same rule, weighed by the rows that are nearest to them. Fewer if there are fewer distinct vectors."""
    points = _points(rows, columns)
    first = points.orderBy(_share(seed, 0), "v").first()
    if first is None:
        return np.zeros((0, len(columns)))
    found = {tuple(first.v)}
    for turn in range(1, turns + 1):
        centres = np.array(sorted(found))
        inertia = _totals(points, centres)[2]
        if not inertia:
            break

        def drawn(batches: Iterator[pa.RecordBatch], centres=centres, inertia=inertia) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _near(vectors(b.column(0)), centres)[1]
                yield b.filter(pa.array(np.asarray(b.column(1)) * inertia < 2 * k * d)).select(["v"])

        found |= {tuple(r.v) for r in points.withColumn("u", _share(seed, turn)).mapInArrow(drawn, "v array<double>").distinct().collect()}  # about 2 k rows
    centres = np.array(sorted(found))
    weight = _totals(points, centres)[0].astype(float)
    r = np.random.default_rng(seed)
    chosen = [int(np.searchsorted(np.cumsum(weight), r.random() * weight.sum(), "right"))]
    while len(chosen) < min(k, len(centres)):
        chance = np.cumsum(weight * _near(centres, centres[chosen])[1])
        if not chance[-1]:
            break
        chosen.append(int(np.searchsorted(chance, r.random() * chance[-1], "right")))
    return centres[sorted(chosen)]


def k_means(rows: DataFrame, columns: list[str], k: int, start: np.ndarray | None = None, rounds: int = 50, shift: float = 1e-6, seed: int = 7) -> Centres:
    """Centres that are moved to the mean of their rows until none moves by more than `shift`. A centre without rows stays. Only k rows a round reach the driver; rows with a
    null or non-finite component don't count."""
    at = first_centres(rows, columns, k, seed) if start is None else np.array(start, float)
    points, inertia = _points(rows, columns), 0.0
    for turn in range(1, rounds + 1):
        if not len(at):
            break
        n, total, inertia = _totals(points, at)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None] / FIXED, at)
        moved, at = float(np.sqrt(((new - at) ** 2).sum(1)).max()), new
        if moved <= shift:
            return Centres(at, turn, inertia)
    return Centres(at, rounds, inertia)


def assigned(rows: DataFrame, columns: list[str], index: str, centres: np.ndarray) -> DataFrame:
    """(index, cluster, distance) of the nearest centre, the lower one at a tie; null for rows with a null or non-finite component, and without centres."""
    v = F.array(*(F.col(c).cast("double") for c in columns))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([[np.nan if c is None else c for c in v] for v in b.column(1).to_pylist()], float).reshape(b.num_rows, -1)
            ok = np.isfinite(x).all(1) & bool(len(centres))
            at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
            at[ok], d[ok] = _near(x[ok], centres)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, mask=~ok), pa.array(np.sqrt(d), mask=~ok)], names=[index, "cluster", "distance"])

    return rows.select(index, v.alias("v")).mapInArrow(near, f"`{index}` {rows.schema[index].dataType.simpleString()}, cluster long, distance double")


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): rows of each pair of labels; rows without one of them are left out."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def alignment(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rand, mutual, homogeneity, completeness) of two labellings: the Rand index adjusted for chance, mutual information by the mean of both entropies, and by that of a and of b.
    Each is 1 for labellings without anything to tell apart. One row."""
    cells = written(contingency(rows, a, b))
    pairs = lambda n: n * (n - 1) / 2.0
    log = lambda n: F.sum(n * F.log(n.cast("double")))
    n = F.col("n")
    whole = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(pairs(n)), F.lit(0.0)).alias("same"), log(n).alias("l"))
    side = {c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(n)).alias(f"p_{c}"), log(n).alias(f"l_{c}")) for c in ("a", "b")}
    one = whole.crossJoin(side["a"]).crossJoin(side["b"])  # single rows
    total = F.col("n").cast("double")
    chance = F.col("p_a") * F.col("p_b") / pairs(total)
    most = (F.col("p_a") + F.col("p_b")) / 2
    entropy = {c: F.log(total) - F.col(f"l_{c}") / total for c in ("a", "b")}
    shared = F.log(total) + (F.col("l") - F.col("l_a") - F.col("l_b")) / total
    ratio = lambda x, y: F.when(F.abs(y) < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), x) / y)
    rand = F.when((F.col("n") < 2) | (F.abs(most - chance) < 1e-12), 1.0).otherwise((F.col("same") - chance) / (most - chance))
    return one.select("n", rand.alias("rand"), ratio(shared, (entropy["a"] + entropy["b"]) / 2).alias("mutual"), ratio(shared, entropy["a"]).alias("homogeneity"), ratio(shared, entropy["b"]).alias("completeness"))
