"""Jaccard join of word shingles with count-vector R-trees.

A document's set is its distinct shingles, hashed to 64 bits. Hashing the shingles into DIMS groups gives a point, the groups' counts; the sum of
the smaller coordinates of two points bounds the overlap of their sets from above. An R-tree over points is searched
with that bound, at its nodes with the nodes' largest coordinates; pairs that survive are verified on the sets.

One tree over a corpus would not prune: hashed counts of unrelated documents of one size differ little in any
coordinate. So documents are first dealt to trees by signatures that lose no link. Sets that link differ in at most d shingles,
where d follows from their sizes. Cut into more than d groups by hash, they agree in at least one group; with as many more
groups as usually stay empty, in one that isn't empty. A signature is the hash of a whole group of a size class, so
it takes several common shingles in the same places to share one. The few documents with too many
empty groups also get the signatures of the classical prefix filter, which cover links among themselves.

Signatures are sorted in ranges of (signature, set), so a hot one is spread over tasks. Points have as many coordinates as their size class needs to
tell unrelated sets apart. A signature of few sets gives pairs, whose bound is looked at once for each pair; one of more gets an R-tree over its sets'
points. Of a signature of more sets than a tree takes, those leave that have more than d groups of other, smaller signatures: whatever they link with
agrees with one of these. The rest (sets that are mostly such common groups) are tied without a bound here; the trees of the next step apply it.

Sets that are tied, directly or over others, are verified together, by an R-tree over their points and then on the sets. Ties of more than
`tree` shingles are split into parts. First each part is searched for itself, then, round by round, one set of each component found; so groups of
near copies merge while every set is dealt once. Where several components remain, all sets outside the largest one are compared with
all parts, which leaves no pair out. A group of near copies costs no more than its sets times the parts of those that stay apart.

Within a task, a pair whose documents are in one component already needs no verification, so what leaves a task is a
spanning forest, never all pairs of a group. Equal sets are one node throughout, known by 121 bits of their digest and a size class, or by 128 bits.

Shuffles: the signatures (24 bytes each, about a third of the shingles), the texts once, to pick out those in trees of more than one document, and small tables.

Nulls and odd rows: a null or wordless text has an empty set and is linked with nothing, its component is its own doc_id; a component's
id is its smallest doc_id that isn't null, or null where it has none; repeated rows are copies; a text of any length is one set; extra columns play no part.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .components import components
from .shared import fresh, map_rows, parts_for, stored

Share = tuple[int, int]
WORDS, SHARE = 4, (85, 100)  # of op4
COPY_WORDS, COPY_SHARE = 5, (80, 100)  # of near copies, as a pipeline removes them
DIMS = 32
RATIO = 1.6
LEAF = 32
CHUNK = 1 << 20
MOST_SENT = 200_000  # rows of three small values that may be broadcast


@dataclass(frozen=True)
class Limits:
    """How work is cut; results don't depend on it. short: sets of a signature that are paired at once; run: sets that one R-tree of a
    signature takes; tree: shingles that are verified in one task."""

    short: int = 8
    run: int = 20_000
    tree: int = 2 << 20


LIMITS = Limits()

LOW = np.uint64(127)  # the lowest bits of a signature name its size class

GAP = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, by XXH3; a long text is split in parts of about CHUNK bytes."""
    out, at = [], 0
    while at < len(raw):
        cut = GAP.search(raw, at + CHUNK)
        words = raw[at : cut.start() if cut else len(raw)].split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        at = cut.start() if cut else len(raw)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text, sorted."""
    w = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[j : j + n])
    return np.unique(h)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    both = [mix(s ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x51ED270B9F3C1D05, 0x1B873593CC9E2D51)]
    return tuple(int(x.astype(np.int64)) for x in both)


def key_of(hi: int, lo: int) -> bytes:
    return struct.pack(">qq", hi, lo)


def keys_of(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """16 bytes for each pair of longs, as key_of gives them."""
    raw = np.stack([hi, lo], 1).astype(">i8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(raw)]).cast(pa.binary())


def most_apart(a: int, b: int, share: Share = SHARE) -> int:
    """The most shingles in which linked sets of these sizes can differ."""
    n, d = share
    return (a + b) * (d - n) // (d + n)


@lru_cache
def spare(share: Share) -> int:
    """Groups for each hundred differences: the fewest of which a class's smallest sets fill 107 on average."""
    n, d = share
    filled = n / (RATIO * (d - n))  # shingles of a smallest set for each difference
    return next(p for p in range(107, 10_000) if p * (1 - math.exp(-filled * 100 / p)) >= 107)


def scheme(k: int, share: Share = SHARE) -> tuple[int, int]:
    """Of size class k: the most differences of a pair whose smaller set is in the class, and the number of groups."""
    small = int(RATIO ** (k + 1))
    d = most_apart(small, small * share[1] // share[0], share)
    return d, -(-(d + 1) * spare(share) // 100) + 1


@lru_cache
def schemes(share: Share) -> list[tuple[int, int]]:
    return [scheme(k, share) for k in range(90)]


BOUNDS = [RATIO**k for k in range(91)]


def classes(n: int, share: Share = SHARE) -> list[int]:
    """The size classes of a set: its own and, near its lower bound, the one below; without those where only equal sets link."""
    k = int(np.searchsorted(BOUNDS, n, "right")) - 1
    return [c for c in (k, k - 1) if c >= 0 and n * share[0] <= BOUNDS[c + 1] * share[1] and schemes(share)[c][0]]


def signatures(s: np.ndarray, share: Share = SHARE) -> np.ndarray:
    """Hashes of whole groups, for each size class of the set."""
    made = [x for x, _ in by_class(s, share)]
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def by_class(s: np.ndarray, share: Share = SHARE) -> list[tuple[np.ndarray, int]]:
    """Of each size class: the signatures, and how many groups above d are filled (0 at most where the prefix filter is needed)."""
    n, out = len(s), []
    mixed = mix(s)
    for c in classes(n, share):
        d, groups = schemes(share)[c]
        g = ((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
        made = [mix(np.add.reduceat(mixed, first) + g[first] * np.uint64(0xC2B2AE3D27D4EB4F))]
        if len(first) < d + 1:
            made.append(mix(s[: n - -(-n * share[0] // share[1]) + 1] ^ np.uint64(0x27D4EB2F165667C5)))
        out.append((np.concatenate(made) & ~LOW | np.uint64(c), len(first) - d))
    return out


def dims_of(c: int) -> int:
    """Coordinates of the points of a size class, 4 to 8 shingles each: chance makes unrelated sets differ by more than a link allows."""
    return dims_for(int(BOUNDS[c]))


def dims_for(n: int) -> int:
    return max(DIMS, 1 << (n // 8).bit_length())


def point(s: np.ndarray, dims: int = DIMS) -> np.ndarray:
    return np.bincount((s & np.uint64(dims - 1)).astype(np.int64), minlength=dims)


def may_link(overlap, a, b, share: Share = SHARE):
    """Whether an overlap of at most so much can be enough for sets of sizes a and b."""
    return overlap * (share[0] + share[1]) >= (a + b) * share[0]


class CountTree:
    """An R-tree over count vectors, packed by recursive splits at the middle of the widest coordinate. A search bounds the overlap with what a
    node can hold by the sum of smaller coordinates, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, share: Share = SHARE):
        self.points, self.sizes, self.share = points.astype(np.int32), sizes, share
        leaves: list[np.ndarray] = []
        stack = [np.argsort(sizes, kind="stable")]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            both = np.concatenate([self.points[rows], sizes[rows][:, None]], 1)
            wide = int((both.max(0) - both.min(0)).argmax())
            order = rows[np.argsort(both[:, wide], kind="stable")]
            stack += [order[len(order) // 2 :], order[: len(order) // 2]]
        self.leaves = leaves
        # Levels from the leaves up: the largest coordinates and the sizes' range of each node.
        self.levels = [(np.stack([self.points[r].max(0) for r in leaves]), np.array([sizes[r].min() for r in leaves]), np.array([sizes[r].max() for r in leaves]))]
        while len(self.levels[-1][0]) > LEAF:
            top, lo, hi = self.levels[-1]
            cut = np.arange(0, len(top), 8)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def search(self, q: np.ndarray, size: int) -> np.ndarray:
        """Rows whose overlap with the query may be enough for a link."""
        n, d = self.share
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, lo, hi = (x[nodes] for x in self.levels[depth])
            most = np.minimum(np.minimum(top, q).sum(1), np.minimum(hi, size))
            least = np.maximum(lo, -(-size * n // d))
            nodes = nodes[(hi * d >= size * n) & (lo * n <= size * d) & may_link(most, size, least, self.share)]
            if not len(nodes):
                return nodes
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = (nodes[:, None] * 8 + np.arange(8)).ravel()
                nodes = nodes[nodes < below]
        rows = np.concatenate([self.leaves[i] for i in nodes])
        most = np.minimum(self.points[rows], q).sum(1)
        return rows[may_link(most, self.sizes[rows], size, self.share) & (self.sizes[rows] * d >= size * n) & (self.sizes[rows] * n <= size * d)]


def linked(a: np.ndarray, b: np.ndarray, share: Share = SHARE) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    overlap = int((both[1:] == both[:-1]).sum())
    return overlap * share[1] >= share[0] * (len(both) - overlap)


def forest(sets: list[np.ndarray], side: np.ndarray | None = None, share: Share = SHARE, label: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that span the components of the sets; with sides (0, 1), of the links between the sides alone. Sets of one label are joined already."""
    if len(sets) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    dims = dims_for(int(np.median(sizes)))
    points = np.stack([point(s, dims) for s in sets])
    inside = np.arange(len(sets)) if side is None else np.flatnonzero(side == 0)
    asking = np.arange(len(sets)) if side is None else np.flatnonzero(side == 1)
    if not len(inside) or not len(asking):
        return
    tree = CountTree(points[inside], sizes[inside], share)
    label = np.arange(len(sets)) if label is None else label.copy()
    for q in asking:
        found = inside[tree.search(points[q], int(sizes[q]))]
        if side is None:
            found = found[found < q]
        while len(found := found[label[found] != label[q]]):
            if linked(sets[q], sets[found[0]], share):
                yield int(q), int(found[0])
                label[label == label[found[0]]] = label[q]
            found = found[1:]


def profile(docs: DataFrame, words: int = WORDS, share: Share = SHARE) -> DataFrame:
    """doc_id, text_key, n, hi, lo (the set's digest), key (the same as bytes) and, once for equal sets of a batch run, its signatures and, by size
    class c, its node, its filled groups above d, and its point; stored."""

    def make():
        seen: set[tuple[int, int]] = set()

        def batch(c: dict) -> dict:
            n, hi, lo, sig, pts = [], [], [], [], []
            for t in c["text"]:
                s = shingles(t, words)
                d = digest_of(s)
                n.append(len(s))
                hi.append(d[0])
                lo.append(d[1])
                new = len(s) > 0 and d not in seen
                if new:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    made = by_class(s, share)
                    sig.append(np.concatenate([x for x, _ in made]).astype(np.int64) if made else np.zeros(0, np.int64))
                    pts.append([{"node": key_of(d[0], d[1] & ~127 | k), "above": m, "p": point(s, dims_of(k)).astype("<u2").tobytes()} for k, (_, m) in zip(classes(len(s), share), made, strict=True)])
                else:
                    sig.append(None)
                    pts.append(None)
            return {"doc_id": c["doc_id"], "text_key": c["text_key"], "n": n, "hi": hi, "lo": lo, "key": list(map(key_of, hi, lo)), "sig": sig, "pts": pts}

        return batch

    src = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return stored(map_rows(src, "doc_id long, text_key long, n long, hi long, lo long, key binary, sig array<long>, pts array<struct<node:binary,above:int,p:binary>>", make), "profile")


def shared_signatures(table: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Streams the signatures in order. Where 2 to `short` nodes share one: (null, a, b) for each pair. Where more do, and for the first and last of
    each range, which may go on in the next: (signature, a, null) for each."""
    rows = table.where("sig is not null").select(F.explode("sig").alias("sig"), "hi", "lo")
    many = table.agg(F.sum(F.size("sig"))).first()[0] or 0
    rows = rows.repartitionByRange(parts_for(table.sparkSession, many, 4 << 20), "sig", "hi", "lo").sortWithinPartitions("sig", "hi", "lo")
    schema, short = pa.schema([("sig", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]), limits.short

    def found(sig: np.ndarray, hi: np.ndarray, lo: np.ndarray, long_ones: list) -> Iterator[pa.RecordBatch]:
        """Of whole signatures, or of parts of one of `long_ones`."""
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.repeat(np.diff(np.append(start, len(sig))), np.diff(np.append(start, len(sig))))
        many = (size > short) | np.isin(sig, np.array(long_ones, np.int64))
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[many]), keys_of(hi[many], lo[many]), pa.nulls(int(many.sum()), pa.binary())], schema=schema)
        few = ~many & (size > 1)
        s, x, y, pairs = sig[few], hi[few], lo[few], []
        for lag in range(1, short):
            same = s[lag:] == s[:-lag]
            if not same.any():
                break
            pairs.append(np.stack([x[:-lag][same], y[:-lag][same], x[lag:][same], y[lag:][same]], 1))
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), keys_of(p[:, 0], p[:, 1]), keys_of(p[:, 2], p[:, 3])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [np.zeros(0, np.int64)] * 3, []
        for batch in batches:
            s, hi, lo = (batch.column(k).to_numpy() for k in range(3))
            if not len(s):
                continue
            sig, hi, lo = (np.concatenate([old, new]) for old, new in zip(held, (s, hi, lo & ~np.int64(127) | (s & np.int64(127))), strict=True))
            if not ends:
                ends = [sig[0]]
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            sig, hi, lo = sig[fresh], hi[fresh], lo[fresh]
            last = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on in the next batch
            if last:
                yield from found(sig[:last], hi[:last], lo[:last], ends)
            sig, hi, lo = sig[last:], hi[last:], lo[last:]
            if len(sig) > short:
                ends = [ends[0], sig[0]]
                yield from found(sig[:-1], hi[:-1], lo[:-1], ends)
                sig, hi, lo = sig[-1:], hi[-1:], lo[-1:]
            held = [sig, hi, lo]
        if len(held[0]):
            yield from found(*held, [held[0][0]])

    return stored(rows.mapInArrow(run, "sig long, a binary, b binary"), "shared")


def ties(table: DataFrame, share: Share = SHARE, limits: Limits = LIMITS) -> DataFrame:
    """(a, b): nodes tied by the bound, spanning all that may link."""
    spark = table.sparkSession
    shared = shared_signatures(table, limits)
    p = table.where("sig is not null").select("n", F.explode("pts").alias("x")).select("x.node", "x.above", F.struct("n", "x.p").alias("p"))
    points = p.groupBy("node").agg(F.first("p").alias("p"), F.first("above").alias("above"))
    pairs = shared.where("sig is null").select("a", "b").distinct()
    pairs = pairs.join(points.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(points.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            keep = [
                i
                for i, (x, y) in enumerate(zip(c["pa"], c["pb"], strict=True))
                if min(x["n"], y["n"]) * share[1] >= max(x["n"], y["n"]) * share[0] and may_link(int(np.minimum(np.frombuffer(x["p"], "<u2"), np.frombuffer(y["p"], "<u2")).sum(dtype=np.int64)), x["n"], y["n"], share)
            ]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    few = pairs.select("a", "b", "pa", "pb").mapInArrow(bounded, "a binary, b binary")
    runs = shared.where("sig is not null").select("sig", F.col("a").alias("node")).join(points, "node")
    sizes = stored(shared.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("a").alias("head")).where("size > 1"), "sizes")
    n_runs, n_hot = sizes.agg(F.sum("size"), F.sum((F.col("size") > limits.run).cast("int"))).first()
    out = few
    if n_runs:
        trees = runs.join(sizes.where(F.col("size") <= limits.run).select("sig"), "sig").select("sig", "node", F.col("p.n").alias("n"), F.col("p.p").alias("p"))
        trees = trees.repartition(parts_for(spark, n_runs, 1 << 18), "sig").sortWithinPartitions("sig", "node")
        out = out.unionByName(trees.mapInArrow(lambda batches: run_trees(batches, share), "a binary, b binary"))
    if n_hot:
        hot = runs.select("sig", "node", "above").join(sizes.where(F.col("size") > limits.run).select("sig", "head"), "sig")
        stuck = hot.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("above").alias("above")).where("k >= above").select("node")  # no d + 1 groups of other signatures
        hot = hot.join(stuck, "node", "left_semi")
        heads = hot.groupBy("sig").agg(F.min("node").alias("b"))
        out = out.unionByName(hot.select("sig", F.col("node").alias("a")).join(heads, "sig").where("a <> b").select("a", "b"))
    return stored(out.distinct(), "ties")


def run_trees(batches: Iterator[pa.RecordBatch], share: Share) -> Iterator[pa.RecordBatch]:
    """One R-tree for each signature: (a, b) span the components of what its bound leaves."""
    at, nodes, sizes, points = None, [], [], []

    def searched() -> list[tuple[bytes, bytes]]:
        return [(nodes[i], nodes[j]) for i, j in bound_forest(np.stack(points), np.array(sizes), share)] if len(nodes) > 1 else []

    def made(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            c, out = batch.slice(i, 1024).to_pydict(), []
            for sig, node, n, p in zip(c["sig"], c["node"], c["n"], c["p"], strict=True):
                if sig != at:
                    out += searched()
                    at, nodes, sizes, points = sig, [], [], []
                nodes.append(node)
                sizes.append(n)
                points.append(np.frombuffer(p, "<u2"))
            if out:
                yield made(out)
    if out := searched():
        yield made(out)


def bound_forest(points: np.ndarray, sizes: np.ndarray, share: Share = SHARE) -> Iterator[tuple[int, int]]:
    """Pairs that span the components of all pairs within the bound."""
    tree, label = CountTree(points, sizes, share), np.arange(len(sizes))
    for q in range(len(sizes)):
        found = tree.search(points[q], int(sizes[q]))
        found = found[label[found] != label[q]]
        if len(found):
            others, one = np.unique(label[found], return_index=True)
            yield from ((q, int(found[i])) for i in one)
            label[np.isin(label, others)] = label[q]


def links(docs: DataFrame, table: DataFrame, words: int = WORDS, share: Share = SHARE, limits: Limits = LIMITS) -> DataFrame:
    """(a, b): digests of linked different sets, spanning every component. A set in two size classes may be in two trees."""
    spark = docs.sparkSession
    trees = components(ties(table, share, limits))
    known = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")  # so that rows without an id are found again
    nodes = table.where("sig is not null").select(F.explode("pts.node").alias("node"), "key").distinct()
    one = table.where("n > 0").groupBy("key").agg(F.min(F.struct(known, "text_key")).alias("r"), F.first("n").alias("n"))
    members = stored(trees.join(nodes, "node").select("root", "key").join(one, "key").select("root", "key", "n", "r.doc_id", "r.text_key"), "members")
    weight = members.groupBy("root").agg(F.sum("n").alias("w"))
    total, biggest = weight.agg(F.sum("w"), F.max("w")).first()
    if not total:
        return spark.createDataFrame([], "a binary, b binary")
    source = docs.select(known, F.xxhash64("text").alias("text_key"), "text")

    def sent(rows: DataFrame) -> DataFrame:
        """A side that is joined with texts: broadcast up to MOST_SENT rows, else the hashed side of a shuffle."""
        return F.broadcast(rows) if rows.count() <= MOST_SENT else rows.hint("shuffle_hash")

    def searched(texts: DataFrame, on: list[str], tasks: DataFrame, volume: int) -> DataFrame:
        """tasks: root, i, j, side, key, comp and `on`, by which texts are found."""
        dealt = texts.join(sent(tasks), on).select("root", "i", "j", "side", "key", "comp", "text")
        dealt = dealt.repartition(parts_for(spark, volume, limits.tree), "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "key")
        return stored(dealt.mapInArrow(lambda batches: search_trees(batches, words, share), "a binary, b binary").distinct(), "links")

    small = members.join(weight.where(F.col("w") <= limits.tree).select("root"), "root")
    none = (F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"))
    found = searched(source, ["doc_id", "text_key"], small.select("root", *none, "key", F.col("key").alias("comp"), "doc_id", "text_key"), total)
    if biggest <= limits.tree:
        return found
    big = stored(members.join(weight.where(F.col("w") > limits.tree).select("root"), "root"), "big")
    texts = stored(source.join(sent(big.select("doc_id", "text_key", "key").distinct()), ["doc_id", "text_key"]).select("key", "text"), "texts", "zstd")
    big = big.select("root", "key", "n")
    every, label, before = [found], big.withColumn("comp", F.col("key")), None
    for turn in range(64):  # one set of each component in parts of their own, while components merge
        heads = label.groupBy("root", "comp").agg(F.min(F.struct("key", "n")).alias("h")).select("root", "comp", "h.key", "h.n")
        size = heads.groupBy("root").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        comps, volume = size.agg(F.sum("comps"), F.sum("w")).first()
        if not comps or (before and comps > 0.8 * before):
            break
        before = comps
        part = F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("w") / limits.tree)).cast("int")
        every.append(searched(texts, ["key"], heads.join(size, "root").select("root", part.alias("i"), part.alias("j"), F.lit(-1).alias("side"), "key", "comp"), volume))
        roots = components(reduce(DataFrame.unionByName, every)).select(F.col("node").alias("key"), F.col("root").alias("comp"))
        label = stored(big.join(roots, "key", "left").select("root", "key", "n", F.coalesce("comp", "key").alias("comp")), "label")
    # All sets outside a root's largest component are compared with all others.
    groups = label.groupBy("root", "comp").agg(F.sum("n").alias("w"))
    top = groups.groupBy("root").agg(F.max_by("comp", F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"), (F.sum("w") - F.max("w")).alias("rest")).where("rest > 0")
    half = limits.tree // 2 or 1
    left = label.join(top, "root").withColumns({"parts": F.ceil(F.col("w") / half).cast("int"), "blocks": F.ceil(F.col("rest") / half).cast("int")})
    own, block = F.pmod(F.xxhash64("key"), "parts").cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int")
    inside = left.select("root", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "key", "comp", "n")
    asking = left.where("comp <> top").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), block.alias("j"), F.lit(1).alias("side"), "key", "comp", "n")
    tasks = inside.unionByName(asking)
    if volume := tasks.agg(F.sum("n")).first()[0]:
        every.append(searched(texts, ["key"], tasks.drop("n"), volume))
    return reduce(DataFrame.unionByName, every)


def search_trees(batches: Iterator[pa.RecordBatch], words: int, share: Share) -> Iterator[pa.RecordBatch]:
    """One R-tree for each run of rows with equal (root, i, j). Side 1 is compared with side 0; rows of side -1 among themselves."""
    at, keys, sets, sides, comps = None, [], [], [], []
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def done() -> pa.RecordBatch | None:
        side = np.array(sides) if sides[0] >= 0 else None
        found = list(forest(sets, side, share, np.unique(comps, return_inverse=True)[1]))
        if found:
            return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], schema=schema)
        return None

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            c = batch.slice(i, 256).to_pydict()
            for root, p, q, side, key, comp, text in zip(*(c[k] for k in ("root", "i", "j", "side", "key", "comp", "text")), strict=True):
                if (root, p, q) != at:
                    if len(sets) > 1 and (out := done()):
                        yield out
                    at, keys, sets, sides, comps = (root, p, q), [], [], [], []
                if not keys or (keys[-1], sides[-1]) != (key, side):  # equal rows follow each other
                    keys.append(key)
                    sets.append(shingles(text, words))
                    sides.append(side)
                    comps.append(comp)
    if len(sets) > 1 and (out := done()):
        yield out


def join(docs: DataFrame, words: int = WORDS, share: Share = SHARE, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every document, and `first`: whether its (doc_id, text_key) is the smallest of its
    component, rows without an id last."""
    table = profile(docs, words, share)
    roots = components(links(docs, table, words, share, limits)).withColumnRenamed("node", "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = table.where("n > 0").groupBy("key").agg(F.min(order).alias("least"))
    rooted = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("least"))
    known = stored(rooted.drop("least").join(ids, "root").select("key", "least"), "components")
    rows = table.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "key").join(known, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("least") == order, F.lit(True)).alias("first"))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs, WORDS, SHARE).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = COPY_WORDS, share: Share = COPY_SHARE, limits: Limits = LIMITS) -> DataFrame:
    """A pipeline stage: of each component the text with the smallest doc_id stays (at a tie, as of a repeated id, the one with the smallest hash); documents
    without words stay. A text is known by its doc_id and its hash, so the texts of a repeated id are judged one by one; rows equal in both stay or go together."""
    number, text = fresh(docs, "_number", "_key")
    here = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    gone = join(docs, words, share, limits).where("not first").select(here("doc_id").alias(number), F.col("text_key").alias(text)).distinct()
    return docs.withColumns({number: here("doc_id"), text: F.xxhash64("text")}).join(gone, [number, text], "left_anti").select(*docs.columns)


def plain(rows: list[tuple[int, str | None]], words: int = WORDS, share: Share = SHARE) -> list[tuple[int, int, int]]:
    """For tests: the same by brute force on the words themselves."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = [r[0] for r in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and min(len(a), len(b)) * share[1] >= share[0] * max(len(a), len(b)) and share[1] * len(a & b) >= share[0] * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return [(r[0], len(s), v) for r, s, v in zip(rows, sets, label, strict=True)]
