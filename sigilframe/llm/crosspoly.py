"""Nearest neighbours by cross-polytope hashing.

A vector, scaled to unit length, is turned by three rounds of random signs and fast Hadamard transforms; its hash is the signed axis it lies nearest
to, of the first AXES. A table's bucket joins the hashes of TURNS = 2 such pseudo-rotations, so a table has (2 * AXES) ** 2 buckets at most, however
long the vectors are. Where lengths differ, vectors get one more component that makes them equally long, so that the largest inner product is the
smallest angle. A query probes a table's buckets in order of the summed projections on their axes, until these hold a budget of vectors; the candidates
of all tables are ranked by exact inner products in double precision.

The budget is fitted: FIT vectors (those of the lowest hashes of their ids, where there are as many) are searched by brute force, and it is the least one
with which the share RECALL of their K nearest is found. So it is small where vectors have near neighbours, and a large share of
all where they have none to speak of; no size of table is treated otherwise.

Buckets' sizes (TABLES times the number of buckets at most, a constant) tell how buckets are grouped into blocks of about BLOCK vectors; a larger
bucket is split over several blocks. A block is loaded by one task, queries stream past it, and only the best of each
leave it. Of equal vectors, only the smallest K + 1 ids can be among anyone's K nearest, so the others are left out before anything is
dealt, exactly; equal queries are searched once.

Nulls and odd rows: vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those of another length than the most common
(the longer at a tie), nor rows with a null id; ties go to the smaller id; of rows that repeat an id with its vector one counts; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, stored

K = 20
TABLES = 10
TURNS = 2
AXES = 64
RECALL = 0.96
FIT = 128
BLOCK = 50_000
BEST = 48  # axes of each turn that a query looks at first


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Turner:
    """The pseudo-rotations of all tables for vectors of `dim` components; top: the greatest length, where lengths differ."""

    def __init__(self, dim: int, top: float | None = None, seed: int = 17):
        self.top = top
        self.size = 1 << max(1, (dim + (top is not None) - 1).bit_length())
        self.axes = min(AXES, self.size)
        self.buckets_each = (2 * self.axes) ** TURNS
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES, TURNS, 3, self.size)).astype(np.float32)

    def padded(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        length = np.linalg.norm(x, axis=1)
        out = np.zeros((len(x), self.size), np.float32)
        if self.top is None or query:
            out[:, : x.shape[1]] = x / length[:, None]
        else:
            out[:, : x.shape[1]] = x / self.top
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (length / self.top) ** 2))
        return out

    def turned(self, x: np.ndarray, table: int, turn: int) -> np.ndarray:
        for s in self.signs[table, turn]:
            x = hadamard(x * s)
        return x[:, : self.axes]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables)"""
        x = self.padded(x, False)
        out = np.zeros((len(x), TABLES), np.int64)
        for t in range(TABLES):
            for r in range(TURNS):
                z = self.turned(x, t, r)
                axis = np.abs(z).argmax(1)
                out[:, t] = out[:, t] * 2 * self.axes + axis * 2 + (z[np.arange(len(z)), axis] > 0)
        return out

    def scores(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Of padded queries, the projections on all signed axes of each turn."""
        out = []
        for r in range(TURNS):
            z = self.turned(x, table, r)
            s = np.empty((len(x), 2 * self.axes), np.float32)
            s[:, 0::2], s[:, 1::2] = -z, z
            out.append(s)
        return out

    def probes(self, x: np.ndarray, counts: np.ndarray, share: float) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each table, each query's buckets in order until they hold `share` vectors. counts: (tables, buckets)."""
        x = self.padded(x, True)
        for t in range(TABLES):
            scores = self.scores(x, t)
            found: list[np.ndarray | None] = [None] * len(x)
            width, rest = min(BEST, 2 * self.axes), np.arange(len(x))
            while len(rest):
                best = [np.argsort(-s[rest], axis=1, kind="stable")[:, :width] for s in scores]
                one, two = (np.take_along_axis(s[rest], b, 1) for s, b in zip(scores, best, strict=True))
                total = one[:, :, None] + two[:, None, :]
                code = (best[0][:, :, None] * 2 * self.axes + best[1][:, None, :]).reshape(len(rest), -1)
                code = np.take_along_axis(code, np.argsort(-total.reshape(len(rest), -1), axis=1, kind="stable"), 1)
                held = np.cumsum(counts[t][code], axis=1)
                enough = held[:, -1] >= share
                last = np.where(enough, (held >= share).argmax(1), code.shape[1] - 1)
                whole = width == 2 * self.axes
                for i in np.flatnonzero(enough | whole):
                    c = code[i, : last[i] + 1]
                    found[rest[i]] = c[counts[t][c] > 0]
                rest = rest[~(enough | whole)]
                width = min(2 * width, 2 * self.axes)
            yield t, found

    def needed(self, x: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of one query and its neighbours' codes (neighbours, tables): how many vectors of a table the query must be given to meet each neighbour in some table."""
        x, least = self.padded(x[None], True), np.full(len(codes), np.iinfo(np.int64).max)
        for t in range(TABLES):
            one, two = self.scores(x, t)
            order = np.argsort(-(one[0][:, None] + two[0][None, :]).ravel(), kind="stable")
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(counts[t][order]) - counts[t][order]
            least = np.minimum(least, before[codes[:, t]] + 1)
        return least


def taking_part(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector of rows that can take part."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    return v.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))


def shape_of(v: DataFrame) -> tuple[int, float | None]:
    """The most common dimension, and the greatest length, or None if all lengths agree; in one pass."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = v.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("low"), F.max(length).alias("high"))
    r = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not r:
        return 0, None
    return r[0].d, None if r[0].low > 0.999 * r[0].high else r[0].high


def of_dimension(v: DataFrame, dim: int) -> DataFrame:
    """Adds h1, h2, hashes of the vector."""
    return v.where(F.size("vector") == dim).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.reverse("vector"), F.lit(1)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fitted(table: DataFrame, dim: int, kind: type, counts: np.ndarray, turner: Turner, k: int, recall: float, fit: int) -> int:
    """The budget of vectors a table. A bounded sample is compared with every row; `fit` rows and their k nearest reach the driver."""
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).select("vec_id", "raw").collect()
    ids = np.array([r.vec_id for r in sample], np.int64)
    x = np.stack([np.frombuffer(r.raw, kind) for r in sample]).astype(np.float64)
    sent = table.sparkSession.sparkContext.broadcast((ids, x))  # a sample of a constant size

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, TABLES), np.int64))] * len(ids)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                theirs = part.column(0).to_numpy()
                codes = part.column(2).flatten().to_numpy().reshape(-1, TABLES)
                y = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                for q, score in enumerate(x @ y.T):
                    near = np.argpartition(-score, k)[: k + 1] if len(score) > k + 1 else np.arange(len(score))
                    near = near[theirs[near] != ids[q]]
                    s, v, c = (np.concatenate([a, new[near]]) for a, new in zip(best[q], (score, theirs, codes), strict=True))
                    order = np.lexsort((v, -s))[:k]
                    best[q] = s[order], v[order], c[order]
        for q, (s, v, c) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), q, np.int32)), pa.array(v), pa.array(s), pa.array(list(c), pa.list_(pa.int64()))], names=["q", "vec_id", "score", "codes"])

    found = table.select("vec_id", "raw", "codes").mapInArrow(compare, "q int, vec_id long, score double, codes array<long>")
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k)
    codes: dict[int, list] = {}
    for r in top.select("q", "codes").collect():  # fit times k at most
        codes.setdefault(r.q, []).append(r.codes)
    needed = [turner.needed(x[q], np.array(c, np.int64), counts) for q, c in codes.items()]
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) if needed else 1


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL, fit: int = FIT) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row (of the same columns) the k nearest found among all other vectors."""
    spark = vectors.sparkSession
    every = taking_part(vectors, vec_id, vector)
    dim, top = shape_of(every)
    kind = np.float64 if "double" in vectors.schema[vector].dataType.simpleString() else np.float32
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    # Of equal vectors the smallest k + 1 ids; Spark cuts the groups off before the shuffle.
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = of_dimension(every, dim).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1).select("vec_id", "vector")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turner = Turner(dim, top)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = matrix(part.column(1), dim)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(list(turner.buckets(x)), pa.list_(pa.int64()))], names=["vec_id", "raw", "codes"])

    table = stored(few.mapInArrow(hashed, "vec_id long, raw binary, codes array<long>"), "hashed")
    turner = Turner(dim, top)
    counts = np.zeros((TABLES, turner.buckets_each), np.int64)
    for r in table.select(F.posexplode("codes").alias("t", "c")).groupBy("t", "c").count().toLocalIterator():  # TABLES x buckets at most
        counts[r.t, r.c] = r["count"]
    share = max(k + 1, fitted(table, dim, kind, counts, turner, k, recall, fit))  # so that k others are found wherever there are as many
    first, salts, blocks = plan_blocks(counts)
    plan = spark.sparkContext.broadcast((counts, first, salts))  # of a constant size

    def deal_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, salts = plan.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids = part.column(0).to_numpy()
                codes = np.array(part.column(2).to_pylist(), np.int64).reshape(-1, TABLES)
                t = np.arange(TABLES)[None, :]
                block = first[t, codes] + (ids[:, None] * 0x9E3779B1 >> 8) % salts[t, codes]
                rows = np.repeat(np.arange(len(ids)), TABLES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ravel()), pa.array(np.zeros(block.size, np.int32)), pa.array(ids[rows]), pa.array(np.zeros(block.size, np.int64)), pa.array(codes.reshape(-1, 1).tolist(), pa.list_(pa.int64())), part.column(1).take(pa.array(rows))],
                    names=["block", "kind", "a", "b", "codes", "raw"],
                )

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, salts = plan.value
        turner = Turner(dim, top)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                x, h1, h2 = matrix(part.column(2), dim), part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[tuple] = []
                for t, found in turner.probes(x, counts, share):
                    for q, codes in enumerate(found):
                        last = first[t, codes] + salts[t, codes]
                        reached: dict[int, list[int]] = {}
                        for c, lo, hi in zip(codes.tolist(), first[t, codes].tolist(), last.tolist(), strict=True):
                            for block in range(lo, hi):
                                reached.setdefault(block, []).append(c)
                        rows += [(block, 1, h1[q], h2[q], cs, x[q].astype(kind).tobytes()) for block, cs in reached.items()]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["block", "kind", "a", "b", "codes", "raw"])

    dealt = "block long, kind int, a long, b long, codes array<long>, raw binary"
    asked = of_dimension(taking_part(queries, vec_id, vector), dim)
    distinct = asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).select("h1", "h2", "vector")
    both = table.mapInArrow(deal_vectors, dealt).unionByName(distinct.mapInArrow(deal_queries, dealt))
    both = both.repartition(parts_for(spark, blocks, 1), "block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, waiting = None, None, []
        for b in batches:
            out: list[tuple] = []
            c = b.to_pydict()
            for where, what, one, two, codes, raw in zip(c["block"], c["kind"], c["a"], c["b"], c["codes"], c["raw"], strict=True):
                if where != at:
                    at, block, waiting = where, None, []
                if what == 0:
                    waiting.append((codes[0], one, raw))
                else:
                    if block is None:
                        block, waiting = Block(waiting, kind), []
                    ids, scores = block.best(np.frombuffer(raw, kind).astype(np.float64), codes, k + 1)
                    if len(ids):
                        out.append((one, two, ids.tolist(), scores.tolist()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], names=["h1", "h2", "ids", "scores"])

    found = both.mapInArrow(search, "h1 long, h2 long, ids array<long>, scores array<double>")
    # A vector found in several tables has the same score and rank in all; Spark cuts each query's rows off before the shuffle.
    near = found.select("h1", "h2", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("h1", "h2", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    near = near.withColumn("_r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    best = near.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))  # k + 1 at most
    ids = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = ids.join(best, ["h1", "h2"]).select("query_id", F.posexplode(own).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def plan_blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each bucket; buckets of a table share blocks in order, a bucket above BLOCK has blocks of its own."""
    first, salts, block = np.zeros_like(counts), np.ones_like(counts), 0
    for t in range(len(counts)):
        held = 0
        for c in np.flatnonzero(counts[t]):
            n = int(counts[t, c])
            if n > BLOCK:
                block += held > 0
                first[t, c], salts[t, c] = block, -(-n // BLOCK)
                block, held = block + int(salts[t, c]), 0
                continue
            if held + n > BLOCK:
                block, held = block + 1, 0
            first[t, c], held = block, held + n
        block += held > 0
    return first, salts, block


class Block:
    """Vectors of some buckets, in order of bucket."""

    def __init__(self, rows: list[tuple[int, int, bytes]], kind: type):
        code = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(code, kind="stable")
        self.ids = np.array([r[1] for r in rows], np.int64)[order]
        self.x = np.frombuffer(b"".join([rows[i][2] for i in order]), kind).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 0))
        self.codes, start = np.unique(code[order], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(rows))

    def best(self, q: np.ndarray, codes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return self.ids, np.zeros(0)
        codes = np.sort(np.array(codes, np.int64))
        at = np.searchsorted(self.codes, codes)
        at = at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes)]
        size = self.end[at] - self.start[at]
        rows = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        if not len(rows):
            return self.ids[:0], np.zeros(0)
        x = self.x[rows]
        rough = x @ q
        if len(rows) > k:
            near = rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())
            rows, x = rows[near], x[near]
        score = (x * q).sum(1)  # row by row in one order, so equal vectors score equally
        ids = self.ids[rows]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def digest(vectors: DataFrame, every: int = 20) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0))
