"""Packing along a space-filling curve.

A document's tokens are counted in hashed bins; the damped and normalised counts are projected to three dimensions by
fixed random signs, scaled to a cube and turned into a position on the Hilbert curve. Documents are sorted by (position,
doc_id) in ranges, so neighbours on the curve, which tend to be alike, fall into the same sequences. A task lays its documents
end to end and cuts sequences of LENGTH ids; what is left at its end is cut into sequences whose lengths are powers of two,
which need no padding. Thus there is none at all, and sequences never cross tasks.

Encoded documents are stored once in the shared folder, because sorting by ranges reads its input twice. The sort key
includes doc_id, so that many copies, which share one position, still spread over tasks. Shuffle: the ids once.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id sorts first within its position; repeated
rows are packed one after the other; texts of any length are cut as often as needed; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows, parts_for, scratch
from .wordbpe import encoder, packed

LENGTH = 2048
BINS = 256
DIMS = 3
ORDER = 10
SCALE = 6.0
IDS_PER_PART = 4 << 20

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (BINS, DIMS)).astype(np.float32) / np.sqrt(BINS)


def curve_cells(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """Each document's cell in the cube: DIMS integers of ORDER bits."""
    counts = np.stack([np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BINS) for x in ids])
    v = np.log1p(counts)
    v -= v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    z = v @ signs * SCALE
    return ((np.tanh(z) + 1) / 2 * ((1 << ORDER) - 1)).round().astype(np.int64)


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Position on the Hilbert curve through a cube of 2 ** ORDER cells a side; the cells' axes are first undone of the
    curve's rotations from the highest bit down, then Gray-coded, then interleaved."""
    x = cells.T.copy()
    n = len(x)
    for bit in range(ORDER - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(n):
            high = (x[d] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(ORDER - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(ORDER - 1, -1, -1):
        for d in range(n):
            key = key << 1 | (x[d] >> bit) & 1
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, key, n, ids (16 bits an id where the vocabulary allows) of every document, stored."""
    from .wordbpe import load

    spark = docs.sparkSession
    narrow = max(load(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16
    end = packed([end_id])

    def make():
        enc, signs = encoder(tokenizer), projection()

        def batch(c: dict) -> dict:
            ids = [np.frombuffer(x + end, "<u4") for x in enc.encode(c["text"])]
            return {"doc_id": c["doc_id"], "key": hilbert_key(curve_cells(ids, signs)).tolist(), "n": [len(x) for x in ids], "ids": [(x.astype("<u2") if narrow else x).tobytes() for x in ids]}

        return batch

    made = map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, key long, n long, ids binary", make)
    path = scratch(spark, "ids")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces: which part of which document lies where in which sequence, with its ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    table = encoded(docs, tokenizer, end_id)
    total = table.agg(F.sum("n")).first()[0] or 0
    dealt = table.repartitionByRange(parts_for(spark, total, IDS_PER_PART), "key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, room, used = 0, length, 0
        tail: list[tuple] = []  # pieces of the sequence that isn't full yet

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                c, rows = batch.slice(i, 256).to_pydict(), []
                for doc, n, raw in zip(c["doc_id"], c["n"], c["ids"], strict=True):
                    ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    at = 0
                    while at < n:
                        k = min(room, n - at)
                        tail.append((doc, at, k, n, first + number, used, ids[4 * at : 4 * (at + k)]))
                        at, room, used = at + k, room - k, used + k
                        if not room:
                            rows += tail
                            tail.clear()
                            number, room, used = number + 1, length, 0
                if rows:
                    yield made(rows)
        if tail:
            yield made(list(power_cut(tail, used, number + first)))

    return dealt.mapInArrow(run, PIECES)


def power_cut(pieces: list[tuple], total: int, number: int) -> Iterator[tuple]:
    """Deals the pieces of an unfilled sequence to sequences whose lengths are powers of two, the largest first."""
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    k, used = 0, 0
    for doc, start, n, doc_tokens, _, _, ids in pieces:
        at = 0
        while at < n:
            m = min(n - at, sizes[k] - used)
            yield doc, start + at, m, doc_tokens, number + k, used, ids[4 * at : 4 * (at + m)]
            at, used = at + m, used + m
            if used == sizes[k]:
                k, used = k + 1, 0


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, length, doc_ids, ids: at most `length` ids each, so a group is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(rows.alias("p")).select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
