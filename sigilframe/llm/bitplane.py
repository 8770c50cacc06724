"""Token ids in binary files of shuffled planes.

A segment holds whole documents in order. Its ids are cut into blocks of BLOCK; a block is transposed into four byte
planes (or 32 bit planes), so that the high bytes, which hardly change, stand together; each plane is compressed with
zstandard, an all-zero plane takes no bytes. A chunk index at the end gives the length of every plane, so one block is read
without the rest. Layout of a segment: MAGIC, header, document table, planes, chunk index, offset of the index. A file is a series of segments, each with its
length before it and a newline behind it, and ends in END, the number of its ids in 20 digits, and a newline.

Documents are dealt by ranges of doc_id (a hash of the text splits a repeated id) and sorted within; each task streams
its documents into segments of about SEGMENT ids and writes them to one file of the shared folder. Spark's text writer, which puts a newline behind
each value, does the writing, so files are named in the order of their ranges, a lost executor's are written again, and no half-written file is ever read; they are
read as binary files. A document's global start is the total of the files before it, and its own place in its file; only one total a file, taken from its
end, reaches the driver. Shuffle: the texts once.

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id sorts first and is kept; rows with equal
doc_id follow each other in order of their texts; an empty table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parts_for, scratch, stored
from .wordbpe import encoder, packed

MAGIC, END = b"SGPLANE1", b"SGPLEND1"
HEADER = struct.Struct("<IIQII")  # block, planes a block, ids, documents, bytes of the document table
BLOCK = 16384
SEGMENT = 1 << 20
TEXT_PER_PART = 32 << 20
FILES = 4096  # whose totals one task adds up
MOST_SENT = 1_000_000  # files whose starts are sent to all tasks


def shuffle_block(ids: np.ndarray, bits: bool) -> np.ndarray:
    """Planes of a block, one a row."""
    rows = ids.view(np.uint8).reshape(len(ids), 4)
    if not bits:
        return np.ascontiguousarray(rows.T)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)


def unshuffle_block(planes: np.ndarray, n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(planes.T).view("<u4").ravel()
    return np.ascontiguousarray(np.packbits(np.unpackbits(planes, axis=1)[:, :n].T, axis=1, bitorder="little")).view("<u4").ravel()


def write_segment(doc_ids: list[int | None], ids: list[bytes], bits: bool = False, level: int = 1) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    all_ids = np.frombuffer(b"".join(ids), "<u4")
    table = pack(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([len(x) // 4 for x in ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    )
    planes, lengths = [], []
    for i in range(0, len(all_ids), BLOCK):
        for plane in shuffle_block(all_ids[i : i + BLOCK], bits):
            data = pack(plane.tobytes()) if plane.any() else b""
            planes.append(data)
            lengths.append(len(data))
    head = MAGIC + HEADER.pack(BLOCK, 32 if bits else 4, len(all_ids), len(doc_ids), len(table)) + table
    index = np.array(lengths, "<u4").tobytes()
    return b"".join([head, *planes, index, struct.pack("<Q", len(head) + sum(lengths))])


class Segment:
    """Reads a segment; block(i) touches the bytes of that block alone."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a segment")
        self.data = data
        self.size, self.planes, self.n_ids, self.n_docs, table = HEADER.unpack_from(data, 8)
        at = 8 + HEADER.size
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + table], max_output_size=17 * self.n_docs or 1) if self.n_docs else b""
        n = 8 * self.n_docs
        none = np.frombuffer(raw[2 * n :], np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(raw[:n], "<i8"), none, strict=True)]
        self.lengths = np.frombuffer(raw[n : 2 * n], "<i8")
        index = struct.unpack_from("<Q", data, len(data) - 8)[0]
        self.index = np.frombuffer(data[index:-8], "<u4")
        self.at = at + table + np.concatenate([[0], np.cumsum(self.index, dtype=np.int64)])

    def block(self, i: int) -> np.ndarray:
        n = min(self.size, self.n_ids - i * self.size)
        width = n if self.planes == 4 else -(-n // 8)
        planes = np.zeros((self.planes, width), np.uint8)
        d = zstandard.ZstdDecompressor()
        for p in range(self.planes):
            k = i * self.planes + p
            if self.index[k]:
                planes[p] = np.frombuffer(d.decompress(self.data[self.at[k] : self.at[k + 1]], max_output_size=width), np.uint8)
        return unshuffle_block(planes, n)

    def ids(self) -> np.ndarray:
        n = -(-self.n_ids // self.size)
        return np.concatenate([self.block(i) for i in range(n)]) if n else np.zeros(0, "<u4")


def file_end(n_ids: int) -> bytes:
    return END + b"%020d" % n_ids


def segments(data: memoryview) -> Iterator[Segment]:
    """The segments of a file, without copying it."""
    at = 0
    while bytes(data[at : at + 8]) != END:
        n = struct.unpack_from("<Q", data, at)[0]
        yield Segment(data[at + 8 : at + 8 + n])
        at += n + 9  # and the newline


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, bits: bool = False, segment: int = SEGMENT) -> str:
    """Encodes all documents and writes their files; returns the folder."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    volume = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = text.repartitionByRange(parts_for(spark, volume, TEXT_PER_PART), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    end = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names, ids, held, total = encoder(tokenizer), [], [], 0, 0

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        def flush() -> pa.RecordBatch:
            nonlocal total, held
            data = write_segment(names, ids, bits)
            total, held = total + held, 0
            names.clear()
            ids.clear()
            return row(struct.pack("<Q", len(data)) + data)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                c = batch.slice(i, 256).to_pydict()
                for d, x in zip(c["doc_id"], enc.encode(c["text"]), strict=True):
                    names.append(d)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= segment:
                        yield flush()
        if names:
            yield flush()
        if total:
            yield row(file_end(total))

    path = scratch(spark, "planes")
    dealt.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("compression", "none").text(path)
    return path


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part"), "content")
    n = F.expr("cast(cast(substring(content, length(content) - 20, 20) as string) as long)")
    totals = stored(files.select("part", n.alias("n")).withColumn("range", F.floor(F.col("part") / FILES)), "totals")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.groupBy("range").agg(F.sum("n").alias("t")).select("range", F.coalesce(F.sum("t").over(before.orderBy("range")), F.lit(0)).alias("earlier"))  # a row for each FILES files
    inside = totals.select("part", "range", F.coalesce(F.sum("n").over(before.partitionBy("range").orderBy("part")), F.lit(0)).alias("inside"))
    bases = stored(inside.join(ranges, "range").select("part", (F.col("earlier") + F.col("inside")).alias("base")), "bases")
    if bases.count() <= MOST_SENT:
        bases = F.broadcast(bases)  # two numbers a file; of more files Spark decides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, data = batch.column(0)[row].as_py(), memoryview(batch.column(1)[row].as_buffer())
                for s in segments(data):
                    ends = np.cumsum(s.lengths)
                    raw, starts = memoryview(s.ids().tobytes()), ends - s.lengths
                    for i in range(0, s.n_docs, 512):
                        j = min(s.n_docs, i + 512)
                        ids = [bytes(raw[4 * a : 4 * b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[i:j], pa.int64()), pa.array(start + starts[i:j], pa.int64()), pa.array(s.lengths[i:j], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    start += s.n_ids

    return files.join(bases, "part").select("base", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    """For tests."""
    return zlib.crc32(packed(ids))
