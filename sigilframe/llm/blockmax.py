"""Ranked lexical search by Block-Max MaxScore over an index in shards of documents.

`build` cuts the documents, as they are scanned, into shards of bounded size and writes one row for each term of a shard: its postings, ordered by doc_id, in blocks of BLOCK,
each compressed by itself (gaps and counts as variable-length bytes), and for each block its last document and what bounds its scores: the least length of a document with
one, two, three, and more occurrences, and the most occurrences. One more row a shard has its documents' ids and lengths. Nothing is shuffled; the numbers that scores need
(documents, all terms, documents of a term) are sums over the shards, taken when a search begins.

`search` joins the terms of the queries to the index and runs one task for each shard and block of queries. For each query the terms stand in order of their greatest possible score
in the shard; the first ones whose bounds together don't exceed the k-th score so far are non-essential: a document with these alone can't enter. Documents of the
essential lists are scored there; the block maxima of the non-essential lists, looked up without decompressing, reject those that can't reach the k-th score, and only the blocks that hold
what is left are decompressed, list by list from the greatest bound on, with another look at the bound after each. A shard's documents are met in windows in order of doc_id, so
equal scores are settled by the order. Each shard's k best are merged by a window with a limit, which Spark also applies before its shuffle.

Scores are integers: with N documents that hold a term, L terms in all, n of a document, m = 10 + (90 n N) div L, and a term of weight w counts
w * ((10^9 tf) div (1000 tf + 8 m)). A shard holds SHARD_BYTES of text or one longer document, so a task's memory is bounded; queries are dealt in blocks of QUERY_TERMS
terms. Nothing grows on the driver but the three sums.

Nulls and odd rows: a null text, or one without a term, takes no part; null doc_ids come last among equal scores; repeated rows are documents of their own. Queries
of one item_id, null included, are one query with the terms of all; without terms it finds nothing. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fields, parts_for, stored

BLOCK = 128
SHARD_BYTES = 24 << 20
K = 10
QUERY_TERMS = 100_000
FIRST, WIDEST = 512, 8192  # documents of the first window, and of the widest
NAMED = 3  # counts of a term in a document whose least length a block keeps; one more is for all above
INDEX = "shard long, term binary, df int, total long, lasts binary, starts binary, bounds binary, data binary, doc_ids array<long>, lengths array<int>"

# What a term is made of (ASCII letters and digits, all bytes of other characters), A-Z as a-z.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text's UTF-8 bytes, in order, repeats included."""
    return raw.translate(_TABLE).split()


def varied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, all but a number's last marked; and where each begins, with the end."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        more = np.flatnonzero(size > k)
        if len(more):
            out[at[more] + k] = (values[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, at


def numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers that `varied` wrote."""
    ends = np.flatnonzero(raw < 128)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


class Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.words = defaultdict(count().__next__)
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, raw: bytes) -> None:
        found = terms(raw)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.tokens.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
            self.size += len(raw)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        n = np.array(self.lengths, np.int64)[order]
        head = {"shard": shard, "df": len(n), "total": int(n.sum()), "doc_ids": [self.ids[i] for i in order], "lengths": n.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array([head.get(c)], t) for c, t in zip(names, types, strict=True)], names=names)
        key = np.concatenate([self.tokens[i].astype(np.int64) * len(n) + k for k, i in enumerate(order)])
        self.tokens.clear()
        key, tf = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, len(n))
        t0 = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(t0, append=len(term))
        before = np.concatenate([[-1], doc[:-1]])
        before[t0] = -1
        raw, at = varied(np.stack([doc - before - 1, tf - 1], 1).ravel())
        blocks = -(-df // BLOCK)
        b0 = np.repeat(t0 - (np.cumsum(blocks) - blocks) * BLOCK, blocks) + np.arange(blocks.sum()) * BLOCK
        b1 = np.append(b0[1:], len(term))
        bounds = np.empty((len(b0), NAMED + 2), np.int32)
        long, none = n[doc], int(n.max()) + 1
        for k in range(NAMED + 1):
            least = np.minimum.reduceat(np.where(tf == k + 1 if k < NAMED else tf > NAMED, long, none), b0)
            bounds[:, k] = np.where(least == none, 0, least)
        bounds[:, -1] = np.maximum.reduceat(tf, b0)
        words = list(self.words)
        cut = np.concatenate([[0], np.cumsum(blocks)])

        def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

        columns = {
            "shard": pa.array(np.full(len(df), shard)), "term": pa.array(words, pa.binary()), "df": pa.array(df.astype(np.int32)),
            "lasts": binary(doc[b1 - 1].astype(np.int32), cut * 4), "starts": binary((at[2 * b0] - np.repeat(at[2 * t0], blocks)).astype(np.int32), cut * 4),
            "bounds": binary(bounds, cut * 4 * (NAMED + 2)), "data": binary(raw, np.append(at[2 * t0], at[-1])),
        }
        whole = pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(df), t) for c, t in zip(names, types, strict=True)], names=names)
        for i in range(0, len(df), 16384):
            yield whole.slice(i, 16384)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of an index (INDEX) over all documents; write them as Parquet and search what is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = count(TaskContext.get().partitionId() << 24), Shard()
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if raw.is_valid:
                    shard.add(i, raw.as_py())
                if shard.size >= shard_bytes:
                    yield from shard.rows(next(number))
                    shard = Shard()
        if shard.ids:
            yield from shard.rows(next(number))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, INDEX)


class Postings:
    """One term's list in a shard; blocks are decompressed when they are needed, and kept while the shard is searched."""

    opened = 0  # blocks, of all lists; for tests

    def __init__(self, row: dict, shard_m: np.ndarray, most: np.ndarray):
        self.w, self.m = row["w"], shard_m
        self.lasts, self.starts = np.frombuffer(row["lasts"], np.int32), np.append(np.frombuffer(row["starts"], np.int32), len(row["data"]))
        self.raw = np.frombuffer(row["data"], np.uint8)
        kept = np.frombuffer(row["bounds"], np.int32).reshape(-1, NAMED + 2).astype(np.int64)
        tf = np.concatenate([np.broadcast_to(np.arange(1, NAMED + 1), (len(kept), NAMED)), kept[:, -1:]], 1)
        self.block_most = self.w * np.where(kept[:, :-1] > 0, _impact(tf, most[kept[:, :-1]]), 0).max(1)  # of each block
        self.most = int(self.block_most.max())
        self.docs, self.scores = np.zeros(row["df"], np.int64), np.zeros(row["df"], np.int64)
        self.closed = np.ones(len(self.lasts), bool)

    def open(self, blocks: np.ndarray) -> None:
        """Decompresses those of the blocks (in order) that weren't yet, neighbours together."""
        new = blocks[self.closed[blocks]]
        for run in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(new) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            found = numbers(self.raw[self.starts[a] : self.starts[b]])
            docs = np.cumsum(found[0::2] + 1) + (self.lasts[a - 1] if a else -1)
            at = slice(a * BLOCK, a * BLOCK + len(docs))
            self.docs[at], self.scores[at] = docs, self.w * _impact(found[1::2] + 1, self.m[docs])
            self.closed[a:b] = False
            Postings.opened += b - a

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from lo up to hi, and their scores for the term."""
        a, b = np.searchsorted(self.lasts, (lo, hi - 1))
        b = min(int(b) + 1, len(self.lasts))
        if a >= b:
            return self.docs[:0], self.scores[:0]
        self.open(np.arange(a, b))
        docs, scores = self.docs[a * BLOCK : b * BLOCK], self.scores[a * BLOCK : b * BLOCK]
        x, y = np.searchsorted(docs, (lo, hi))
        return docs[x:y], scores[x:y]

    def block_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that would hold each document, and the most it can score there (0 behind the last)."""
        at = np.searchsorted(self.lasts, docs)
        there = at < len(self.lasts)
        return at, np.where(there, self.block_most[np.minimum(at, len(self.lasts) - 1)], 0)

    def of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The scores of documents in the blocks that would hold them, which are opened."""
        out, there = np.zeros(len(docs), np.int64), np.flatnonzero(blocks < len(self.lasts))
        wanted = np.unique(blocks[there])
        self.open(wanted)
        if len(wanted):
            rows = (wanted[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < len(self.docs)]
            at = np.searchsorted(self.docs[rows], docs[there])
            at = rows[np.minimum(at, len(rows) - 1)]
            out[there] = np.where(self.docs[at] == docs[there], self.scores[at], 0)
        return out


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best(lists: list[Postings], n_docs: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for one query and their scores, best first; equal scores in order of the documents."""
    lists = sorted(lists, key=lambda t: t.most)
    bound = np.concatenate([[0], np.cumsum([t.most for t in lists])])  # of the first lists together
    top_docs, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lo, width = 0, FIRST
    while lo < n_docs:
        hi = min(lo + width, n_docs)
        extra = int(np.searchsorted(bound, least, "right")) - 1  # how many lists are non-essential: together they don't exceed the k-th score
        if extra == len(lists):
            break
        got = np.zeros(hi - lo, np.int64)
        for t in lists[extra:]:
            docs, scores = t.between(lo, hi)
            got[docs - lo] += scores
        docs = np.flatnonzero(got)
        docs = docs[got[docs] + bound[extra] > least]
        scores, docs = got[docs], docs + lo
        if extra and len(docs):
            where, most = map(list, zip(*(t.block_of(docs) for t in lists[:extra]), strict=True))
            rest = np.sum(most, axis=0)
            for j in range(extra - 1, -1, -1):
                alive = np.flatnonzero(scores + rest > least)
                docs, scores, rest = docs[alive], scores[alive], rest[alive]
                where, most = [x[alive] for x in where[: j + 1]], [x[alive] for x in most[: j + 1]]
                if not len(docs):
                    break
                scores, rest = scores + lists[j].of(docs, where[j]), rest - most[j]
        enter = scores > least
        if enter.any():
            top_docs, top_scores = np.concatenate([top_docs, docs[enter]]), np.concatenate([top_scores, scores[enter]])
            order = np.lexsort((top_docs, -top_scores))[:k]
            top_docs, top_scores = top_docs[order], top_scores[order]
            least = int(top_scores[-1]) if len(top_scores) == k else 0
        lo, width = hi, min(width * 4, WIDEST)
    return top_docs, top_scores


def search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the k documents of the highest scores above 0, equal ones by doc_id."""
    spark = index.sparkSession
    ids = queries.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    n, total = index.where("term is null").agg(F.sum("df"), F.sum("total")).first()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms(t or b""))) for t in b.column(1).to_pylist()], pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = ids.mapInArrow(split, fields(ids, ["item_id"], "terms array<binary>"))
    asked = stored(asked.select("item_id", F.explode("terms").alias("term")).distinct(), "query_terms")
    parts = -(-asked.count() // query_terms)
    if not n or not parts:
        return spark.createDataFrame([], fields(ids, ["item_id"], "rank int, doc_id long, score long"))
    df = index.where("term is not null").select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    wanted = asked.join(df.select("term", weight), "term").groupBy("term", "w", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("block")).agg(F.collect_list(F.struct("item_id")).alias("items"))
    wanted = stored(wanted, "weights")  # so that Spark knows its size when it joins
    lists = ["shard", "term", "df", "lasts", "starts", "bounds", "data"]
    held = index.where("term is not null").select(lists).join(wanted, "term").withColumns({"doc_ids": F.lit(None).cast("array<long>"), "lengths": F.lit(None).cast("array<int>")})
    heads = index.where("term is null").select(*lists, F.lit(None).cast("long").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"), F.lit(None).cast(wanted.schema["items"].dataType).alias("items"), "doc_ids", "lengths")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        longest = max(head["lengths"])
        m = np.arange(longest + 1, dtype=np.int64 if 90 * longest * n < 1 << 63 else object)
        m = (10 + 90 * m * n // total).astype(np.int64)  # by length
        of_doc = m[np.array(head["lengths"])]
        asked: dict = {}
        for r in rows:
            if r["term"] is not None and r["w"] > 0:
                p = Postings(r, of_doc, m)
                for item in r["items"]:
                    asked.setdefault(item["item_id"], []).append(p)
        found = [(item, head["doc_ids"][d], s) for item, ps in asked.items() for d, s in zip(*(x.tolist() for x in best(ps, len(of_doc), k)), strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (table.schema.field("items").type.value_type.field(0).type, pa.int64(), pa.int64()), strict=True)], names=["item_id", "doc_id", "score"])

    both = held.select(heads.columns).unionByName(heads)
    top = both.repartition(parts_for(spark, parts, 1), "shard", "block").groupBy("shard", "block").applyInArrow(run, fields(ids, ["item_id"], "doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(stored(build(docs), "lexical_index"), items)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS words FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN g USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
