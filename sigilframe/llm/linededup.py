"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

The index of a corpus has three tables. `postings` names every (key, doc_id) once, a key being the 128-bit hash of a line
stripped and lower-cased; `counts` has each key's number of documents and its largest doc_id; `filters` has, for each
shard of the key space, a cuckoo filter of the keys that at least `least` documents hold.

Inserting documents appends their postings, deleting documents appends the same postings with the sign -1, and either appends the new counts of
the keys it touches; tables are merged as they are read, and rewritten whole only after `runs` changes. Keys that cross the threshold enter
or leave the filter of their shard, and only filters of such shards are read and appended anew (with twice the room where they overflow); when shards
hold more than twice SHARD_KEYS keys on average, their number doubles. So a deletion undoes an insertion exactly, and a change costs what it touches.

Applying the index: each shard's filter is sent to the tasks that hold postings of its keys, and tells which of these may belong to a repeated key; so
nearly all lines drop out, and the exact counts settle the rest. Texts are shuffled once, to meet the keys they lose.

Hot lines: counts are summed before the shuffle; a shard's postings are dealt over several tasks by doc_id; the join of postings with counts leaves
splitting to Spark's skew handling.

Nulls and odd rows: a null or empty text is one empty line; a null doc_id is not indexed and keeps all its lines; rows that share a
doc_id count as one document and lose the same lines; extra columns are carried by `apply` under their own names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fields, fresh, map_rows, parts_for, stored

LEAST_DOCS = 5
LEAST_CHARS = 40
BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARD_KEYS = 50_000
POSTINGS_PER_PART = 2 << 20
RUNS = 8
SLOTS = 4


def key_of(line: str, least: int = LEAST_CHARS) -> bytes | None:
    """The key of a line that is long enough."""
    k = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(k.translate(UPPER).encode("utf-8", "replace")) if len(k) >= least else None


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets, each told from the other and the fingerprint.
    Keys are 64-bit numbers, inserted once each. A filter that gets too full doubles and is filled anew by its owner."""

    def __init__(self, keys: int = 16, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        mark = ((k >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (k & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self.jump(mark)

    def jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.int64) * 0x5BD1) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, key: int) -> bool:
        mark, one, two = (x[0] for x in self.places(np.array([key], np.uint64)))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        moved, at = [], int(one)
        for n in range(200):  # each newcomer sends one on to its other bucket
            slot = (n + int(mark)) % SLOTS
            moved.append((at, slot, self.table[at, slot]))
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self.jump(np.array([mark]))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, old in reversed(moved):
            self.table[at, slot] = old
        return False

    def delete(self, key: int) -> bool:
        mark, one, two = (x[0] for x in self.places(np.array([key], np.uint64)))
        for at in (one, two):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            f = cls(size)
            if all(f.insert(int(k)) for k in keys):
                return f
            size *= 2

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, SLOTS).astype(np.uint16))


def numbers(keys) -> np.ndarray:
    """The upper halves of 128-bit keys, by which shards and filters go."""
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, keys (distinct within the document)."""

    def make():
        def batch(c: dict) -> dict:
            return {"doc_id": c["doc_id"], "keys": [list({k for x in t.split("\n") if (k := key_of(x))}) for t in c["text"]]}

        return batch

    return map_rows(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id long, keys array<binary>", make)


@dataclass(frozen=True)
class LineIndex:
    """postings: (key, doc_id, way) and counts: (key, n_docs, last_doc, run), and filters: (shard, n, data), each a list of runs, the oldest first; of a shard the newest
    filter counts."""

    postings: tuple[DataFrame, ...]
    counts: tuple[DataFrame, ...]
    filters: tuple[DataFrame, ...]
    shards: int
    least: int
    runs: int = RUNS

    @classmethod
    def build(cls, docs: DataFrame, least: int = LEAST_DOCS, runs: int = RUNS) -> LineIndex:
        found = line_keys(docs).select(F.explode("keys").alias("key"), "doc_id").distinct()
        postings = stored(found.withColumn("way", F.lit(1)), "postings")
        counts = stored(count(postings, 0), "counts")
        frequent = counts.where(F.col("n_docs") >= least).select("key")
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        return cls((postings,), (counts,), (stored(made(frequent, shards), "filters"),), shards, least, runs)

    def held(self, within: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
        """(key, doc_id) of all postings that hold; within: only those whose `on` is in this table."""
        rows = reduce(DataFrame.unionByName, self.postings)
        if within is not None:
            rows = rows.join(within.select(on).distinct(), on, "left_semi")
        return live(rows, len(self.postings))

    def exact(self) -> DataFrame:
        """(key, n_docs, last_doc) of all keys that some document holds."""
        if len(self.counts) == 1:
            return self.counts[0].drop("run")
        newest = reduce(DataFrame.unionByName, self.counts).groupBy("key").agg(F.max_by(F.struct("n_docs", "last_doc"), "run").alias("c"))
        return newest.select("key", "c.*").where("n_docs > 0")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; lines that a document has already change nothing."""
        new = line_keys(docs).select(F.explode("keys").alias("key"), "doc_id").distinct()
        new = stored(new.join(self.held(docs), ["key", "doc_id"], "left_anti").withColumn("way", F.lit(1)), "postings")
        added = new.groupBy("key").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("last"))
        was = self.exact().join(added.select("key"), "key", "left_semi")
        now = added.join(was, "key", "left").select("key", (F.col("more") + F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.greatest("last", "last_doc").alias("last_doc"))
        return self.changed(new, now, added.select("key"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents away (a table with doc_id); their last lines come back wherever they were dropped for them."""
        gone = stored(self.held(doc_ids).withColumn("way", F.lit(-1)), "postings")
        touched = gone.select("key").distinct()
        left = self.held(touched, "key").join(gone.select("key", "doc_id"), ["key", "doc_id"], "left_anti")
        now = touched.join(count(left, 0).drop("run"), "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "last_doc")
        return self.changed(gone, now, touched)

    def changed(self, postings: DataFrame, counts: DataFrame, touched: DataFrame) -> LineIndex:
        run = stored(counts.withColumn("run", F.lit(len(self.counts))), "counts")
        was = self.exact().join(touched, "key", "left_semi").where(F.col("n_docs") >= self.least).select("key")
        now = run.where(F.col("n_docs") >= self.least).select("key")
        delta = stored(now.join(was, "key", "left_anti").withColumn("way", F.lit(1)).unionByName(was.join(now, "key", "left_anti").withColumn("way", F.lit(-1))), "delta")
        out = replace(self, postings=(*self.postings, postings), counts=(*self.counts, run))
        if len(out.postings) > self.runs:
            merged = stored(out.held().withColumn("way", F.lit(1)), "postings")
            out = replace(out, postings=(merged,), counts=(stored(out.exact().withColumn("run", F.lit(0)), "counts"),))
        return out.refilled(delta)

    def frequent(self) -> DataFrame:
        return self.exact().where(F.col("n_docs") >= self.least)

    def newest(self) -> DataFrame:
        """The filter of each shard."""
        if len(self.filters) == 1:
            return self.filters[0]
        every = reduce(DataFrame.unionByName, (f.withColumn("run", F.lit(i)) for i, f in enumerate(self.filters)))
        return every.groupBy("shard").agg(F.max_by(F.struct("n", "data"), "run").alias("f")).select("shard", "f.*")

    def refilled(self, delta: DataFrame) -> LineIndex:
        """The filters after keys (way 1) have come and keys (way -1) have gone: those of the keys' shards are read, and appended as a new run; no other is."""
        moved = delta.withColumn("shard", shard_of(self.shards))
        touched = moved.select("shard").distinct()
        if touched.isEmpty():
            return self
        keys = self.newest().agg(F.sum("n")).first()[0] or 0
        if keys + delta.where("way = 1").count() > 2 * SHARD_KEYS * self.shards:
            return replace(self, filters=(stored(made(self.frequent().select("key"), 2 * self.shards), "filters"),), shards=2 * self.shards)
        was = self.newest().join(touched, "shard", "left_semi")
        fresh = stored(moved.groupBy("shard").cogroup(was.groupBy("shard")).applyInPandas(moved_filter, FILTERS), "filters")
        full = fresh.where("data is null").select("shard")  # overflowed: filled anew from all their keys
        if not full.isEmpty():
            again = self.frequent().select("key").withColumn("shard", shard_of(self.shards)).join(full, "shard", "left_semi")
            fresh = stored(fresh.where("data is not null").unionByName(again.groupBy("shard").applyInPandas(new_filter, FILTERS)), "filters")
        out = replace(self, filters=(*self.filters, fresh))
        return replace(out, filters=(stored(out.newest(), "filters"),)) if len(out.filters) > self.runs else out

    def hits(self) -> DataFrame:
        """(key, doc_id, way) of the postings that the filters let pass; each filter travels to the tasks that hold its shard."""
        filters = self.newest()
        spark = filters.sparkSession
        rows = reduce(DataFrame.unionByName, self.postings)
        parts = parts_for(spark, rows.count(), POSTINGS_PER_PART)
        salts = max(1, -(-parts // self.shards))
        nothing = F.lit(None)
        dealt = rows.select(shard_of(self.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "key", "doc_id", "way", nothing.cast("binary").alias("data"))
        sent = filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), nothing.cast("binary").alias("key"), nothing.cast("long").alias("doc_id"), nothing.cast("int").alias("way"), "data")
        both = dealt.unionByName(sent).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
        return both.select("shard", "key", "doc_id", "way", "data").mapInArrow(passing, "key binary, doc_id long, way int")

    def drops(self) -> DataFrame:
        """doc_id, keys: what each document loses."""
        maybe = live(self.hits(), len(self.postings))
        return maybe.join(self.frequent(), "key").where(F.col("doc_id") < F.col("last_doc")).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # at most a document's lines

    def apply(self, docs: DataFrame, lines: str = "_lines", dropped: str = "_dropped") -> DataFrame:
        """All columns of docs with the kept text, and the numbers of lines and of dropped lines."""
        keep = [c for c in docs.columns if c != "text"]
        raw, gone = fresh(docs, "_text", "_keys")
        drops = self.drops().select(F.col("doc_id").alias("doc_id"), F.col("keys").alias(gone)).hint("shuffle_hash")
        both = docs.join(drops, "doc_id", "left").select(*keep, F.col("text").alias(raw), gone)

        def make():
            def batch(c: dict) -> dict:
                kept = [without(t, g) for t, g in zip(c[raw], c[gone], strict=True)]
                return {"text": [k[0] for k in kept], lines: [k[1] for k in kept], dropped: [k[2] for k in kept]}

            return batch

        return map_rows(both, fields(docs, keep, f"text string, `{lines}` long, `{dropped}` long"), make, carry=keep)


def without(text: str | None, keys: list[bytes] | None) -> tuple[str | None, int, int]:
    """The text without the lines of some keys, the number of its lines, and how many went."""
    n = (text or "").count("\n") + 1
    if not keys:
        return text, n, 0
    gone = set(keys)
    kept = [x for x in text.split("\n") if key_of(x) not in gone]
    return "\n".join(kept), n, n - len(kept)


FILTERS = "shard long, n long, data binary"


def shard_of(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards).cast("long"))


def live(rows: DataFrame, runs: int) -> DataFrame:
    """(key, doc_id) of postings that hold after all runs, in each of which a posting stands once at most."""
    if runs == 1:
        return rows.select("key", "doc_id")
    return rows.groupBy("key", "doc_id").agg(F.sum("way").alias("way")).where("way > 0").select("key", "doc_id")


def count(postings: DataFrame, run: int) -> DataFrame:
    """Exact reference counts of distinct postings."""
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"), F.lit(run).alias("run"))


def made(keys: DataFrame, shards: int) -> DataFrame:
    """Filters of all keys; a shard has about SHARD_KEYS."""
    return keys.withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(new_filter, FILTERS)


def new_filter(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [group[0]], "n": [len(rows)], "data": [CuckooFilter.of(numbers(rows.key)).to_bytes()]})


def moved_filter(group: tuple, rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its changes; null data where it overflows."""
    f = CuckooFilter.from_bytes(old.data.iloc[0]) if len(old) else CuckooFilter(len(rows))
    keys, way = numbers(rows.key), rows.way.to_numpy()
    done = all([f.delete(int(k)) for k in keys[way == -1]]) and all(f.insert(int(k)) for k in keys[way == 1])
    return pd.DataFrame({"shard": [group[0]], "n": [int(old.n.sum()) + int(way.sum())], "data": [f.to_bytes() if done else None]})


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings that the filter before them, of their shard, lets pass; a shard without a filter has no repeated key."""
    at, f = None, None
    for batch in batches:
        shard, data = batch.column(0).to_numpy(), batch.column(4)
        heads = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, heads, heads + 1, [len(shard)]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if data[lo].is_valid:
                at, f = shard[lo], CuckooFilter.from_bytes(data[lo].as_py())
            elif shard[lo] == at:
                part = batch.slice(lo, hi - lo)
                yield part.select(["key", "doc_id", "way"]).filter(pa.array(f.contains(numbers(part.column(1).to_pylist()))))


def dedup(docs: DataFrame) -> DataFrame:
    """A pipeline stage: every document stays without its repeated lines; n_chars follows the new text."""
    lines, dropped = fresh(docs, "_lines", "_dropped")
    out = LineIndex.build(docs).apply(docs, lines, dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    out = LineIndex.build(docs).apply(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, i, ln, translate(trim(ln, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS m FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.doc_id, l.i, l.ln, f.k IS NOT NULL AND l.doc_id < f.m AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(ln, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def plain(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """For tests: the same by brute force."""
    held: dict[str, set] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS))
            if len(k) >= LEAST_CHARS:
                held.setdefault(k, set()).add(d)
    last = {k: max(v) for k, v in held.items() if len(v) >= LEAST_DOCS}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if last.get(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS)), d) <= d]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
