"""Vector code compression: parts of integer vectors by the nearest entries of trained codebooks, searched through memoised grid cells.

Components become floor(SCALE * x); a vector is cut into PARTS equal parts, and each part's codebook is trained by rounds of assignment and integer means.
Assignment never looks at all entries: a part's coarse cell (its components divided by the cell's width, rounded down) is hashed, and the memo has, for each
cell met by this process, the entries that can be nearest somewhere in the cell's box: those whose least distance to the box isn't above
the smallest of all entries' greatest distances. Only these are evaluated exactly, so results are those of a full search; ties go to the lower
index, which the bound keeps, as it drops strictly farther entries only. The memo is bounded and begins anew when it is full.

Each round is one pass over the vectors; a task sends PARTS x entries sums, Spark adds them up, and the driver gets the totals alone: their number doesn't
depend on the table. The starting entries are the first vectors by id (a top-k). No vector is shuffled but for the sum of errors by label, which is joined back
from a stored table of its own, so Spark broadcasts it or splits a hot label by its size.

Nulls and odd rows: vectors that are null or empty, that hold a null or non-finite component or one of 2^20 or more in size, or whose length isn't that
of the first vector by id, are dropped. A length that PARTS doesn't divide is filled up with zeros. Null ids come last in order and stay in the result; repeated
rows and ids count as rows of their own, ordered by vector. With fewer vectors than entries, a codebook has fewer entries. An empty table gives no rows;
only the three columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = float(1 << 20)
SLICE = 1024  # vectors at a time
MOST_CELLS = 100_000  # of a part's memo


class Grid:
    """One part's codebook and its memo of cells."""

    def __init__(self, entries: np.ndarray, width: int | None = None):
        self.entries = entries
        # Cells about as wide as the entries lie apart: wider ones keep more entries, narrower ones are met less often.
        self.width = width or max(1, int(entries.std(axis=0).mean()))
        self.memo: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def survivors(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell that aren't dominated across its box, in order of index."""
        out = []
        for i in range(0, len(cells), 256):
            low = (cells[i : i + 256] * self.width)[:, None, :]
            below, above = low - self.entries, self.entries - (low + self.width - 1)
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2).min(1)
            out += [np.flatnonzero(x) for x in least <= most[:, None]]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry."""
        cells = np.ascontiguousarray(x // self.width)
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, cell_of = np.unique(keys, return_index=True, return_inverse=True)
        named = [keys[i].tobytes() for i in first]
        new = [k for k, name in enumerate(named) if name not in self.memo]
        if new:
            if len(self.memo) + len(new) > MOST_CELLS:
                self.memo, new = {}, list(range(len(named)))
            self.memo.update(zip([named[k] for k in new], self.survivors(cells[first[new]]), strict=True))
        found = [self.memo[name] for name in named]
        size = np.array([len(f) for f in found])
        start = np.cumsum(size) - size
        each = size[cell_of]
        begin = np.cumsum(each) - each
        row = np.repeat(np.arange(len(x)), each)
        entry = np.concatenate(found)[np.repeat(start[cell_of] - begin, each) + np.arange(each.sum())]
        self.evaluated += len(entry)
        key = ((x[row] - self.entries[entry]) ** 2).sum(1) * len(self.entries) + entry  # the lower index wins a tie
        best = np.minimum.reduceat(key, begin)
        return best % len(self.entries), best // len(self.entries)


_GRIDS: dict[str, list[Grid]] = {}


def grids(books: np.ndarray) -> list[Grid]:
    """The memos of codebooks (parts, entries, components); a process keeps those it used last."""
    name = fingerprint(books) + str(books.shape)
    if name not in _GRIDS:
        _GRIDS.clear()
        _GRIDS[name] = [Grid(b) for b in books]
    return _GRIDS[name]


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """(vectors, PARTS, components) of a column of whole lists of one length."""
    x = np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim) * SCALE).astype(np.int64)
    each = -(-dim // PARTS)
    return np.pad(x, ((0, 0), (0, each * PARTS - dim))).reshape(len(x), PARTS, each)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def trained(kept: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """Codebooks after one round: each entry becomes its parts' mean, rounded down; unused entries stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n = grids(books), np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for b in slices(batches):
            x = integers(b.column(0), dim)
            for p, grid in enumerate(own):
                at, _ = grid.nearest(x[:, p])
                np.add.at(total[p], at, x[:, p])
                n[p] += np.bincount(at, minlength=books.shape[1])
        p, e = n.nonzero()
        part, entry, place = np.repeat(p, books.shape[2]), np.repeat(e, books.shape[2]), np.tile(np.arange(books.shape[2]), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (part, entry, place, np.repeat(n[p, e], books.shape[2]), total[p, e].ravel())], names=["part", "entry", "place", "n", "total"])

    out = books.copy()
    added = kept.select("v").mapInArrow(sums, "part long, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in added.collect():  # one row a component of a codebook
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """Rows (vec_id, label, code, error), and the codebooks (parts, entries, components); None without a vector."""
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kept = src.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    order = [F.asc_nulls_last("vec_id"), "v"]
    shape = StructType([src.schema["vec_id"], src.schema["label"], *StructType.fromDDL("code string, error long").fields])
    one = kept.orderBy(*order).select(F.size("v")).first()
    if not one:
        return vectors.sparkSession.createDataFrame([], shape), None
    dim = one[0]
    kept = kept.where(F.size("v") == dim)
    first = pa.array([r.v for r in kept.orderBy(*order).limit(entries).select("v").collect()], pa.list_(pa.float64()))  # `entries` rows
    books = np.ascontiguousarray(integers(first, dim).transpose(1, 0, 2))
    for _ in range(rounds):
        books = trained(kept, books, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grids(books)
        for b in slices(batches):
            x = integers(b.column(2), dim)
            found = [grid.nearest(x[:, p]) for p, grid in enumerate(own)]
            at, error = np.stack([f[0] for f in found], 1).astype(np.uint8), sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes().hex() for a in at]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(assign, shape), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds `approximation`, the vector of the codebooks' entries in the unit of the original components (fill-up zeros included)."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(-1, PARTS)
            x = books[np.arange(PARTS)[None, :], at].reshape(len(at), -1) / SCALE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names, "approximation"])

    return codes.mapInArrow(look_up, StructType([*codes.schema.fields, StructField("approximation", StructType.fromDDL("a array<double>")["a"].dataType)]))


def digest(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors)
    if books is None:
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(coded, "codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to the entries of book{k}: key holds the squared distance and, below it, the entry."""
    return f"""near{k} AS (
  SELECT a.vec_id, a.label, a.p, a.x, min(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) AS key
  FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY ALL)"""


def _means(k: int) -> str:
    return f"""mean{k} AS (
  SELECT p, e, list(c ORDER BY i) AS x FROM (
    SELECT p, key % 64 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS c FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
{_round(0)},
{_means(0)},
{_round(1)},
{_means(1)},
{_round(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', key % 64), '' ORDER BY p) AS code, sum(key // 64)::BIGINT AS error FROM near2 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded"""
