"""Substring dedup by sliding sentence spans.

A text is cut into sentences, at end marks before white space and at line ends. A sentence of more than WINDOW words is cut further:
each word has a rank by its hash, and in every WINDOW words that follow each other within a sentence, a cut comes behind the one of the lowest
rank. So no piece has more than WINDOW words, and cuts depend on the WINDOW - 1 words around them only: copies of a passage are cut alike
whatever stands around them. Scripts without spaces between words count each character as half a word of its own.

A run takes consecutive pieces until it has LEAST words: from every piece on, and from every piece back, so the end of a repeat is covered as its
beginning is. It is hashed over its lower-cased words. A passage of 4 * WINDOW + LEAST - 3 words (50) holds a whole run wherever it begins
and ends: cuts agree from its word WINDOW on, the first of them comes WINDOW - 1 words later at most, the run's end as many behind its LEAST
words, and WINDOW words before the passage's end cuts still agree. A text of fewer than LEAST words is one run, which equals only such whole texts. Runs are joined globally by hash, and the pieces that lie in any run but
the first occurrence of its hash are removed. First is the smallest doc_id, and within a document the earliest run.

Each task first compares its own runs: of a hash that it meets again in a document with a larger id, it knows already that this is not the
first, so a passage of a third of all documents sends a few rows to the join for each task. The rest are sorted by hash and
streamed, which takes no memory for long groups; what is known already only travels with its document. The runs of the documents that
lose any are made once more when the sentences are removed. Shuffles: one row of three longs a run, and the texts once.

Nulls and odd rows: a null text stays null, with no sentences; a null doc_id isn't indexed and keeps its text; rows that share a doc_id count as
one document; extra columns are carried by `remove` under their own names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import mix
from .shared import fields, fresh, map_rows, parts_for

LEAST = 25
WINDOW = 7
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u3001\u3003-\ua4cf\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
UNIT = re.compile(rf"(?:[{UNSPACED}]|[^\s{UNSPACED}。！？]+|(?=[。！？]))[。！？]*\s*")
WEAK, STRONG = {".", "!", "?"}, {"。", "！", "？"}  # end a sentence before white space, and anywhere
ALONE = re.compile(f"[{UNSPACED}]")
MOST_UNITS, MOST_CHARS = 1_000_000, 24 << 20
TEXT_PER_PART = 64 << 20
MOST_KEPT = 500_000
OPEN, ALL, LATER = 0, 1, 2
PAIR = struct.Struct("=qq")
DDL = "a long, b long, doc_id long, mode int"
ROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("mode", pa.int32())])

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Units(dict):
    """Numbers words with the white space behind them; by number, `rank` (0 where a sentence ends), `weight` in half words and `hash`, of the
    lower-cased word."""

    def __init__(self):
        self.rank, self.weight, self.hash, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint64), 0
        self.new: list[tuple[int, int, int]] = []

    def __missing__(self, unit: str) -> int:
        word = unit.rstrip()
        ends = word[-1:] in STRONG or (len(unit) > len(word) and (word[-1:] in WEAK or "\n" in unit))
        raw = word.lower().encode("utf-8", "replace")
        self.new.append((0 if ends else zlib.crc32(raw) or 1, 1 if unit[0] >= UNSPACED[0] and ALONE.match(unit) else 2, xxhash.xxh3_64_intdigest(raw)))
        self.chars += len(unit)
        self[unit] = k = len(self)
        return k

    def numbers(self, found: list[str]) -> np.ndarray:
        """They hold until the next call."""
        if len(self) > MOST_UNITS or self.chars > MOST_CHARS:
            self.clear()
            self.chars = 0
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.new:
            end, start = len(self), len(self) - len(self.new)
            while end > len(self.rank):
                self.rank, self.weight, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rank, self.weight, self.hash))
            rank, weight, hashes = zip(*self.new, strict=True)
            self.rank[start:end], self.weight[start:end], self.hash[start:end] = rank, weight, np.array(hashes, np.uint64)
            self.new.clear()
        return out


UNITS = Units()


def pieces(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a text with the white space behind them, their numbers, and the ends of its pieces."""
    found = UNIT.findall(text)
    if not found:
        return found, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = UNITS.numbers([*found, found[-1].rstrip() + " "])  # the end of a text is as good as white space
    rank = UNITS.rank[ids]
    rank[-2] = rank[-1]
    ids, rank = ids[:-1], rank[:-1]
    cut = rank == 0
    if len(rank) >= WINDOW:
        around = np.full(len(rank) + WINDOW - 1, -1)
        around[WINDOW - 1 : len(rank)] = over_windows(np.minimum, rank)
        cut |= over_windows(np.maximum, around) == rank  # the lowest of any window that holds it
    cut[-1] = True
    return found, ids, np.flatnonzero(cut) + 1


def over_windows(f: np.ufunc, x: np.ndarray) -> np.ndarray:
    n = len(x) - WINDOW + 1
    out = x[:n]
    for k in range(1, WINDOW):
        out = f(out, x[k : k + n])
    return out


def sentences(text: str, cut: tuple | None = None) -> list[str]:
    """Pieces that joined give the text again. cut: of pieces()."""
    found, _, ends = cut or pieces(text)
    out, at = [], 0
    for end in ends.tolist():
        out.append("".join(found[at:end]))
        at = end
    before = text[: len(text) - sum(map(len, out))]  # white space
    return [before + out[0], *out[1:]] if out else [before] if before else []


def hashed(text: str, cut: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run, in order: two hashes, the first piece and the end. The hashes are polynomials of the words' hashes, as differences of running sums."""
    _, ids, ends = cut or pieces(text)
    edge = np.concatenate([[0], ends])
    total = np.concatenate([[0], np.cumsum(UNITS.weight[ids])])[edge]
    n = len(ends)
    if not n:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if total[-1] < 2 * LEAST:
        words = UNITS.hash[ids].tobytes()
        whole = [[xxhash.xxh3_64_intdigest(words, seed) - (1 << 63) for seed in (1, 2)]]
        return np.array(whole, np.int64), np.zeros(1, np.int64), np.full(1, n)
    forth = np.searchsorted(total, total[:-1] + 2 * LEAST)
    back = np.searchsorted(total, total[1:] - 2 * LEAST, "right") - 1
    code = np.unique(np.concatenate([(np.arange(n) * (n + 1) + forth)[forth <= n], (back * (n + 1) + np.arange(1, n + 1))[back >= 0]]))
    i, end = code // (n + 1), code % (n + 1)
    first, size = edge[i], (edge[end] - edge[i]).astype(np.uint64)
    up, down = _powers(len(ids) + 1)
    out = np.empty((len(i), 2), np.int64)
    for k, salt in enumerate((np.uint64(0x51ED270B9F3C1D05), np.uint64(0x1B873593CC9E2D51))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(UNITS.hash[ids] ^ salt) * up[: len(ids)])])
        out[:, k] = mix((sums[edge[end]] - sums[first]) * down[first] + size * salt).astype(np.int64)
    return out, i, end


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """(hash, hash, first piece, end) of every run, in order."""
    h, i, end = hashed(text)
    return list(zip(*h.T.tolist(), i.tolist(), end.tolist(), strict=True))


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc_id, mode) of a document's distinct hashes: OPEN to be compared globally, ALL where this task has met the hash in a smaller
    doc_id, LATER besides where the document itself repeats it."""
    least: dict[bytes, int] = {}
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part, hashes, ids, modes = batch.slice(k, 256).to_pydict(), [], [], []
            if len(least) > MOST_KEPT:
                least.clear()
            for d, text in zip(part["doc_id"], part["text"], strict=True):
                h, _, _ = hashed(text)
                raw, mode, met, again = h.tobytes(), [], set(), set()
                for at in range(0, len(raw), 16):
                    x = raw[at : at + 16]
                    if x in met:
                        mode.append(LATER if x not in again else -1)
                        again.add(x)
                        continue
                    met.add(x)
                    known = least.get(x)
                    if known is None or d < known:
                        least[x] = d
                    mode.append(ALL if known is not None and known < d else OPEN)
                hashes.append(h)
                ids.append(np.full(len(h), d))
                modes += mode
            if modes:
                mode = np.array(modes, np.int32)
                keep = np.flatnonzero(mode >= 0)
                h, d = np.concatenate(hashes)[keep], np.concatenate(ids)[keep]
                cols = (np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), d, mode[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROW.types, strict=True)], schema=ROW)


def not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (mode, a, b, doc_id): all but the open ones of each hash's smallest doc_id."""
    last, first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, d, mode = (batch.column(k).to_numpy() for k in range(4))
        new = np.concatenate([[last != (a[0], b[0], mode[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (mode[1:] != mode[:-1])])
        at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        lead = np.where(at < 0, first, d[at])
        last, first = (a[-1], b[-1], mode[-1]), lead[-1]
        keep = np.flatnonzero((mode != OPEN) | (d > lead))
        if len(keep):
            yield batch.take(pa.array(keep))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, found: the hashes (a, b) that a document loses, with their mode."""
    spark = docs.sparkSession
    text = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    volume = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = text.mapInArrow(marked, DDL)
    place = F.when(F.col("mode") == OPEN, F.xxhash64("a", "b")).otherwise(F.xxhash64("doc_id"))
    dealt = rows.repartition(parts_for(spark, volume, TEXT_PER_PART), place).sortWithinPartitions("mode", "a", "b", "doc_id")
    later = dealt.select("a", "b", "doc_id", "mode").mapInArrow(not_first, DDL)
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "mode")).alias("found"))  # at most two a run of the document


def remove(docs: DataFrame, removed: str = "_removed", ranges: str = "_spans") -> DataFrame:
    """All columns of docs with the remaining text, the number of removed sentences, and the removed
    code-point ranges of the old text."""
    keep = [c for c in docs.columns if c != "text"]
    raw, again = fresh(docs, "_text", "_found")
    found = repeated(docs).withColumnRenamed("found", again).hint("shuffle_hash")
    both = docs.join(found, "doc_id", "left").select(*keep, F.col("text").alias(raw), again)

    def make():
        def batch(c: dict) -> dict:
            out = [one(t, f and lost(f)) for t, f in zip(c[raw], c[again], strict=True)]
            return {"text": [o[0] for o in out], removed: [o[1] for o in out], ranges: [o[2] for o in out]}

        return batch

    return map_rows(both, fields(docs, keep, f"text string, `{removed}` long, `{ranges}` array<struct<start:long,end:long>>"), make, carry=keep)


def lost(rows: list[dict]) -> dict[bytes, int]:
    """By hash, LATER only where nothing says that all of its runs go."""
    out: dict[bytes, int] = {}
    for x in rows:
        key = PAIR.pack(x["a"], x["b"])
        out[key] = min(out.get(key, LATER), x["mode"])
    return out


def one(text: str | None, found: dict[bytes, int] | None) -> tuple[str | None, int, list[dict]]:
    """The text without the runs of some hashes; of those with the mode LATER, without all but the first run of each."""
    if text is None or not found:
        return text, 0, []
    parts = pieces(text)
    h, first, ends = hashed(text, parts)
    raw, gone, met = h.tobytes(), set(), set()
    for k, (i, end) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        x = raw[16 * k : 16 * k + 16]
        if (mode := found.get(x)) is not None and (mode != LATER or x in met):
            gone.update(range(i, end))
        met.add(x)
    kept, cut, at = [], [], 0
    for i, s in enumerate(sentences(text, parts)):
        if i not in gone:
            kept.append(s)
        elif cut and cut[-1]["end"] == at:
            cut[-1]["end"] = at + len(s)
        else:
            cut.append({"start": at, "end": at + len(s)})
        at += len(s)
    return "".join(kept), len(gone), cut


def digest(docs: DataFrame) -> DataFrame:
    return remove(docs.select("doc_id", "text")).select("doc_id", F.col("_removed").alias("n_removed"), F.col("_spans").alias("removed"), "text")


def plain(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """For tests: the same by brute force, for distinct ids."""
    first: dict[tuple, tuple] = {}
    for d, t in rows:
        for a, b, i, _ in runs(t) if t is not None else ():
            first[a, b] = min(first.get((a, b), (d, i)), (d, i))
    out = []
    for d, t in rows:
        own = sentences(t) if t is not None else []
        gone = {k for a, b, i, end in (runs(t) if t is not None else ()) if first[a, b] != (d, i) for k in range(i, end)}
        out.append((d, t if t is None else "".join(s for k, s in enumerate(own) if k not in gone), len(gone)))
    return out
