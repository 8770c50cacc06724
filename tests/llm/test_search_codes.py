"""Block-Max MaxScore, grid codes and the agenda of pieces, each against a brute-force version or the library."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from sigilframe.llm import agenda_bpe, blockmax, gridcode
from sigilframe.llm.registry import vocabulary
from sigilframe.llm.shared import stored

from .test_documents import SCHEMA, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """Every document for every item, straight from the formula."""
    split = [(i, Counter(words(t))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    n, total = len(split), sum(s[2] for s in split)
    df = Counter(w for _, c, _ in split for w in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, ws in asked.items():
        found = []
        for i, c, size in split:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **how):
    build = {x: how.pop(x) for x in ("shard_bytes",) if x in how}
    return sorted((tuple(r) for r in blockmax.search(stored(blockmax.build(docs, **build), "index"), items, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in odd_rows()]


ITEMS = [(1, "alpha beta ALPHA gamma, deltazeta"), (2, None), (3, ""), (4, "... !!"), (5, "日本語 Ünïcödé 😀 one"), (6, prose(1, 120)), (7, "nothing-of-this-kind qqqq"), (None, "the very same line"), (8, "one"), (8, "two alpha"), (9, "characters of")]


def test_block_max_on_odd_rows(spark, docs, pairs):
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, term int, w string")
    want = ranked(pairs, ITEMS)
    assert want and searched(docs, items) == want
    assert searched(docs, items, shard_bytes=500, query_terms=5) == want
    assert searched(docs, items, k=3) == ranked(pairs, ITEMS, 3)
    assert searched(docs.limit(0), items) == [] and searched(docs, items.limit(0)) == [] and searched(docs.where("doc_id in (4, 5, 6)"), items) == []


def test_block_max_on_many_documents(spark):
    r = random.Random(5)
    # Frequent and rare words, ties by whole copies, lengths of 1 to 400, ids out of order.
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(r.choice((1, 5, 30, 400)))) for _ in range(2500)]
    rows = [((i * 7919) % 5003, texts[i % 2400]) for i in range(2500)]
    items = [(i, " ".join(f"w{int(r.paretovariate(0.5)) % 3000}" for _ in range(r.choice((1, 4, 25))))) for i in range(40)]
    got = searched(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=100_000)
    assert got == ranked(rows, items)


def test_block_max_leaves_blocks_closed():
    """In one shard of 20,000 documents, many blocks of the frequent lists are rejected by their maxima."""
    r = random.Random(6)
    shard = blockmax.Shard()
    for i in range(20_000):
        shard.add(i, " ".join(["common"] * r.choice((1, 1, 1, 1, 4)) + [f"w{r.randrange(40)}"] + (["rare"] if i % 900 == 5 else []) + ["pad"] * r.randint(0, 60)).encode())
    rows = [x for b in shard.rows(1) for x in b.to_pylist()]
    head = rows[0]
    m = np.arange(max(head["lengths"]) + 1, dtype=np.int64)
    m = 10 + 90 * m * head["df"] // head["total"]
    of_doc = m[np.array(head["lengths"])]

    def lists():
        w = {b"rare": 8000, b"common": 40, b"w7": 3500}
        return [blockmax.Postings(x | {"w": w[x["term"]]}, of_doc, m) for x in rows[1:] if x["term"] in w]

    blockmax.Postings.opened = 0
    pruned = lists()
    got = blockmax.best(pruned, len(of_doc))
    opened, of_all = blockmax.Postings.opened, sum(len(p.lasts) for p in pruned)
    score = np.zeros(len(of_doc), np.int64)
    for p in lists():
        d, s = p.between(0, len(of_doc))
        score[d] += s
        assert (p.block_most >= np.maximum.reduceat(s, np.arange(0, len(s), blockmax.BLOCK))).all()
    order = np.lexsort((np.arange(len(score)), -score))[:10]
    assert got[0].tolist() == order.tolist() and got[1].tolist() == score[order].tolist()
    assert opened < of_all / 2


def test_numbers_of_varying_length():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**34, 5], np.int64)
    raw, at = blockmax.varied(x)
    assert blockmax.numbers(raw).tolist() == x.tolist() and at[-1] == len(raw)


# --- grid codes


def plain_codes(rows, rounds=2):
    """The contract by full search with Python integers."""
    kept = [(i, lab, [math.floor(256 * c) for c in v]) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = -(-len(kept[0][2]) // 16)
    cut = [[(v + [0] * (16 * size - len(v)))[p * size : (p + 1) * size] for p in range(16)] for _, _, v in kept]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            at = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(c[p][j] for c, a in zip(cut, at, strict=True) if a == k) // at.count(k) for j in range(size)] if k in at else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(16)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by: Counter = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[lab], sha) for (i, lab, _), f, e in zip(kept, found, errors, strict=True)), key=repr)


def coded(df):
    return sorted((tuple(r) for r in gridcode.digest(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("dim", [16, 64, 40])
def test_grid_codes_against_full_search(spark, dim):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) * r.choice([0.1, 2])).astype(np.float32).tolist(), [None, 1, 2, 2, 2][i % 5]) for i in range(300)]
    rows += [(300 + i, rows[7][1], 2) for i in range(60)] + [(None, rows[9][1], None)]  # many copies, a null id
    rows += [(400, (np.round(r.normal(size=dim)) / 2).tolist(), 3) for _ in range(3)]  # a repeated id
    bad = [(500, None, 1), (501, [], 1), (502, [math.nan] * dim, 1), (503, [math.inf] + [0.0] * (dim - 1), 1), (504, [None] + [0.0] * (dim - 1), None)]
    df = spark.createDataFrame([(*x, "c", 1) for x in [*rows, *bad, (505, [1.0] * (dim + 1), 1), (506, [2.0**21] * dim, 1)]], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    assert coded(df) == plain_codes(rows)
    assert coded(df.limit(0)) == [] and coded(df.where("vec_id >= 500")) == coded(df.where("vec_id in (505, 506)"))
    few = [x for x in rows if x[0] is not None and x[0] < 5]
    assert coded(df.where("vec_id < 5")) == plain_codes(few)  # fewer vectors than entries
    codes, books = gridcode.compress(df)
    shown = {x.vec_id: x.approximation for x in gridcode.decoded(codes.select("vec_id", "code"), books).collect()}
    x = np.floor(256 * np.array(rows[3][1], np.float64)) / 256
    assert round(256**2 * float(((np.array(shown[3])[:dim] - x) ** 2).sum()) + 256**2 * float((np.array(shown[3])[dim:] ** 2).sum())) == codes.where("vec_id = 3").first().error


def test_grid_memo_is_exact_and_spares_entries(monkeypatch):
    r = np.random.default_rng(3)
    book = (r.normal(size=(64, 4)) * 60).astype(np.int64)
    book[9] = book[4]  # a tie
    x = (r.normal(size=(20_000, 4)) * 60).astype(np.int64)
    x[:64] = book
    d = ((x[:, None, :] - book) ** 2).sum(2)
    for width in (None, 1, 7, 1000):
        grid = gridcode.Grid(book, width)
        for _ in range(2):
            at, dist = grid.nearest(x)
            assert (at == d.argmin(1)).all() and (dist == d.min(1)).all()
    grid = gridcode.Grid(book)
    grid.nearest(x)
    assert grid.evaluated < 0.5 * d.size and len(grid.memo) < len(x) / 3
    monkeypatch.setattr(gridcode, "MOST_CELLS", 50)
    small = gridcode.Grid(book)
    for i in range(0, 20_000, 100):
        assert (small.nearest(x[i : i + 100])[0] == d[i : i + 100].argmin(1)).all()
    assert len(small.memo) <= 100


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    return agenda_bpe.AgendaBpe(vocabulary("piece_bpe_32k.model"))


def test_pieces_of_odd_rows(docs, pairs, pieces):
    def want(text):
        ids = pieces.library.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest(), True

    path = vocabulary("piece_bpe_32k.model")
    got = [tuple(r) for r in agenda_bpe.digest(docs, path).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *want(t))) for i, t in pairs)
    assert all(r.agrees for r in agenda_bpe.encode(docs, path, whole=True).collect())
    assert agenda_bpe.digest(docs.limit(0), path).collect() == []


def test_pieces_of_mixed_texts(pieces):
    r = random.Random(3)
    some = [" ", "  ", "▁", "a", "b", "the", "é", "日", "本", "\n", "\t", "\x00", "😀", "ß", "<s>", "</s>", "<unk>", "<0x0A>", "\r", "ﾊ", "1", "2", "...", "//", "ing", "́", "�", "ª", "ʯ", "Ж"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(8000)] + [" " * k for k in range(80)]
    theirs = pieces.library.encode(texts, add_eos=True, num_threads=1)
    got = pieces.run(texts)
    assert [g[0] for g in got] == [" ".join(map(str, i)) for i in theirs]
    assert [g[1] for g in got] == pieces.library.decode(theirs, num_threads=1) and all(g[2] for g in got)
    assert [pieces.encode(t) + [2] for t in texts[:500]] == theirs[:500]
    ids = [[r.randrange(32000) if r.random() < 0.5 else r.randrange(260) for _ in range(r.randint(0, 12))] for _ in range(8000)]
    assert [pieces.decode(i) for i in ids] == pieces.library.decode(ids, num_threads=1)


def test_pieces_of_long_unspaced_texts(pieces):
    began = time.time()
    for text in ("日本語中文字" * 50_000, "a" * 300_000, " " * 100_000, "abcdefg" * 40_000):
        assert pieces.encode(text) == pieces.library.encode(text)
    assert time.time() - began < 60


def test_a_difference_is_told(pieces, monkeypatch):
    other = agenda_bpe.AgendaBpe(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(other, "merged", lambda text: [other.symbol.get(c, ~ord(c)) for c in text])
    assert [g[2] for g in other.run(["7 8", "thing other", "9", "an other"])] == [True, False, True, False]


def test_queries_are_registered():
    from sigilframe.llm import registry

    assert {"op11_block_max", "op12_grid_codes", "op13_agenda_pieces"} <= set(registry.QUERIES) and {"op11_block_max", "op12_grid_codes"} <= set(registry.ORACLES)
