import re
import zlib

import corpus_pipeline
from sigilframe.llm import hilbert, jaccard, linededup
from sigilframe.llm.registry import ORACLES, QUERIES, documents, vocabulary
from sigilframe.llm.shared import stored, temporary
from sigilframe.llm.wordbpe import load, packed

from .test_documents import brute_spans, odd_rows, prose

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {d: t for d, t in rows.items() if t is not None and any(c.isalpha() for c in t)}
    last = {}
    held = {}
    for d, t in want.items():
        for x in t.split("\n"):
            if k := linededup.key_of(x):
                held.setdefault(k, set()).add(d)
    last = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = {d: "\n".join(x for x in t.split("\n") if last.get(linededup.key_of(x) or b"", d) <= d) for d, t in want.items()}
    keep = {d for d, n, c in jaccard.plain(list(want.items()), 5, (4, 5)) if n == 0 or d == c}
    want = {d: t for d, t in want.items() if d in keep}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(want)
    tok = load(vocabulary("byte_bpe_50k.json"))
    plain = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in want.items() if not re.search(r"[0-9a-f]{16}|AKIA|(?i:password|passwd|secret|token|api_?key)", t)}
    seen = 0
    for r in pieces:
        if r.doc_id in plain:
            assert zlib.crc32(packed(plain[r.doc_id][r.start : r.start + r.length])) == r.ids_crc32
            seen += r.length
    assert seen == sum(map(len, plain.values())) > 0


def test_odd_rows_against_brute_force(spark, tmp_path):
    rows = [(r[0], r[1], r[2]) for r in odd_rows()] + [(2, prose(71, 30), "en"), (5, prose(71, 30), "de"), (30, prose(72, 60) + " api_key=abcdefghijklmnop1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, t) for d, t, _ in rows if t is not None and any(c.isalpha() for c in t)]
    held = {}
    for d, t in want:
        for x in t.split("\n"):
            if d is not None and len(k := x.strip(linededup.BLANKS).translate(linededup.UPPER)) >= 40:
                held.setdefault(k, set()).add(d)
    last = {k: max(v) for k, v in held.items() if len(v) >= 5}
    stays = lambda d, x: d is None or last.get(x.strip(linededup.BLANKS).translate(linededup.UPPER), d) <= d
    want = [(d, "\n".join(x for x in t.split("\n") if stays(d, x))) for d, t in want]
    assert want != [(d, t) for d, t, _ in rows if t is not None and any(c.isalpha() for c in t)]
    plain = jaccard.plain(list(enumerate(t for _, t in want)), 5, (4, 5))
    groups = {}
    for i, n, c in plain:
        groups.setdefault(c, []).append(i)
    keep = {i for i, n, _ in plain if n == 0}
    for members in groups.values():
        least = min((want[i][0] is None, want[i][0] or 0) for i in members)
        texts = {want[i][1] for i in members if (want[i][0] is None, want[i][0] or 0) == least}
        assert len(texts) == 1  # else a hash decides
        keep |= {i for i in members if (want[i][0] is None, want[i][0] or 0) == least}
    assert len(keep) < len(want)
    tok, ids = load(vocabulary("byte_bpe_50k.json")), {}
    for d, t in (want[i] for i in keep):
        out, at = "", 0
        for a, _, b in brute_spans(t):
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        made = tuple([*tok.encode(out + t[at:], add_special_tokens=False).ids, 1])
        ids.setdefault((d, len(made)), []).append(made)
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert got.keys() == ids.keys()
    for k, pieces in got.items():
        assert sum(r.length for r in pieces) == sum(map(len, ids[k]))
        assert all(any(zlib.crc32(packed(list(x[r.start : r.start + r.length]))) == r.ids_crc32 for x in ids[k]) for r in pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, _text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_temporary_tables_of_others_stay(spark):
    one = spark.range(3)
    with temporary(spark):
        outer = stored(one, "outer")
        with temporary(spark):
            inner = stored(one, "inner")
            assert inner.count() == 3
        assert outer.count() == 3
    assert one.count() == 3


def test_stage_columns(spark):
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_near_copies_of_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(words)]  # 86 of 106 shingles of five words, 89 of 105 of four
    far = [f"y{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]  # 81 of 111 of five words
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(far)), (4, "others " * 9)]
    assert [c for _, _, c in jaccard.plain(rows)] == [1, 2, 3, 4] and [c for _, _, c in jaccard.plain(rows, 5, (4, 5))] == [1, 1, 3, 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3, 4}
    assert {r.component_id for r in jaccard.digest(docs).collect()} == {1, 2, 3, 4}


def test_unlabelled_documents_stay(spark):
    rows = [(1, "some words here", None), (2, "12 345 _ !", None), (3, None, None), (4, "東京", None), (5, "", None), (6, "x²", None), (7, "ünï", None), (8, "½ ① Ⅷ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 6, 7}


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and hilbert.LENGTH == 2048
