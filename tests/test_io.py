import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.functions import raster as R
from sigilframe.operators.raster import EXTRACTORS
from sigilframe.schema import CATALOG, FEATURES, METADATA
from sigilframe.sources import paged, sinks, tables
from sigilframe.streaming import incremental


def test_catalog_round_trip(spark, tmp_path):
    row = tuple(f'{c} "quoted", x' if i % 2 else "" for i, c in enumerate(CATALOG))
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in CATALOG))
    sinks.catalog(df, str(tmp_path / "c"))
    assert [tuple(r) for r in tables.catalog(spark, str(tmp_path / "c")).collect()] == [row]


def test_features_reader(spark, tmp_path):
    head = ",".join((*METADATA, *FEATURES))
    (tmp_path / "f.csv").write_text(f"{head}\na,s,S,NA,,p,1,2,3,4,5,6\nb,s,S,null,c,p,1,,3,4,5,6\nc,s,S,x,c,p,1,2,inf, 1.5 ,5,6\nd,s,S,x,c,p,y,2,3,4,5,6\n")
    got = {r.icon_id: r for r in tables.features(spark, str(tmp_path / "f.csv")).collect()}
    assert set(got) == {"a", "c"} and got["a"].label == "" and got["c"].connected_components == float("inf") and got["c"].quadtree_leaf_count == 1.5


def test_lookups(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"_id": 1, "keywords": [{"keyword": "cat"}], "categories": ["a", "b", "c", "d"]}, {"_id": 2, "keywords": [], "tags": ["t"]}, {"_id": 1, "keywords": [{"keyword": "last"}], "categories": []}]')
    got = {r.key: (r.label, r.category, r.notes) for r in tables.pictograms(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"1": ("last", "", "arasaac_id=1"), "2": ("", "t", "arasaac_id=2")}
    (tmp_path / "e.json").write_text('[{"hexcode": "1F600", "annotation": "grin", "group": "g", "subgroups": "", "emoji": "x", "tags": "a, b"}]')
    assert tuple(tables.emoji(spark, str(tmp_path / "e.json")).first()) == ("1F600", "grin", "g", "emoji=x; tags=a, b")
    assert tables.emoji(spark, str(tmp_path / "none.json")).count() == 0 and tables.ratings(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "r.csv").write_text("appendix_item,label,concreteness,complexity,familiarity,meaningfulness,semantic_distance,complexity_metric,concept_agreement,name_agreement,common_response,source_page,ocr_confidence,verified\n7,Fan,,,,,,,,,,,,false\n,none,,,,,,,,,,,,\n")
    assert tuple(tables.rating_lookup(spark, str(tmp_path / "r.csv")).first()) == ("7", "Fan", "", "appendix_item=7")


def test_word_reader(spark, tmp_path):
    (tmp_path / "w.tsv").write_text('level\tleft\ttop\twidth\theight\tconf\ttext\n5\t10\t20\t30\t40\t91.5\t"Air\n5\t1\t2\t3\t4\t90\t \n4\t1\t2\t3\t4\t90\tx\n5\tq\t2\t3\t4\t90\ty\n')
    assert [tuple(r) for r in tables.words(spark, str(tmp_path / "w.tsv")).collect()] == [('"Air', 10, 20, 30, 40, 40, 60, 25.0, 40.0, 91.5)]


def test_listings(spark, tmp_path):
    for p in ("src/a-b/c d/1F600.svg", "src/g/s/2.SVG", "src/g/s/readme.txt", "3.png"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_text("<svg viewBox='0'/>")
    got = tables.files(spark, str(tmp_path / "root"))
    assert {r.path for r in got.collect()} == {"src/a-b/c d/1F600.svg", "src/g/s/2.SVG", "3.png"}
    cols = {r.code: (r.group, r.subgroup) for r in tables.path_columns(got).collect()}
    assert cols["2"] == ("g", "s") and cols["3"] == (None, None)
    assert {r.name for r in tables.svg_documents(spark, str(tmp_path / "root")).collect()} >= {"1F600"}


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.md").write_text("# Title\n\n| Symbol | Name |\n| --- | :-: |\n| x | Aid |\n| | Fire |\n")
    assert [r.cells for r in tables.pipe_table(spark, str(tmp_path / "t.md")).collect()] == [["x", "Aid"], ["", "Fire"]]
    (tmp_path / "w.js").write_text('var words = {"b": ["x", "y"], "A": []};')
    w = tables.symbol_words(spark, str(tmp_path / "w.js"))
    assert {r.word: r.parts for r in w.collect()} == {"b": ["x", "y"], "A": []}
    assert [r.line for r in sinks.sorted_words(w).collect()] == ['"A": []', '"b": ["x","y"]']
    (tmp_path / "x.xml").write_text("<r><LexicalEntry><id>1</id></LexicalEntry><LexicalEntry><id>2</id></LexicalEntry></r>")
    assert tables.lexical_entries(spark, str(tmp_path / "x.xml")).count() == 2
    (tmp_path / "p.csv").write_text('Word,Code\na,"1, 2"\n')
    assert tuple(tables.positional_csv(spark, str(tmp_path / "p.csv"), "w string, c string").first()) == ("a", "1, 2")
    assert tuple(tables.records_csv(spark, str(tmp_path / "p.csv")).first()) == ("a", "1, 2")


def fetch_page(category, token):
    titles = [f"{category}{i}" for i in range(5)]
    at = int(token or 0)
    return titles[at : at + 2], str(at + 2) if at + 2 < 5 else None


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("fetcher", "tests.test_io:fetch_page").option("categories", "a,b").load()
    assert sorted(r.title for r in df.collect()) == [f"{c}{i}" for c in "ab" for i in range(5)]


def test_retries():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise paged.StatusError(503)
        return "ok"

    assert paged.with_retries(call, sleep=pauses.append) == "ok" and pauses == [1, 2, 4]
    with pytest.raises(paged.StatusError):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.StatusError(404)), sleep=pauses.append)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (2, 1, 3.0), (2, 2, 0.0)], "source long, target long, distance double")
    assert [tuple(r) for r in sinks.wide_matrix(d, [1, 2]).collect()] == [(1, 0.0, 3.0), (2, 3.0, 0.0)]
    sinks.pairs(d.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    m = spark.createDataFrame([("a", "u", None), ("b", None, "no_url")], "title string, url string, reason string")
    assert [tuple(x) for x in sinks.manifest(m).orderBy("title").collect()] == [("downloaded", "a", "u", None), ("skipped", "b", None, "no_url")]
    assert sinks.html_table(spark.range(600).toDF("n"), "t").count("<tr>") == 601
    assert "&lt;b&gt;" in sinks.html_table(spark.createDataFrame([("<b>",)], "x string"), "t")
    assert sinks.run_metadata(spark, "i", "o", 3, 2, 100, EXTRACTORS).first().features[3].columns[0] == "quadtree_leaf_count"
    assert sinks.tsv(m, ["title", "reason"]).first().line == "a\t"
    assert [r.name for r in sinks.path_list(spark.createDataFrame([("x/b.svg",), ("a.svg",), ("y/b.svg",)], "path string")).collect()] == ["a", "b"]
    assert sinks.constants_module(spark.createDataFrame([("A", 'x"')], "n string, v string"), "n", "v").first().line == 'export const A = "x\\"";'
    sinks.json(m, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_feature_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    square = np.zeros((8, 8, 4), np.uint8)
    square[2:6, 2:6] = 255
    where = [str(tmp_path / x) for x in ("out", "bad", "check")]
    (folder / "a.png").write_bytes(R.write_png(square))
    incremental.feature_stream(spark, str(folder), *where).awaitTermination()
    (folder / "b.png").write_bytes(R.write_png(square))
    (folder / "c.png").write_bytes(b"broken")
    incremental.feature_stream(spark, str(folder), *where).awaitTermination()
    assert spark.read.parquet(where[0]).count() == 2 and spark.read.parquet(where[1]).count() == 1


def test_windowed_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_fixed_lists(spark):
    n = tables.named_files(spark, ["File:a b.svg"], "https://x/").first()
    assert (n.url, n.file) == ("https://x/File%3Aa%20b.svg", "a b.svg")
    rows, done = spark.createDataFrame([(3,), (1,), (3,), (2,)], "id long"), spark.createDataFrame([(2,)], "id long")
    assert [r.id for r in tables.not_yet(rows, done, "id").collect()] == [1, 3]


def test_scripts():
    from sigilframe.functions.script import assignments

    text = r"""// head
    A = {"a": 1, b: [-2.5e1, 'x\'y', "\u00e9\ud83d\ude00\x41\n", {}, [],], /* in
    between */ $c_1: {true: true, "n": null, deep: {"deeper": [0x1f, .5, +3]}}};
    export const B = ["only"]; var C = 7
    """
    assert assignments(text) == {"A": {"a": 1, "b": [-25.0, "x'y", "\u00e9\U0001f600A\n", {}, []], "$c_1": {"true": True, "n": None, "deep": {"deeper": [31, 0.5, 3]}}}, "B": ["only"], "C": 7}
    assert assignments("") == {} and assignments("X=" + "[" * 5000 + "]" * 5000)["X"] is not None
    for bad in ("A = {", "A = [1 2]", "A = {1: }", "A {}", "A = f(1)", "A = {a 1}", "= 3", "A = 'open"):
        with pytest.raises(ValueError):
            assignments(bad)


def test_symbol_database_draws(spark, tmp_path):
    from sigilframe.operators.symbols import Symbols, drawings

    (tmp_path / "chars.js").write_text("""CHARS = {"center": {"c": -16}, "chars": {"c": {"w": 40, "h": 200, "d": [{"x": 4, "y": 8, "d": "p"}]}, "indicator_i": {w: 8, d: ["s"]}, "question_mark": {w: 1, d: []}},
        "kerning_left": {"c": 3}, "kerning_right": {}, "paths": {"p": {"form": "line", "x1": 0, "y1": 0, "x2": 9, "y2": 9}}, "shapes": {"s": [{"x": 1, "y": 0, "d": "p"},]}};""")
    (tmp_path / "words.js").write_text("WORDS = {words: {'cc': ['c', 'c']}}")
    (tmp_path / "broken.js").write_text("OOPS = {")
    rows = tables.symbol_database(spark, str(tmp_path))
    assert [r.error is not None for r in rows.where("section is null").collect()] == [True] and rows.where("error is null").count() == 8
    db = Symbols.of(rows)
    assert db.words == {"cc": ["c", "c"]} and db.kerning_left == {"c": 3} and db.center == {"c": -16}
    svg = drawings(spark.createDataFrame([("w", ["c", "indicator_i"])], "word string, parts array<string>"), db).first().svg
    assert '<line class="symbol-line" x1="4" y1="312" x2="13" y2="303"/><line class="symbol-line" x1="1" y1="312" x2="10" y2="303"/>' in svg
    assert tables.symbol_database(spark, str(tmp_path / "gone")).collect() == []


def test_parts_of_a_group_larger_than_its_sample(spark):
    t = spark.range(0, 300_000, 1, 8).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 300_007).alias("k"), F.col("id").cast("string").alias("a"))
    got = sinks.grouped(t, "g", ["k"], each=1000).select("g", "part", F.size("items").alias("n"), F.col("items")[0]["k"].alias("first")).orderBy("g", "part").collect()
    assert [(r.g, r.part, r.n) for r in got] == [(g, p, 1000) for g in (0, 1) for p in range(150)]
    keys = {g: sorted(r.k for r in t.where(f"g = {g}").select("k").collect()) for g in (0, 1)}
    assert [r["first"] for r in got] == [keys[r.g][r.part * 1000] for r in got]
