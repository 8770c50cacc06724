import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.functions import raster as R
from sigilframe.functions import text as X
from sigilframe.operators import catalog, drawings, graph, nearby, ocr, quality, raster, records, sampling, similarity, stats, symbols
from sigilframe.plans import feature_queries, record_queries
from sigilframe.schema import FEATURES


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)


def feature_rows(spark, n=60, seed=0):
    r = np.random.default_rng(seed)
    data = [(i, f"s{i % 3}", f"S{i % 3}", *map(float, r.normal(size=6))) for i in range(n)]
    data += [(n + i, *data[i][1:]) for i in range(5)]  # ties
    return spark.createDataFrame(data, "idx long, set_id string, set_name string, " + ", ".join(f"{f} double" for f in FEATURES)), data


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbours_and_pairs_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(nearby, "BLOCK", block)
    monkeypatch.setattr(nearby, "EACH", 3 * block)
    df, data = feature_rows(spark)
    x = np.array([d[3:] for d in data])
    d = nearby.direct(x, x)
    near = rows(similarity.neighbours(df, list(FEATURES), "idx", 4), "source", "rank", "target")
    want = []
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(order)]
    assert near == sorted(want, key=repr)
    for mode, ok in (("all", lambda a, b: True), ("cross", lambda a, b: a != b), ("same", lambda a, b: a == b)):
        pairs = sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if ok(data[i][1], data[j][1]))[:30]
        got = similarity.closest_pairs(df, list(FEATURES), "idx", "set_id", 30, mode).orderBy("rank").collect()
        assert [(r.a, r.b) for r in got] == [(i, j) for _, i, j in pairs]
    m = similarity.distance_matrix(df, list(FEATURES), "idx")
    assert m.count() == len(x) ** 2 and m.where("source = target and distance <> 0").count() == 0


def shuffled_rows(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_matrix_shuffles_no_pairs(spark, monkeypatch):
    """Every row goes to one part of ten rows, whatever the number of parts that it meets; both metrics as numpy has them."""
    monkeypatch.setattr(similarity, "BLOCK", 10)
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(size=(297, 3)), np.zeros((2, 3)), [[math.nan, 0.0, 1.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "idx long, a double, b double, c double")
    for metric, of in (("euclidean", nearby.direct), ("cosine", similarity.cosine)):
        before = shuffled_rows(spark)
        got = similarity.distance_matrix(df, ["a", "b", "c"], "idx", metric).toPandas()
        assert 0 < shuffled_rows(spark) - before <= 3 * len(x)
        want = of(x, x)
        np.fill_diagonal(want, 0)
        assert len(got) == len(x) ** 2 and not got.duplicated(["source", "target"]).any()
        assert np.allclose(got.sort_values(["source", "target"]).distance.to_numpy().reshape(len(x), -1), want, rtol=0, atol=1e-15, equal_nan=True)
    assert similarity.distance_matrix(df.limit(0), ["a", "b", "c"], "idx").collect() == []


def test_matrix_is_stored_in_few_bytes(spark, monkeypatch, tmp_path):
    """Each distance stands twice, and its second place costs a compressed column hardly anything; 8 bytes a row before."""
    monkeypatch.setattr(similarity, "BLOCK", 125)
    x = np.random.default_rng(12).normal(size=(1000, 6))
    df = spark.createDataFrame([(10**12 + i, *map(float, v)) for i, v in enumerate(x)], "idx long, a double, b double, c double, d double, e double, f double")
    similarity.distance_matrix(df, list("abcdef"), "idx").write.option("compression", "snappy").parquet(f"file://{tmp_path}/out")
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 6 * len(x) ** 2
    m = spark.read.parquet(f"file://{tmp_path}/out").toPandas().sort_values(["source", "target"])
    assert len(m) == len(x) ** 2 and not m.duplicated(["source", "target"]).any()
    assert np.array_equal(m.distance.to_numpy().reshape(len(x), -1), nearby.direct(x, x))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_matrix_of_odd_rows(spark, monkeypatch, metric):
    """Null and shared indices (more of one than a piece holds), and null, infinite and broken components, as columns have them."""
    monkeypatch.setattr(similarity, "BLOCK", 10)
    monkeypatch.setattr(similarity, "STRIP", (7, 3))
    r = np.random.default_rng(9)
    data = [(i, *map(float, v)) for i, v in enumerate(r.normal(size=(30, 2)))] + [(2**62 + 1, float(i), 1.0) for i in range(45)]
    data += [(None, 1.0, 2.0), (None, 1.0, 2.5), (None, None, 1.0), (50, None, 1.0), (50, 3.0, None), (51, math.nan, 1.0), (52, 1e200, 0.0), (53, -1e200, 0.0), (54, math.inf, 0.0), (55, 0.0, 0.0)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(data)], "k long, idx long, a double, b double")
    both = df.alias("x").crossJoin(df.alias("y"))
    dot = lambda s, t: f"({s}.a * {t}.a + {s}.b * {t}.b)"
    norm = lambda s: f"if(sqrt{dot(s, s)} = 0, 1D, sqrt{dot(s, s)})"
    cosine = f"(1 - {dot('x', 'y')} / ({norm('x')} * {norm('y')}))"
    of = {"euclidean": "sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))", "cosine": f"if(isnan({cosine}), {cosine}, if({cosine} < 0, 0D, if({cosine} > 2, 2D, {cosine})))"}[metric]
    want = both.selectExpr("x.idx AS source", "y.idx AS target", f"CASE WHEN x.idx = y.idx OR {of} = double('Infinity') THEN 0D ELSE {of} END AS distance")
    got = similarity.distance_matrix(df, ["a", "b"], "idx", metric)
    assert got.count() == len(data) ** 2 and got.exceptAll(want).count() == 0


def test_rounding_of_many_is_rounding(spark):
    """Ties, their neighbours, large, negative and special numbers, and 20,000 others, to the bit."""
    r = np.random.default_rng(3)
    ties = r.integers(-(10**9), 10**9, 3000) / 1e6 + 5e-7
    x = np.concatenate([ties, np.nextafter(ties, 9e9), np.nextafter(ties, -9e9), ties + 1e-9, r.normal(size=10000) * 5, 10 ** r.uniform(-9, 18, 10000), [0.0, -0.0, 99999.9999995, 1e5, math.nan, math.inf, -math.inf]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "i long, d double")
    both = feature_queries.rounded_many(df.withColumn("e", F.round("d", 6)), "d")
    assert both.where("NOT (d <=> e)").count() == 0 and both.where("d = e AND NOT isnan(d)").count() == len(x) - 1


def test_cosine_neighbours_of_zero_and_broken_rows(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 8)
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(40, 3)), np.zeros((2, 3)), np.full((30, 3), 2.0), 3 * np.eye(3)])
    bad = [(900, None, 1.0, 1.0), (901, math.nan, 1.0, 1.0), (902, math.inf, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + bad, "idx long, a double, b double, c double")
    for metric, of in (("cosine", similarity.cosine), ("euclidean", nearby.direct)):
        d = np.round(of(x, x), 12)
        got = {}
        for row in similarity.neighbours(df, ["a", "b", "c"], "idx", 6, metric).orderBy("source", "rank").collect():
            got.setdefault(row.source, []).append(round(row.distance, 9))
        want = {i: sorted(round(v, 9) for j, v in enumerate(d[i]) if j != i)[:6] for i in range(len(x))}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], atol=1e-8) for i in want)
    assert similarity.neighbours(df.limit(0), ["a", "b", "c"], "idx").collect() == []
    assert similarity.neighbours(df.limit(1), ["a", "b", "c"], "idx").collect() == []


def test_searches_visit_few_blocks(spark, monkeypatch):
    """Of 40 clusters a vector's neighbours are in its own; most blocks are never visited."""
    monkeypatch.setattr(nearby, "BLOCK", 50)
    r = np.random.default_rng(8)
    x = r.normal(size=(40, 3))[r.integers(0, 40, 2000)] * 20 + r.normal(size=(2000, 3)) * 0.2
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "idx long, a double, b double, c double")
    at = nearby.blocked(df, ["a", "b", "c"], "idx", 6)
    assert len(at.low) == 40 and at.table.groupBy("block").count().agg(F.max("count")).first()[0] <= 50
    d = nearby.direct(x, x)
    bound = spark.createDataFrame([(i, float(np.sort(v)[5])) for i, v in enumerate(d)], "qid long, bound double")
    assert nearby.visits(at, at.table.join(bound, "qid")).count() < 2000 * 40 / 10
    near = similarity.neighbours(df, ["a", "b", "c"], "idx", 5).orderBy("source", "rank").collect()
    assert [n.target for n in near] == [j for i in range(2000) for j in [int(j) for j in np.argsort(d[i], kind="stable") if j != i][:5]]


def test_distances():
    a = np.array([[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]])
    assert nearby.direct(a, a)[0, 1] == 5
    c = similarity.cosine(a, a)
    assert c[0, 1] == 1 and abs(c[1, 2]) < 1e-12 and np.allclose(c, c.T)


def test_constant_features_and_components(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), float(i * i)) for i in range(10)], "idx long, a double, b double, c double")
    z = stats.standardized(df, ("a", "b")).collect()
    assert all(r.z_a == 0 for r in z) and abs(sum(r.z_b**2 for r in z) - 10) < 1e-9
    p = stats.principal_components(df, "idx", ("a", "b", "c")).collect()
    assert abs(p[0].share1 + p[0].share2 - 1) < 1e-6 and p[0].share1 > 0.9
    rho = {(r.feature_a, r.feature_b): r.rho for r in stats.spearman(df, "idx", ("b", "c")).collect()}
    assert abs(rho["b", "c"] - 1) < 1e-12


def test_quantiles_of_ties_nulls_and_infinities(spark):
    r = np.random.default_rng(3)
    data = {"a": np.round(r.normal(size=501), 1), "b": np.array([2.0]), "c": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]), "d": np.repeat(7.0, 40)}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x] + [("a", None), ("e", None)], "g string, v double").repartition(5)
    got = {x.g: (x.lo, x.mid, x.hi) for x in stats.quantiles(df, ["g"], "v", {"lo": 0.0, "mid": 0.5, "hi": 0.9}).collect()}
    assert got.keys() == data.keys()
    assert got["c"] == (-np.inf, 2.0, np.inf)
    for g in "abd":
        assert np.allclose(got[g], np.quantile(data[g], [0, 0.5, 0.9]))
    assert stats.quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []


def test_extremes_leave_out_what_is_no_number(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0), (5, 0.0)], "i long, v double")
    e = sampling.extremes(df, ("v",), "i", 2)
    assert rows(e, "side", "place", "i") == [("high", 1, 3), ("high", 2, 4), ("low", 1, 5), ("low", 2, 3)]


def test_complete_rows(spark):
    df = spark.createDataFrame([("1", "2"), ("", "1"), ("x", "1"), (" 1.5 ", "inf"), ("NaN", "1"), (None, "1")], "a string, b string")
    assert rows(stats.complete(df, ("a", "b"))) == [(1.0, 2.0), (1.5, math.inf)]


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(30)], "i long, g long, v double")
    assert sampling.first_of_groups(df, ["g"], ["i"], 0).count() == 0
    assert sampling.first_of_groups(df, ["g"], ["i"], 2, 0).count() == 6
    assert [r.i for r in sampling.first_of_groups(df, ["g"], ["i"], 2, 3).collect()] == [0, 1, 2]
    e = sampling.extremes(df, ("v",), "i", 2)
    assert rows(e, "side", "place", "i") == [("high", 1, 6), ("high", 2, 13), ("low", 1, 0), ("low", 2, 7)]
    assert rows(sampling.best_by_confidence(df, ["g"], "v", "i"), "g", "i") == [(0, 6), (1, 13), (2, 20)]


def test_catalog(spark):
    paths = ["10_openmoji/color/svg/1F600.svg", "10_openmoji/black/svg/1F600.svg", "01_mcdougall_symbol_icon_set/extracted_icons_png/mcdougall_007.png", "01_mcdougall_symbol_icon_set/extracted_icons_png/other.PNG",
             "06_blissymbolics/rendered_svg/words/to_go__0123456789ab.svg", "05_mulberry_symbols/EN/a_cat.svg", "11_iso_7010_safety_signs/x/Warning Symbols/w_Original.svg", "11_iso_7010_safety_signs/x/Warning Symbols/W-1.svg", "04_ocha_humanitarian_icons/humanitarian-icons-v2-1-svg/Aid.svg", "77_none/a.svg", "07_arasaac_pictograms/png_300/12.png"]
    files = spark.createDataFrame([(f"icon_data/iconsets/{p}",) for p in paths], "path string")
    empty = spark.createDataFrame([], "key string, label string, category string, notes string")
    emoji = spark.createDataFrame([("1F600", "grinning", "smileys / face", "emoji=x")], empty.schema)
    pictures = spark.createDataFrame([("12", "", "food", "arasaac_id=12")], empty.schema)
    got = {r.filename: r for r in catalog.build_catalog(files, pictures, emoji, empty).collect()}
    assert len(got) == 8
    assert (got["1F600.svg"].label, got["1F600.svg"].category, got["1F600.svg"].notes) == ("grinning", "smileys / face", "emoji=x")
    assert (got["mcdougall_007.png"].label, got["mcdougall_007.png"].notes) == ("McDougall item 7", "appendix_item=7")
    assert got["other.PNG"].label == "other" and got["other.PNG"].format == "png"
    bliss = got["to_go__0123456789ab.svg"]
    assert (bliss.label, bliss.category, bliss.notes) == ("to go", "Blissymbolics word", "bliss_kind=word")
    assert got["a_cat.svg"].category == "iconsets" and got["12.png"].label == "12" and got["12.png"].category == "food"
    fixed = {r.filename: r.category for r in catalog.build_catalog(files, empty, empty, empty, True).collect()}
    assert fixed["a_cat.svg"] == "EN" and fixed["Aid.svg"] == "svg" and fixed["W-1.svg"] == "x"
    order = spark.createDataFrame([("a/b-c/x",), ("a/b/x",)], "relative_path string")
    assert [r.relative_path for r in catalog.in_path_order(order).collect()] == ["a/b/x", "a/b-c/x"]


def test_raster_features_and_failures(spark):
    square = np.zeros((32, 32, 4), np.uint8)
    square[8:24, 8:24] = [0, 0, 0, 255]
    df = spark.createDataFrame([("a", R.write_png(square)), ("b", b"broken"), ("c", None)], "icon_id string, content binary")
    good, bad = raster.split_failures(raster.extract(df))
    row = good.first()
    assert row.foreground_area_ratio == 0.25 and row.connected_components == 1 and row.canny_edge_density > 0
    assert {r.icon_id: r.error.split(":")[0] for r in bad.collect()} == {"b": "ValueError", "c": "FileNotFoundError"}
    sized = raster.normalized(df.where("icon_id = 'a'")).first()
    assert R.read_png(bytes(sized.content)).shape == (256, 256, 4)
    crop = raster.symbol_crops(df.where("icon_id = 'a'").withColumn("content", F.lit(R.write_png(np.where(square[..., 3:] > 0, square, 255).astype(np.uint8))))).first()
    assert (R.read_png(bytes(crop.content))[..., 0] < 128).any()


def test_table_entries(spark):
    words = [("12", 210, 330, 90.0), ("Air", 250, 330, 95.0), ("vent", 300, 332, 93.0), ("outlet", 240, 372, 91.0), ("Concreteness:", 500, 326, 96.0), ("2.5", 720, 330, 88.0), ("Complexity:", 500, 360, 96.0), ("Complexity", 500, 490, 96.0), ("metric", 560, 492, 96.0), ("fan", 600, 600, 90.0), ("Agreement", 660, 600, 90.0)]
    w = spark.createDataFrame([(1, t, x, y, x + 40, y + 20, x + 20.0, y + 10.0, c) for t, x, y, c in words], "page int, text string, left int, top int, right int, bottom int, cx double, cy double, confidence double")
    cell = ocr.geometry(spark.createDataFrame([(1, 0, "left")], "page int, row int, side string")).withColumnRenamed("top", "cell_top")
    label = ocr.label_text(ocr.in_lines(ocr.words_in_boxes(w, cell.select("page", "label_box"), ["page"], "label_box").drop("label_box"), ["page"]), ["page"])
    assert label.first().label == "Air vent outlet"
    found = ocr.field_labels(ocr.words_in_boxes(w, cell.select("page", "metric_box"), ["page"], "metric_box"), ["page"])
    assert rows(found, "field", "top") == [("complexity", 360), ("complexity_metric", 492), ("concreteness", 326)]
    common = ocr.response_text(ocr.words_in_boxes(w, cell.select("page", "common_box"), ["page"], "common_box"), ["page"])
    assert common.first().common_response == "fan"
    values = w.where("text in ('2.5', '12')").withColumn("field", F.lit("concreteness")).withColumn("place", F.col("left"))
    assert tuple(ocr.best_number(values, ["page"]).first()) == (1, "1.20", 90.0, "12")
    assert ocr.items(spark).groupBy("page").count().where("count <> 10").first()["count"] == 9


def test_validation(spark):
    values = ["2.00"] * 5 + ["10", "50.00", "50.00"]
    data = [(str(i), *values) for i in range(1, 5)]
    schema = "appendix_item string, " + ", ".join(f"{f} string" for f in ocr.O.FIELDS)
    assert ocr.violations(spark.createDataFrame(data, schema), n=4).count() == 0
    bad = [*data[:2], data[1], ("9", "6.00", *values[1:])]
    assert rows(ocr.violations(spark.createDataFrame(bad, schema), n=4)) == [("concreteness:rating_out_of_range", 9), ("missing_item", 3), ("missing_item", 4), ("repeated_item", 2), ("unexpected_item", 9)]
    with pytest.raises(ValueError):
        ocr.validated(spark.createDataFrame(bad, schema), n=4)


def test_box_join_edges(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (10.1, 5.0), (-3.0, 4.0)], "x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, -50.0, 0.0, 60.0, 5.0)], "box_id long, x1 double, y1 double, x2 double, y2 double")
    assert rows(ocr.contained(pts, boxes, "x", "y"), "box_id", "x") == [(1, 0.0), (1, 10.0), (2, -3.0), (2, 0.0), (2, 10.1)]


DB = symbols.Symbols(
    chars={"a": {"w": 40, "h": 160}, "b": {"w": 20, "h": 60}, "question_mark": {"w": 8, "h": 192}, "indicator_x": {"w": 16}, "now": {"w": 10, "h": 60}, "one(digit)": {"w": 30, "h": 160}, "c": {"w": 40, "h": 60}},
    words={"ab": ["a", "b"], "nested": ["ab", "indicator_x", "a"]},
    paths={"a": [{"form": "line", "x1": 0, "y1": 64, "x2": 40, "y2": 192}]},
)


def test_catalog_code_compiles(spark):
    """Generated code stays within what the JVM compiles: without the interpreted way out, the query runs."""
    from sigilframe.plans import catalogue

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert catalogue.QUERIES["catalog_rows"](spark, "/root/testdata/sf0.001").count() > 0
        assert len(catalogue.QUERIES["catalog_rows"](spark, "/root/testdata/sf0.001").collect()) > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_bins_and_their_near_classes(spark):
    from sigilframe.operators import bins

    r = np.random.default_rng(3)
    x = r.integers(0, 9, (120, 4)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0, 1.0), (901, math.nan, 1.0, 1.0, 1.0)], "idx long, a double, b double, c double, d double")
    of = bins.binned(df, "idx", ("a", "b", "c", "d"), 3)
    want = {i: [int((v[j] > np.quantile(x[:, j], np.array([1, 2]) / 3)).sum()) for j in range(4)] for i, v in enumerate(x)}
    assert {v.idx: list(v.bins) for v in of.collect()} == want
    first = {}
    for i in sorted(want):
        first.setdefault(tuple(want[i]), i)
    assert {v.idx: v["class"] for v in bins.members(of, "idx").collect()} == {i: first[tuple(b)] for i, b in want.items()}
    for most in (0, 1, 2, 3):
        got = rows(bins.near_classes(bins.classes(of, "idx"), 4, most))
        differ = lambda p, q: sum(a != b for a, b in zip(p, q, strict=True))
        assert got == sorted(((first[p], first[q], differ(p, q)) for p in first for q in first if first[p] < first[q] and differ(p, q) <= most), key=repr)


def test_stratified_sample(spark):
    data = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(1000 + i, None) for i in range(13)] + [(2000, "tiny")]
    df = spark.createDataFrame(data, "k long, s string")
    got = sampling.stratified(df, "s", "k", 100, seed=3, whole=5)
    sizes = {r.s: r.n for r in got.groupBy("s").agg(F.count("k").alias("n")).collect()}
    counts = {}
    for _, s in data:
        counts[s] = counts.get(s, 0) + 1
    big, want = {s: n for s, n in counts.items() if n > 5}, {"tiny": 1}
    share = 99 / sum(big.values())
    want |= {s: int(n * share) for s, n in big.items()}
    for s in sorted(big, key=lambda s: (-(big[s] * 99 % sum(big.values())), s or ""))[: 100 - sum(want.values())]:
        want[s] += 1
    assert sizes == want and got.count() == 100
    huge = spark.createDataFrame([("a", 4 * 10**13), ("b", 2 * 10**13), (None, 1)], "s string, n long")
    assert {r.s: r.quota for r in sampling.quotas(huge, "s", 3 * 10**12 + 1).collect()} == {"a": 2 * 10**12 + 1, "b": 10**12, None: 0}
    again = sampling.stratified(df.orderBy(F.desc("k")).repartition(5), "s", "k", 100, seed=3, whole=5)
    assert rows(again) == rows(got) and rows(sampling.stratified(df, "s", "k", 100, seed=4, whole=5)) != rows(got)
    assert sampling.stratified(df, "s", "k", 10**6).count() == len(data) and sampling.stratified(df.limit(0), "s", "k", 5).collect() == []


def test_symbol_words(spark):
    assert DB.expand(["nested"])[0] == [("a", ["indicator_x"]), ("b", []), ("a", [])]
    assert DB.expand(["ab", "indicator_x"])[0] == [("a", ["indicator_x"]), ("b", [])]
    assert DB.expand(["now", "unknown"])[0] == [("now", []), ("question_mark", [])]
    assert DB.expand(["indicator_x"])[0] == [("indicator_x", [])]
    assert DB.expand(["ab", "ab"])[0] == [("a", []), ("b", [])] * 2  # a word twice is no circle
    with pytest.raises(symbols.Circular):
        symbols.Symbols({}, {"x": ["y", "x"], "y": []}).expand(["x"])
    deep = symbols.Symbols({"a": {"w": 1}}, {f"w{i}": [f"w{i + 1}"] for i in range(5000)} | {"w5000": ["a"]})
    assert deep.expand(["w0"]) == ([("a", [])], [])
    df = spark.createDataFrame([("w", ["nested"]), ("x", ["a", "indicator_x", "b"]), ("digits", ["one(digit)", "one(digit)"]), ("ring", ["ring"]), ("none", [])], "word string, parts array<string>")
    db = symbols.Symbols(DB.chars, DB.words | {"ring": ["a", "ring"]}, paths=DB.paths)
    assert rows(symbols.expanded(df.where("word = 'w'"), db), "pos", "name") == [(0, "a"), (1, "b"), (2, "a")]
    placed = {}
    for r in symbols.laid_out(df, db).orderBy("word", "pos").collect():
        placed.setdefault(r.word, []).append((r.name, r.x, r.y, r.error))
    assert placed["x"] == [("a", 0.0, 0.0, None), ("indicator_x", 12.0, 0.0, None), ("b", 72.0, 0.0, None)]
    assert placed["digits"] == [("one(digit)", 0.0, 0.0, None), ("one(digit)", 46.0, 0.0, None)]
    assert placed["ring"] == [(None, None, None, "the word ring contains itself")] and "none" not in placed
    drawn = {r.word: (r.svg, r.error) for r in symbols.drawings(df, db).collect()}
    assert 'y1="256"' in drawn["x"][0] and 'viewBox="-32 -32 156 384"' in drawn["x"][0]
    assert drawn["ring"] == (None, "the word ring contains itself") and drawn["none"][0].endswith('viewBox="-32 -32 64 384"></svg>')


def test_symbol_forms(spark):
    """Names, lists, groups with offsets and all forms; a drawing that leads back to itself is told."""
    db = symbols.Symbols(
        {"c": {"w": 10, "d": ["s", {"x": 1, "y": 2, "d": {"x": 10, "d": "s"}}, {"form": "odd", "x": 1}]}, "wide": {"w": 50, "d": [{"form": "text", "x": 5, "y": 20, "w": 9, "h": 7, "fontsize": 12.5, "text": "a & b"}, {"form": "dot", "x": 1, "y": 1, "r": 99}]}},
        {}, shapes={"s": [{"form": "circle", "x": 3, "y": 4, "r": 2}], "round": "trip", "trip": ["round"]},
    )
    assert [(f["x"], f["dx"], f["dy"]) for f in db.forms("c")] == [(3, 0, 0), (3, 11, 2), (1, 0, 0)]
    with pytest.raises(symbols.Circular):
        db.forms("round")
    svg = {r.word: r.svg for r in symbols.drawings(spark.createDataFrame([("c", ["c"]), ("wide", ["wide"])], "word string, parts array<string>"), db, radius=3).collect()}
    assert svg["c"].endswith('><circle class="symbol-line" cx="3" cy="316" r="2"/><circle class="symbol-line" cx="14" cy="314" r="2"/></svg>')
    assert svg["wide"].endswith('><text class="symbol-text" text-anchor="middle" x="9.5" y="307" style="font-size:12.5">a &amp; b</text><circle class="symbol-dot" cx="1" cy="319" r="3"/></svg>')


def test_symbol_grid_and_parts(spark):
    lines = [tuple(r)[4:] for r in symbols.grid_lines(spark.createDataFrame([(0.0, 320.0, 0.0, 320.0)], "left double, right double, top double, bottom double"), 2).collect()]
    assert ("major", 0.0, 0.0, 0.0, 320.0) in lines and len(lines) == 6
    assert symbols.word_parts('words = {"a,b": ["x", "y"], "c": []}') == {"a,b": ["x", "y"], "c": []}


def test_traversal(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "b")], "parent string, child string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert rows(graph.reachable(e, roots)) == [("a", 1), ("b", 1), ("r", 0)]
    m = spark.createDataFrame([("r", "category", "a"), ("a", "file", "f1"), ("r", "file", "f1"), ("a", "category", "r"), ("x", "file", "f2")], "category string, kind string, title string")
    assert rows(graph.files_below(m, roots)) == [("f1",)]


def test_quality(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(quality.reconcile(a, b, "k", "a", "b")) == [("a", 3), ("b", 1)]
    plan = spark.createDataFrame([("l1", ["f"]), ("l2", ["g"]), ("l3", ["none"]), ("l4", ["f", "g"])], "line string, files array<string>")
    now = spark.createDataFrame([("f", "1"), ("g", "2")], "file string, hash string")
    memo = spark.createDataFrame([("f", "1"), ("g", "9")], "file string, hash string")
    assert rows(quality.stale(plan, now, memo)) == [("l2",), ("l4",)]
    good = '<svg width="15" height="15" viewBox="0 0 15 15"><path d="M0"/></svg>'
    df = spark.createDataFrame([(1, good), (2, '<svg width="16" height="15" viewBox="0 0 15 15"><rect/><path d="" d=""/><path transform="x"/></svg>')], "k long, m string")
    assert rows(quality.markup_problems(df, "m", "k")) == [(2, ["size", "banned_element", "paths", "transform", "repeated_attribute"])]
    layers = '<svg id="emoji" viewBox="0 0 72 72"><g id="grid"/><g id="color"><path fill="#FFF"/></g><g id="line" stroke="#123456"/></svg>'
    df = spark.createDataFrame([(1, layers), (2, layers.replace('"grid"', '"odd"'))], "k long, m string")
    assert rows(quality.layer_problems(df, "m", "k")) == [(2, ["layer_grid", "unknown_layer"])]
    assert rows(quality.colour_problems(df.where("k = 1"), "m", "k", ["#fff"])) == [(1, ["#123456"])]
    assert quality.balanced(plan, 3).where("shard between 0 and 2").count() == 4


def test_records(spark):
    r = spark.createDataFrame([("1F600", "", "a, b", "", "face", "2"), ("1F44B-1F3FB", "1", "hand", "x", "", ""), ("1F3FB", "", "tone", "", "", "x")], "hexcode string, skintone string, tags string, openmoji_tags string, `group` string, unicode string")
    assert rows(records.base_records(r), "hexcode") == [("1F600",)]
    assert rows(records.search(r, tags=["b", "x"]), "hexcode") == [("1F44B-1F3FB",), ("1F600",)] and records.search(r).count() == 3
    assert records.search(r, skintone=True).count() == 1
    t = records.typed(r, ["hexcode"]).orderBy("order").collect()
    assert [x.order for x in t] == [1, 2, 3] and [x.unicode for x in t] == [-1.0, -1.0, 2.0] and [x.skintone for x in t] == [-1.0, 1.0, -1.0]
    assert records.record_paths(r, "d").first().files.color.svg == "d/color/svg/1F600.svg"
    b = records.in_batches(spark.range(120).withColumnRenamed("id", "k"), "k", 50)
    assert sorted(x for row in b.collect() for x in row["keys"]) == list(range(120)) and all(len(row["keys"]) <= 50 for row in b.collect())
    assert records.missing_designs(r.withColumn("openmoji_author", F.lit(""))).count() == 1


def test_drawings(spark):
    svg = '<svg xmlns="http://www.w3.org/2000/svg" width="15px" height="15px" viewBox="0 0 15 15" fill="none"><g><title>x</title><path d="M0" style="a" /><circle r="1" /></g></svg>'
    df = spark.createDataFrame([(1, svg), (2, "<svg><g>")], "k long, m string")
    got = {r.k: r for r in drawings.rewritten(df, "k", "m", drawings.plain("icon"), drawings.unwrapped).collect()}
    assert got[1].svg == '<svg xmlns="http://www.w3.org/2000/svg" width="15" height="15" viewBox="0 0 15 15" id="icon"><path d="M0" /></svg>'
    assert got[2].svg is None and got[2].error.startswith("ParseError")
    root = drawings.parse('<svg viewBox="0 0 72 72"><g id="grid" /><g id="hair"><g><path fill="x" stroke="y" /></g></g></svg>')
    for step in (*drawings.toned("f", "s", "h"), drawings.mirrored(), drawings.without_layers(*drawings.COLOUR_LAYERS[:1])):
        step(root)
    path = root.find(".//path")
    assert path.get("fill") == "h" and path.get("stroke") == "y" and [g.get("id") for g in root] == ["hair"]


def test_incremental_plan_compares_every_document(spark):
    from sigilframe.plans import quality_queries

    sf = "/root/testdata/sf0.001"
    _, now, memo = quality_queries.hashed_documents(spark, sf)
    names = {f"f{r.doc_id}" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r.file for r in now.collect()} == names == {r.file for r in memo.collect()}


def test_numbers_of_a_table_larger_than_its_sample(spark):
    wide = spark.range(0, 300_000, 1, 8).select((F.col("id") * 7919 % 300_007).alias("k"), F.col("id").cast("string").alias("a"))
    got = records.numbered(wide, ["k"], "n")
    want = sorted(tuple(r) for r in wide.collect())
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(*r, i + 1) for i, r in enumerate(want)]


def test_codes_beyond_unicode(spark):
    codes = [("A", "0041-10FFFF", "A\U0010ffff"), ("B", "0041-110000", "A�"), ("C", "42-145000", "A�"), ("D", "0041-145000", None), ("E", "0041-D800-FFFD", "A��"), ("F", None, None), ("G", "0041-01F600", "A\U0001f600"), ("H", "0041-7FFFFFFF0", "A�")]
    df = spark.createDataFrame(codes, "k string, hexcode string, emoji string")
    assert rows(quality.code_mismatches(df), "k") == [("C",), ("D",), ("G",)]
    made = [r[0] for r in spark.createDataFrame([("41-145000-110000-D800-DFFF-10FFFF-E000",), (None,)], "h string").select(X.characters("h")).collect()]
    assert made == ["A����\U0010ffff", None]


@pytest.mark.parametrize("name", ["code_checks", "record_text"])
def test_part_keys_beyond_unicode(spark, tmp_path, name):
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 1_114_111 - 0x1F000 - 50).write.parquet(f"{tmp_path}/part.parquet")
    got = rows(record_queries.QUERIES[name][0](spark, str(tmp_path)))
    keys = [r.p_partkey for r in spark.read.parquet(f"{tmp_path}/part.parquet").collect()]
    if name == "code_checks":
        assert got == sorted(((k, f"42-{k + 0x1F000:X}") for k in keys if k % 9 == 4), key=repr)
    else:
        assert {r[0]: r[7] for r in got} == {k: "A" + (chr(k + 0x1F000) if k + 0x1F000 <= 0x10FFFF else "�") for k in keys}


@pytest.mark.parametrize("name", ["reachable", "leaves", "files_below"])
def test_rounds_broadcast_nothing(spark, tmp_path, monkeypatch, name):
    plans = []

    def seen(keep):
        def kept(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df)

        return kept

    for step in ("written", "settled"):
        monkeypatch.setattr(graph, step, seen(getattr(graph, step)))
    tree = spark.range(2, 64).select(F.expr("id div 2").alias("parent"), (F.col("id") % 2).alias("pos"), F.col("id").alias("child"))
    tree.write.parquet(f"{tmp_path}/tree")
    roots, tree = spark.createDataFrame([(2,)], "node long"), spark.read.parquet(f"{tmp_path}/tree")
    if name == "reachable":
        got, want = graph.reachable(tree, roots), [(k, d) for k in range(2, 64) for d in range(5) if k >> d == 2]
    elif name == "leaves":
        got, want = graph.leaves(tree, roots), [(2, [int(b) for b in f"{k - 32:04b}"], k) for k in range(32, 48)]
    else:
        members = tree.select(F.col("parent").alias("category"), F.lit("category").alias("kind"), F.col("child").alias("title"))
        files = tree.select(F.col("child").alias("category"), F.lit("file").alias("kind"), (F.col("child") + 1000).alias("title"))
        got, want = graph.files_below(members.unionByName(files), roots), [(k + 1000,) for k in range(3, 64) for d in range(1, 5) if k >> d == 2] + [(1002,)]
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert rows(got) == sorted(want, key=repr)
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_work_by_rows_is_dealt_to_all_tasks(spark):
    one = spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("word"), F.array(F.lit("sun")).alias("parts"), F.lit("<svg/>").alias("svg_in"))
    vocabulary = record_queries.SYMBOLS
    for df in (drawings.rewritten(one, "word", "svg_in"), symbols.expanded(one, vocabulary)):
        tasks = df.select("word", F.spark_partition_id().alias("p")).collect()
        assert sorted(int(r.word) for r in tasks) == list(range(100)) and len({r.p for r in tasks}) == 4
    for df in (symbols.laid_out(one, vocabulary), symbols.drawings(one, vocabulary)):
        assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()  # expanded once, before


@pytest.mark.parametrize(("few", "join"), [(20_000, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_few_boxes_dont_gather_points(spark, monkeypatch, few, join):
    monkeypatch.setattr(ocr, "FEW_BOXES", few, raising=False)
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    pts = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    boxes = spark.createDataFrame([(i, 5.0 * i, 0.0, 5.0 * i + 12, math.inf) for i in range(10)], "box_id long, x1 double, y1 double, x2 double, y2 double")
    got = ocr.contained(pts, boxes, "x", "y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert join in plan
    assert rows(got.groupBy("box_id").count()) == [(i, 20 * sum(5 * i <= k <= 5 * i + 12 for k in range(50))) for i in range(10)]
