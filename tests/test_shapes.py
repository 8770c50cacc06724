import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from sigilframe.functions import batches
from sigilframe.functions import raster as R
from sigilframe.functions import shapes
from sigilframe.operators import raster, shapes as ops

MASKS = hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12)))


def drawn(text):
    return np.array([[c == "#" for c in row] for row in text.split()])


RINGS = drawn("""
#########
#.......#
#.#####.#
#.#...#.#
#.#.#.#.#
#.#...#.#
#.#####.#
#.......#
#########""")


def test_contours_of_nested_rings():
    found = shapes.contours(RINGS)
    assert [(c.outer, c.depth, c.length, c.area) for c in sorted(found, key=lambda c: c.depth)] == [(True, 0, 36, 81), (False, 1, 28, 49), (True, 2, 20, 25), (False, 3, 12, 9), (True, 4, 4, 1)]
    assert all((found[c.parent].depth == c.depth - 1) if c.parent >= 0 else c.depth == 0 for c in found)
    # Two diagonal pixels are one part, and the gap of a diagonal ring is a hole.
    assert [c.length for c in shapes.contours(drawn("#. .#"))] == [8]
    assert sorted(c.outer for c in shapes.contours(drawn(".#. #.# .#."))) == [False, True]
    assert shapes.contours(np.zeros((3, 4), bool)) == [] and shapes.outline(np.zeros((2, 2), bool)) == (0, 0, 0, 0)


@settings(max_examples=150, deadline=None)
@given(MASKS)
def test_contours_agree_with_components(m):
    found = shapes.contours(m)
    holes = len(R.component_boxes(np.pad(~m, 1, constant_values=True))) - 1
    assert sum(c.outer for c in found) == R.count_components(m) and sum(not c.outer for c in found) == holes
    p = np.pad(m, 1)
    assert sum(c.length for c in found) == int((p[1:] != p[:-1]).sum() + (p[:, 1:] != p[:, :-1]).sum())
    assert sum(c.area if c.outer else -c.area for c in found) == m.sum()
    # Euler number by 2 x 2 windows: (corners of one pixel - corners of three - 2 x diagonals) / 4.
    q = p.astype(int)
    w = q[:-1, :-1] + q[1:, :-1] + q[:-1, 1:] + q[1:, 1:]
    diagonal = (w == 2) & (q[:-1, :-1] == q[1:, 1:])
    assert sum(1 if c.outer else -1 for c in found) == ((w == 1).sum() - (w == 3).sum() - 2 * diagonal.sum()) // 4
    assert all(c.parent < 0 or found[c.parent].outer != c.outer for c in found)


def test_occupancy_symmetry_and_fill():
    m = np.zeros((10, 10), bool)
    m[2:6, 1:9] = True
    assert shapes.occupancy(m) == (0.32, 1.0) and shapes.symmetry(m) == (1.0, 1.0) and shapes.inside_share(m) == 12 / 32
    assert shapes.symmetry(drawn("#.. ### #..")) == (3 / 7, 1.0)
    assert shapes.inside_share(drawn("####")) == 0 and shapes.occupancy(np.zeros((4, 4), bool)) == (0.0, 0.0) and shapes.symmetry(np.zeros((4, 4), bool)) == (1.0, 1.0)
    r = np.random.default_rng(0)
    assert shapes.compressed_share(np.zeros((64, 64), bool)) < 0.1 < 0.9 < shapes.compressed_share(r.random((64, 64)) < 0.5)


@pytest.mark.parametrize("degrees", [0, 20, 70, 90, 110, 160])
def test_hog_of_turned_half_planes(degrees):
    """A half plane's gradients lie in the bins around the direction across its edge."""
    y, x = np.indices((32, 32)) - 15.5
    t = np.radians(degrees)
    smooth = 1 / (1 + np.exp(-(x * np.cos(t) + y * np.sin(t)) / 2))
    h = shapes.hog(smooth, 8, 9, 2).reshape(-1, 9).sum(0)
    near = {int(np.floor(degrees % 180 / 20 - 0.5)) % 9, int(np.floor(degrees % 180 / 20 + 0.5)) % 9}
    assert int(h.argmax()) in near and h[list(near)].sum() > 0.8 * h.sum()


def test_hog_against_loops():
    r = np.random.default_rng(1)
    image, cell, bins = r.random((13, 17)), 4, 9
    p = np.pad(image, 1, mode="edge")
    cells = np.zeros((3, 4, bins))
    for y in range(12):
        for x in range(16):
            gx, gy = p[y + 1, x + 2] - p[y + 1, x], p[y + 2, x + 1] - p[y, x + 1]
            place = np.degrees(np.arctan2(gy, gx)) % 180 / 20 - 0.5
            low = int(np.floor(place))
            cells[y // cell, x // cell, low % bins] += np.hypot(gx, gy) * (low + 1 - place)
            cells[y // cell, x // cell, (low + 1) % bins] += np.hypot(gx, gy) * (place - low)
    want = [cells[i : i + 2, j : j + 2].ravel() for i in range(2) for j in range(3)]
    assert np.allclose(shapes.hog(image, cell, bins), np.concatenate([v / np.sqrt((v * v).sum() + 1e-10) for v in want]))
    assert len(shapes.hog(np.zeros((5, 5)))) == 0


def test_ssim():
    r = np.random.default_rng(2)
    a, b = r.random((12, 15)), r.random((12, 15))
    want = []
    for i in range(6):
        for j in range(9):
            x, y = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            cov = ((x - x.mean()) * (y - y.mean())).mean()
            want.append((2 * x.mean() * y.mean() + 1e-4) * (2 * cov + 9e-4) / ((x.mean() ** 2 + y.mean() ** 2 + 1e-4) * (x.var() + y.var() + 9e-4)))
    assert abs(shapes.ssim(a, b) - np.mean(want)) < 1e-9 and abs(shapes.ssim(a, a) - 1) < 1e-12 and shapes.ssim(a, b) == shapes.ssim(b, a)
    assert abs(shapes.ssim(np.zeros((2, 2)), np.zeros((2, 2))) - 1) < 1e-12
    with pytest.raises(ValueError):
        shapes.ssim(a, b[:5])


def test_shape_rows(spark):
    rgba = np.zeros((9, 9, 4), np.uint8)
    rgba[..., 3] = RINGS * 255
    small = rgba[:4]
    df = spark.createDataFrame([("a", R.write_png(rgba)), ("b", R.write_png(small)), ("bad", b"x"), ("none", None)], "icon_id string, content binary")
    rows = {}
    for r in ops.contours(df).collect():
        rows.setdefault(r.icon_id, []).append(r)
    assert len(rows["a"]) == 5 and sorted(r.depth for r in rows["a"]) == [0, 1, 2, 3, 4] and rows["bad"][0].error and rows["none"][0].error.startswith("FileNotFoundError")
    got = {r.icon_id: r for r in raster.extract(df, extractors=ops.EXTRACTORS).collect()}
    assert (got["a"].contours, got["a"].holes, got["a"].perimeter, got["a"].nesting) == (5, 2, 100, 4) and got["bad"].contours is None
    assert {r.icon_id: r.error is None for r in ops.hog(df, cell=4).collect()} == {"a": True, "b": True, "bad": False, "none": False}
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "bad"), ("a", "gone")], "source string, target string")
    scored = {r.target: (r.ssim, r.error) for r in ops.similar(pairs, df).collect()}
    assert scored["a"] == (1.0, None) and "sizes" in scored["b"][1] and scored["gone"][1].startswith("FileNotFoundError") and scored["bad"][1]


def test_page_crops(spark):
    page = np.full((20, 30), 100, np.uint8)
    page[5:9, 4:20] = 60
    page[5, 4], page[6, 5] = 50, 150
    df = spark.createDataFrame([("p", R.write_png(R.opaque(page))), ("bad", b"x"), ("gone", None)], "page string, content binary")
    boxes = [("p", "in", 4, 5, 10, 9, 3), ("p", "over", 28, 18, 33, 22, 1), ("p", "flat", 20, 10, 25, 15, 2), ("p", "empty", 3, 3, 3, 9, 1), ("bad", "broken", 0, 0, 2, 2, 1), ("gone", "missing", 0, 0, 2, 2, 1), ("none", "no page", 0, 0, 2, 2, 1)]
    got = {r.key: r for r in raster.page_crops(df, spark.createDataFrame(boxes, "page string, key string, x1 int, y1 int, x2 int, y2 int, times int")).collect()}
    assert {k: r.error is None for k, r in got.items()} == {"in": True, "over": True, "flat": True, "empty": False, "broken": False, "missing": False, "no page": False}
    inside = R.luma(R.decode(bytes(got["in"].content)))
    assert inside.shape == (12, 18) and inside.min() == 0 and inside.max() == 255
    over = R.luma(R.decode(bytes(got["over"].content)))
    assert over.tolist() == [[255, 255, 0, 0, 0]] * 2 + [[0] * 5] * 2
    assert (R.luma(R.decode(bytes(got["flat"].content))) == 100).all()


def test_crops_in_small_batches(spark, monkeypatch):
    """A task decodes no more pages than a batch of its rows needs, and gives rows on before it goes on: many pages, and one page of many boxes."""
    made, seen = [], []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, *_: made.append(run) or self)

    def decode(raw):
        seen.append(raw)
        return np.full((8, 8, 4), 9, np.uint8)

    pages = spark.createDataFrame([("p", b"x")], "page string, content binary")
    boxes = spark.createDataFrame([("p", "k", 0, 0, 2, 2, 1)], "page string, key string, x1 int, y1 int, x2 int, y2 int, times int")
    raster.page_crops(pages, boxes, decode=decode)
    raster.levels(pages, "page", decode=decode)
    raster.vector_bytes(spark.createDataFrame([(1, [1.0])], "key long, v array<double>"), "key", "v")
    crops, levels, vectors = made
    box = {"key": "k", "x1": 0, "y1": 0, "x2": 2, "y2": 2, "times": 1}
    n = 3 * batches.ROWS
    for run, batch, rows in (
        (crops, {"content": [b"x"] * n, "_boxes": [[box, box]] * n}, 2 * n),
        (crops, {"content": [b"x"], "_boxes": [[box] * n]}, n),
        (levels, {"page": ["p"] * n, "content": [b"x"] * n}, n),
        (vectors, {"key": list(range(n)), "v": [[1.0, None]] * n}, n),
    ):
        seen.clear()
        out = run(iter([pa.RecordBatch.from_pydict(batch)]))
        sizes = [next(out).num_rows]
        assert len(seen) <= batches.ROWS
        sizes += [b.num_rows for b in out]
        assert max(sizes) <= batches.ROWS and sum(sizes) == rows
    schema = pa.schema([("content", pa.binary())])
    assert [b.num_rows for b in batches.batched(((bytes(batches.BYTES // 2),) for _ in range(5)), schema)] == [2, 2, 1]
    assert list(batches.batched(iter(()), schema)) == []


def test_stretch_and_enlarge():
    x = np.array([[10, 20], [30, 60]], np.uint8)
    assert R.stretched(x).tolist() == [[0, 51], [102, 255]] and R.stretched(x[:1, :1]).tolist() == [[10]] and R.stretched(x[:0]).size == 0
    r = np.random.default_rng(1)
    y = np.concatenate([r.integers(100, 150, 98), [0, 255]]).astype(np.uint8)
    assert R.stretched(y, 0.01)[y == y[:98].max()].min() == 255 and R.stretched(y, 0.01)[y == y[:98].min()].max() == 0
    flat = np.full((3, 5), 77, np.uint8)
    assert (R.enlarged(flat, 4) == 77).all() and R.enlarged(flat, 4).shape == (12, 20) and R.enlarged(x, 1) is x
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    wide = R.enlarged(ramp, 2).astype(int)
    assert np.abs(wide[3, 4:-4] - ((np.arange(40) + 0.5) / 2 - 0.5)[4:-4] * 10).max() <= 0.51  # a cubic keeps straight lines
    assert R.luma(np.array([[[255, 0, 0, 0], [0, 255, 0, 9], [0, 0, 255, 255], [255, 255, 255, 255]]], np.uint8)).tolist() == [[76, 150, 29, 255]]
