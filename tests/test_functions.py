import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from sigilframe.functions import ocr as O
from sigilframe.functions import raster as R
from sigilframe.functions import text as X


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items()) or "x string"
    return spark.createDataFrame([tuple(cols.values()) or ("",)], schema).select(expr.alias("r")).first().r


@pytest.mark.parametrize("name,stem,suffix,label", [("x.tar.svg", "x.tar", ".svg", "x.tar"), (".svg", ".svg", "", ".svg"), ("a_b--c  d.PNG", "a_b--c  d", ".png", "a b c d"), ("plain", "plain", "", "plain"), ("a  b.svg", "a  b", ".svg", "a b")])
def test_names(spark, name, stem, suffix, label):
    assert one(spark, X.stem("n"), n=name) == stem
    assert one(spark, X.suffix("n"), n=name) == suffix
    assert one(spark, X.slug_label("n"), n=name) == label


@pytest.mark.parametrize("field,raw,want", [
    ("familiarity", "25", "2.50"), ("familiarity", "255", "2.55"), ("name_agreement", "4250", "42.50"), ("name_agreement", "425", "4.25"), ("name_agreement", "417.", "41.70"), ("complexity_metric", "14.", "14"),
    ("complexity_metric", "", ""), ("familiarity", ".", ""), ("familiarity", "3.4.5", "3.45"), ("concept_agreement", "1234.", "12.34"), ("complexity", "~4", "4.00"), ("name_agreement", "100", "1.00"), ("complexity_metric", "007", "7"), ("familiarity", "abc", ""),
])
def test_number_repair(spark, field, raw, want):
    assert one(spark, O.normalize_number(F.col("raw"), F.col("field")), field=field, raw=raw) == want


@pytest.mark.parametrize("field,value,conf,want", [("familiarity", "", 99.0, "missing_numeric"), ("familiarity", "x", 99.0, "invalid_numeric"), ("familiarity", "5.01", 99.0, "rating_out_of_range"), ("familiarity", "5.00", 84.9, "low_confidence"), ("familiarity", "1.00", 85.0, ""), ("complexity_metric", "101", 99.0, "complexity_metric_out_of_range"), ("complexity_metric", "100", 69.0, "low_confidence"), ("name_agreement", "100.00", 80.0, ""), ("name_agreement", "100.50", 80.0, "agreement_out_of_range")])
def test_reasons(spark, field, value, conf, want):
    assert one(spark, O.review_reason(F.col("field"), F.col("value"), F.col("conf")), field=field, value=value, conf=conf) == want


@pytest.mark.parametrize("reason,other,conf,other_conf,want", [("missing_numeric", "low_confidence", 0.0, 70.0, True), ("low_confidence", "", 60.0, 70.0, True), ("", "missing_numeric", 90.0, 99.0, False), ("low_confidence", "low_confidence", 60.0, 70.0, False), ("low_confidence", "low_confidence", 59.0, 70.0, True), ("missing_numeric", "missing_numeric", 0.0, 0.0, False)])
def test_fallback(spark, reason, other, conf, other_conf, want):
    assert one(spark, O.takes_fallback(*(F.col(c) for c in ("a", "b", "x", "y"))), a=reason, b=other, x=conf, y=other_conf) == want


def test_text_helpers(spark):
    assert one(spark, X.characters(F.col("h")), h="1F600-1F3FB") == "\U0001f600\U0001f3fb"
    assert one(spark, X.symbol_file(F.col("h")), h="Énergie, power (x)") == "energie"
    assert one(spark, X.symbol_file(F.col("h")), h="()") == "symbol"
    assert one(spark, X.fill_template(F.lit("{a}-{b}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-{b}"
    assert one(spark, X.short_label("h", 5), h="abcdefgh") == "abcd..." and one(spark, X.short_label("h", 8), h="abcdefgh") == "abcdefgh"
    assert one(spark, X.safe_name("h"), h="File:a/b.svg") == "a_b.svg"
    assert one(spark, X.component_name("h"), h="2-way-valve") == "Icon2WayValveIcon"
    assert one(spark, X.first_categories(F.expr("cast(array() as array<string>)"), F.expr("array('a','b','c','d')"))) == "a; b; c"
    assert one(spark, X.code_point("h"), h="E000") == 57344


def mask(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def test_components():
    diagonal = mask("#.", ".#")
    assert R.count_components(diagonal) == 1 and R.count_components(diagonal, False) == 2
    assert R.count_components(np.zeros((5, 5), bool)) == 0 and R.count_components(np.ones((5, 5), bool)) == 1
    board = np.indices((6, 6)).sum(0) % 2 == 0
    assert R.count_components(board) == 1 and R.count_components(board, False) == 18
    ring = mask("####", "#..#", "#..#", "####")
    assert R.count_components(ring, False) == 1
    assert R.component_boxes(mask("##..", "...#", "...#")) == [(0, 0, 2, 1, 2), (3, 1, 4, 3, 2)]
    snake = mask("#####", "....#", "#####", "#....", "#####")
    assert R.count_components(snake, False) == 1


def flood(m, diagonal):
    seen, n = np.zeros_like(m), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not seen[a, b]:
                seen[a, b] = True
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or i == 0 or j == 0]
    return n


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12))), st.booleans())
def test_components_equal_flood_fill(m, diagonal):
    assert R.count_components(m, diagonal) == flood(m, diagonal)


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(bool, (32, 32)))
def test_quadtree_tiles_the_image(m):
    leaves, variability, mean = R.quadtree(m)
    assert leaves * mean == 1024 and abs(variability * mean - 16) < 1e-9


def test_quadtree():
    assert R.quadtree(np.zeros((32, 32), bool))[0] == 1 and R.quadtree(np.ones((32, 32), bool))[0] == 1
    quarter = np.zeros((32, 32), bool)
    quarter[:16, :16] = True
    assert R.quadtree(quarter)[0] == 4


def test_edges():
    flat = np.ones((32, 32), np.float32)
    assert not R.edges(flat).any()
    square = flat.copy()
    square[8:24, 8:24] = 0
    e = R.edges(square)
    assert e.any() and not e[14:18, 14:18].any() and not e[:4].any()
    assert np.array_equal(R.dilate(mask("...", ".#.", "...")), np.ones((3, 3), bool))


def test_foreground():
    rgba = np.full((2, 2, 4), 255, np.uint8)
    rgba[0, 0, :3] = 10
    assert R.foreground(rgba).tolist() == [[True, False], [False, False]]
    rgba[1, 1, 3] = 0
    assert R.foreground(rgba).tolist() == [[True, True], [True, False]]


@settings(max_examples=30, deadline=None)
@given(hnp.arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9), st.just(4))))
def test_png_round_trip(x):
    assert np.array_equal(R.read_png(R.write_png(x)), x)


def test_png_filters():
    import struct
    import zlib

    r = np.random.default_rng(0)
    x = r.integers(0, 256, (5, 6, 3)).astype(int)
    rows, above = b"", np.zeros(18, int)
    for y in range(5):
        row, left, out = x[y].ravel(), np.concatenate([np.zeros(3, int), x[y].ravel()[:-3]]), None
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out = [row, row - left, row - above, row - (left + above) // 2, row - near][y]
        rows += bytes([y]) + (out % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert np.array_equal(R.read_png(png)[..., :3], x) and (R.read_png(png)[..., 3] == 255).all()
    with pytest.raises(ValueError):
        R.read_png(b"GIF89a")


def test_symbol_crop():
    assert R.symbol_box([], 330, 295, False) is None
    assert R.symbol_box([(300, 10, 320, 60, 500)], 330, 295, False) is None  # beside the symbol
    assert R.symbol_box([(50, 250, 90, 270, 500)], 330, 295, False) is None  # the next title
    assert R.symbol_box([(50, 250, 90, 270, 500)], 330, 295, True) == (42, 242, 98, 278)
    assert R.symbol_box([(50, 50, 90, 90, 900), (200, 200, 212, 212, 90)], 330, 295, True) == (42, 42, 98, 98)  # away from the anchor
    assert R.symbol_box([(50, 50, 90, 90, 900), (100, 100, 112, 112, 90)], 330, 295, True) == (42, 42, 120, 120)


def slow_edges(image):
    """Edges restated pixel by pixel."""
    h, w = image.shape
    at = lambda m, y, x: m[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    one = [[sum(k * at(image, y, x + d) for d, k in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)) / 16 for x in range(w)] for y in range(h)]
    two = [[sum(k * at(one, y + d, x) for d, k in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)) / 16 for x in range(w)] for y in range(h)]
    size, way = np.zeros((h, w)), {}
    for y in range(h):
        for x in range(w):
            right = sum(k * (at(two, y + d, x + 1) - at(two, y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            down = sum(k * (at(two, y + 1, x + d) - at(two, y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            size[y, x] = math.sqrt(right * right + down * down)
            best = max(((0, 1), (1, 1), (1, 0), (1, -1)), key=lambda s: abs(s[1] * right + s[0] * down) / math.hypot(*s))  # noqa: B023
            way[y, x] = best
    ridge = np.zeros((h, w))
    for (y, x), (dy, dx) in way.items():
        beside = [size[y + s * dy, x + s * dx] if 0 <= y + s * dy < h and 0 <= x + s * dx < w else 0 for s in (1, -1)]
        ridge[y, x] = size[y, x] if size[y, x] >= max(beside) else 0
    if not ridge.any():
        return ridge > 0
    high = max(np.percentile(ridge[ridge > 0], 85), 0.08)
    found = {(y, x) for y in range(h) for x in range(w) if ridge[y, x] >= high}
    todo = list(found)
    while todo:
        y, x = todo.pop()
        for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if p not in found and 0 <= p[0] < h and 0 <= p[1] < w and ridge[p] >= 0.4 * high:
                found.add(p)
                todo.append(p)
    out = np.zeros((h, w), bool)
    for p in found:
        out[p] = True
    return out


def test_edges_against_a_slow_restatement():
    y, x = np.mgrid[0:24, 0:24]
    shapes = [(math.cos(a) * (x - 11.3) + math.sin(a) * (y - 12.1) > 0).astype(float) for a in np.linspace(0.05, 2 * math.pi, 13)]
    shapes += [((x - 12.2) ** 2 + (y - 11.1) ** 2 < r * r).astype(float) for r in (3.3, 7.1, 10.2)] + [np.random.default_rng(k).integers(0, 2, (13, 17)).astype(float) for k in range(6)]
    for s in shapes:
        got = R.edges(s)
        assert np.array_equal(got, slow_edges(s)) and np.array_equal(R.edges(s.T), got.T) and np.array_equal(R.edges(s[::-1]), got[::-1])
    assert R.edges((x + y > 23).astype(float)).sum() <= 2 * 24


def png_of(samples, depth, kind, lace=False, extra=b""):
    """A PNG of samples (h, w, bands), rows filtered in turn."""
    h, w, bands = samples.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    body = b""
    for y0, x0, dy, dx in [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if lace else [(0, 0, 1, 1)]:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        bits = "".join if depth < 8 else None
        lines = [bytes(int(t[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(t), 8)) for t in ("".join(format(v, f"0{depth}b") for v in row.ravel()) for row in part)] if bits else [row.astype(">u2" if depth == 16 else "u1").tobytes() for row in part]
        step, above = max(1, bands * depth // 8), b"\0" * len(lines[0])
        for n, line in enumerate(lines):
            left, corner = b"\0" * step + line, b"\0" * step + above
            def paeth(i, left=left, corner=corner, above=above):
                p = left[i] + above[i] - corner[i]
                return min((left[i], above[i], corner[i]), key=lambda v: abs(p - v))
            guess = [lambda i: 0, lambda i: left[i], lambda i: above[i], lambda i: (left[i] + above[i]) // 2, paeth][n % 5]  # noqa: B023
            body += bytes([n % 5]) + bytes((v - guess(i)) & 255 for i, v in enumerate(line))
            above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(lace))) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("lace", [False, True])
@pytest.mark.parametrize(("depth", "kind"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (8, 4), (16, 4), (8, 6), (16, 6), (1, 3), (4, 3), (8, 3)])
def test_png_of_every_depth(depth, kind, lace):
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    r = np.random.default_rng(depth + kind)
    x = r.integers(0, 1 << depth, (11, 13, bands))
    palette = r.integers(0, 256, (256, 3)).astype(np.uint8)
    extra = b"".join(struct.pack(">I", len(b)) + n + b + b"\0" * 4 for n, b in ((b"PLTE", palette.tobytes()), (b"tRNS", bytes([7, 9])))) if kind == 3 else b""
    got = R.decode(png_of(x, depth, kind, lace, extra))
    if kind == 3:
        alpha = np.full(256, 255)
        alpha[:2] = 7, 9
        assert np.array_equal(got, np.concatenate([palette[x[..., 0]], alpha[x]], 2))
        return
    x = x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1)
    grey = x[..., :1].repeat(3, 2) if bands < 3 else x[..., :3]
    assert np.array_equal(got, np.concatenate([grey, x[..., -1:] if bands in (2, 4) else np.full((11, 13, 1), 255)], 2))


def gif_of(index, palette, clear=None, lace=False, least=4):
    """A GIF of one frame, with a code for each pixel and for runs already met."""
    h, w = index.shape
    rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if lace else range(h)
    known, bits, run, width = {bytes([i]): i for i in range(1 << least)}, "", b"", least + 1
    put = lambda code, text: format(code, f"0{width}b") + text
    bits, free = put(1 << least, bits), (1 << least) + 2
    for v in np.concatenate([index[y] for y in rows]).tolist():
        if run + bytes([v]) in known:
            run += bytes([v])
            continue
        bits = put(known[run], bits)
        if free < 4096:
            known[run + bytes([v])] = free
            free += 1
            width = min(12, max(width, (free - 1).bit_length()))
        run = bytes([v])
    bits = put((1 << least) + 1, put(known[run], bits))
    data = bytes(int(bits[max(0, i - 8) : i], 2) for i in range(len(bits), 0, -8))
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    control = b"\x21\xf9\x04" + bytes([clear is not None, 0, 0, clear or 0, 0])
    return b"GIF89a" + struct.pack("<HHBBB", w + 3, h + 2, 0x80 | 3, 0, 0) + palette.tobytes() + b"\x21\xfe\x03abc\0" + control + b"\x2c" + struct.pack("<HHHHB", 2, 1, w, h, 0x40 * lace) + bytes([least]) + blocks + b"\x3b"


@pytest.mark.parametrize("lace", [False, True])
@pytest.mark.parametrize("kind", ["runs", "noise"])
def test_gif(lace, kind):
    r = np.random.default_rng(3)
    index = r.integers(0, 16, (90, 110)).astype(np.uint8) if kind == "noise" else (np.arange(90 * 110).reshape(90, 110) // 37 % 5).astype(np.uint8)
    palette = r.integers(0, 256, (16, 3)).astype(np.uint8)
    got = R.decode(gif_of(index, palette, 3, lace))
    assert got.shape == (92, 113, 4) and not got[0].any() and not got[:, :2].any()
    assert np.array_equal(got[1:91, 2:112, :3], palette[index]) and np.array_equal(got[1:91, 2:112, 3], np.where(index == 3, 0, 255))
    with pytest.raises((ValueError, IndexError)):  # a failure row either way
        R.decode(gif_of(index, palette)[:-40] + b"\0\x3b")
