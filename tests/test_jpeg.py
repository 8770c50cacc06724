import math
import struct

import numpy as np
import pytest

from sigilframe.functions import jpeg as J
from sigilframe.functions import raster as R
from sigilframe.operators import raster


def codes_of(counts, symbols):
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = format(code, f"0{bits}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def jpeg_of(planes, factors, size, every=0, tables=True, split=False):
    """A baseline encoder: planes of whole blocks, sampled by factors; quantisers of one."""
    every_symbol = {0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))}
    dc, ac = {}, {}
    for k in (0, 1):
        first = list(bytes.fromhex(J.AC_FIRST[k]))
        dc[k], ac[k] = list(range(12)), first + sorted(every_symbol - set(first))
    code = {k: (codes_of(J.DC_COUNTS[k], dc[k]), codes_of(J.AC_COUNTS[k], ac[k])) for k in (0, 1)}
    basis = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    order = [(0, 0)]
    while len(order) < 64:  # walks the diagonals
        y, x = order[-1]
        up = (y + x) % 2 == 0
        order.append((y, x + 1) if up and y == 0 and x < 7 else (y + 1, x) if up and x == 7 else (y - 1, x + 1) if up else (y + 1, x) if x == 0 and y < 7 else (y, x + 1) if y == 7 else (y + 1, x - 1))

    def bits_of(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(c, y, x, last):
        z = np.rint(basis @ (planes[c][8 * y : 8 * y + 8, 8 * x : 8 * x + 8] - 128.0) @ basis.T).astype(int)
        flat, k, run = [int(z[p]) for p in order], min(c, 1), 0
        n, text = bits_of(flat[0] - last)
        out = code[k][0][n] + text
        for v in flat[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                out, run = out + code[k][1][0xF0], run - 16
            n, text = bits_of(v)
            out, run = out + code[k][1][run << 4 | n] + text, 0
        return out + (code[k][1][0] if run else ""), flat[0]

    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([1] * 64))
    if tables:
        out += seg(0xC4, b"".join(bytes([t << 4 | k]) + bytes(counts[k]) + bytes(symbols[k]) for t, counts, symbols in ((0, J.DC_COUNTS, dc), (1, J.AC_COUNTS, ac)) for k in (0, 1)))
    out += seg(0xC0, struct.pack(">BHHB", 8, *size, len(planes)) + b"".join(bytes([c + 1, f[0] << 4 | f[1], 0]) for c, f in enumerate(factors)))
    out += seg(0xDD, struct.pack(">H", every)) if every else b""
    for scan in [[c] for c in range(len(planes))] if split or len(planes) == 1 else [list(range(len(planes)))]:
        out += seg(0xDA, bytes([len(scan)]) + b"".join(bytes([c + 1, min(c, 1) * 17]) for c in scan) + bytes([0, 63, 0]))
        if len(scan) == 1:
            f = factors[scan[0]]
            units = [[(scan[0], y, x)] for y in range(-(-(-(-size[0] * f[1] // v)) // 8)) for x in range(-(-(-(-size[1] * f[0] // h)) // 8))]
        else:
            units = [[(c, y * f[1] + k // f[0], x * f[0] + k % f[0]) for c, f in enumerate(factors) for k in range(f[0] * f[1])] for y in range(-(-size[0] // (8 * v))) for x in range(-(-size[1] // (8 * h)))]
        for n, i in enumerate(range(0, len(units), every or len(units))):
            last, text = [0] * len(planes), ""
            for c, y, x in (b for u in units[i : i + (every or len(units))] for b in u):
                more, last[c] = block(c, y, x, last[c])
                text += more
            text += "1" * (-len(text) % 8)
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")
    return out + b"\xff\xd9"


FACTORS = [[(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]]


def some(factors, size=(37, 45), seed=5):
    r = np.random.default_rng(seed)
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    down, across = -(-size[0] // (8 * v)), -(-size[1] // (8 * h))
    planes = [np.clip(128 + 60 * r.normal(size=(8 * down * f[1], 8 * across * f[0])).cumsum(1) / 4, 0, 255) for f in factors]
    full = [p.repeat(v // f[1], 0).repeat(h // f[0], 1)[: size[0], : size[1]] for p, f in zip(planes, factors, strict=True)]
    if len(full) == 1:
        return planes, full[0][..., None].repeat(3, 2)
    y, b, c = full[0], full[1] - 128, full[2] - 128
    return planes, np.stack([y + 1.402 * c, y - 0.344136 * b - 0.714136 * c, y + 1.772 * b], 2).clip(0, 255)


@pytest.mark.parametrize("factors", FACTORS)
@pytest.mark.parametrize("options", [{}, {"every": 2}, {"tables": False}, {"split": True, "every": 3}])
def test_jpeg_of_every_sampling(monkeypatch, factors, options):
    planes, want = some(factors)
    data = jpeg_of(planes, factors, want.shape[:2], **options)
    got = R.decode(data)
    assert got.shape == (37, 45, 4) and (got[..., 3] == 255).all() and np.abs(got[..., :3].astype(int) - want).max() <= 8
    monkeypatch.setattr(J, "BAND", 1)
    assert np.array_equal(R.decode(data), got)


# Where the first row and the first column of a stored image are shown, by its orientation.
SHOWN = {1: ("top", "left"), 2: ("top", "right"), 3: ("bottom", "right"), 4: ("bottom", "left"), 5: ("left", "top"), 6: ("right", "top"), 7: ("right", "bottom"), 8: ("left", "bottom")}


@pytest.mark.parametrize("how", range(1, 9))
@pytest.mark.parametrize("order", ["<", ">"])
def test_jpeg_orientation(how, order):
    shown = np.arange(6 * 4).reshape(6, 4)
    row, column = SHOWN[how]
    stored = np.empty((6, 4) if row in ("top", "bottom") else (4, 6), int)
    for i in range(stored.shape[0]):
        for k in range(stored.shape[1]):
            y, x = (i, k) if row in ("top", "bottom") else (k, i)
            stored[i, k] = shown[5 - y if "bottom" in (row, column) else y, 3 - x if "right" in (row, column) else x]
    assert np.array_equal(J.upright(stored, how), shown)
    planes, want = some([(1, 1)], (16, 24))
    exif = b"Exif\0\0" + (b"II" if order == "<" else b"MM") + struct.pack(order + "HIHHHIHHHHII", 42, 8, 2, 0x0100, 3, 1, 16, 0, 0x0112, 3, 1, how << (16 if order == ">" else 0))
    data = jpeg_of(planes, [(1, 1)], (16, 24))
    turned = data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data[2:]
    assert J.orientation(turned) == how and J.orientation(data) == 1
    assert np.array_equal(R.decode(turned), J.upright(R.decode(data), how))


def test_broken_jpeg_is_a_row(spark):
    planes, want = some([(1, 1)], (16, 24))
    good = jpeg_of(planes, [(1, 1)], (16, 24))
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    bad = {"cut": good[: len(good) // 2], "kind": progressive, "empty": b"\xff\xd8", "none": None, "text": b"x", "exif": good[:2] + b"\xff\xe1\x00\x0aExif\0\0II" + good[2:]}
    df = spark.createDataFrame([("good", good), *bad.items()], "icon_id string, content binary")
    got = {r.icon_id: r for r in raster.normalized(df, side=32).collect()}
    assert got["good"].error is None and got["exif"].error is None and R.decode(bytes(got["good"].content)).shape == (32, 32, 4)
    assert all(got[k].error and got[k].content is None for k in ("cut", "kind", "empty", "none", "text"))
    with pytest.raises(ValueError, match="more than 5 blocks"):
        J.read_jpeg(good, 5)
    assert np.array_equal(J.read_jpeg(good, 6), J.read_jpeg(good, None))
