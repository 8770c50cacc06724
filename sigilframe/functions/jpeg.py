"""A reader of baseline JPEG images: grey or colour, any sampling of the components, one scan or several, restart intervals, the usual Huffman tables where an image
brings none, and the orientation that its camera noted."""

from __future__ import annotations

import re
import struct

import numpy as np

# The usual Huffman tables (numbers of codes by length; symbols). Symbols of AC coefficients are a run of zeros and a size, in
# order of frequency at first and in ascending order from there on.
DC_COUNTS = {0: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 1: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]}
AC_COUNTS = {0: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], 1: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]}
AC_FIRST = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}
BROKEN = (ValueError, IndexError, KeyError, struct.error)
MOST_BLOCKS = 1 << 22
BAND = 64  # rows of blocks that are worked out together


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def zigzag() -> np.ndarray:
    """Row-major places of the coefficients in the order of their diagonals, whose direction alternates."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 1 / 2) * np.cos((2 * x + 1) * k * np.pi / 16)


def huffman(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol, and the length of its code (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            symbol[lo:hi], length[lo:hi] = symbols[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def usual_tables() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    every = {0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
    out = {}
    for k in (0, 1):
        first = list(bytes.fromhex(AC_FIRST[k]))
        out[k] = huffman(DC_COUNTS[k], list(range(12)))
        out[0x10 | k] = huffman(AC_COUNTS[k], first + sorted(every - set(first)))
    return out


ZIGZAG, COSINES, _USUAL = zigzag(), cosines(), {}


class Scan:
    """Coefficients of one restart interval, read bit by bit from a table of the next 16 bits."""

    def __init__(self, data: bytes):
        bits = np.unpackbits(np.frombuffer(data.rstrip(b"\xff").replace(b"\xff\x00", b"\xff"), np.uint8))
        self.end = len(bits)
        bits = np.concatenate([bits, np.ones(64, np.uint8)]).astype(np.uint32)
        ahead = np.zeros(len(bits) - 16, np.uint32)
        for k in range(16):
            ahead |= bits[k : k + len(ahead)] << np.uint32(15 - k)
        self.ahead, self.at = ahead.tolist(), 0

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.ahead[self.at] >> (16 - size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        word = self.ahead[self.at]
        n = int(table[1][word])
        if not n or self.at > self.end:
            raise ValueError("broken scan")
        self.at += n
        return int(table[0][word])

    def block(self, out: np.ndarray, last: int, dc: tuple, ac: tuple) -> int:
        """Fills the coefficients of a block, in zigzag order; returns its DC value."""
        out[0] = last = last + self.value(self.symbol(dc))
        k = 1
        while k < 64:
            s = self.symbol(ac)
            if not s & 15:
                if s != 0xF0:
                    break
                k += 16
                continue
            k += s >> 4
            out[k] = self.value(s & 15)
            k += 1
        return last


def decode_jpeg(data: bytes, most_blocks: int | None = MOST_BLOCKS) -> np.ndarray:
    """A baseline JPEG image: (height, width) or, of three components, (height, width, 3) in red, green and blue. An image of more than most_blocks blocks of 64 pixels, all components together,
    is refused, as a block takes about 500 bytes of memory; None reads any."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, every, steps, tables, size, parts = 2, 0, {}, {}, None, {}
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("broken marker")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = huffman(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8 or count not in (1, 3) or not height or not width:
                raise ValueError("only 8-bit images of one or three components are read")
            size = height, width
            for k in range(count):
                name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                parts[name] = {"h": hv >> 4, "v": hv & 15, "q": q}
            wide, high = max(p["h"] for p in parts.values()), max(p["v"] for p in parts.values())
            across, down = -(-width // (8 * wide)), -(-height // (8 * high))
            if most_blocks is not None and across * down * sum(p["h"] * p["v"] for p in parts.values()) > most_blocks:
                raise ValueError(f"more than {most_blocks} blocks")
            for p in parts.values():
                p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64), np.int32)
                p["own"] = -(-(-(-height * p["v"] // high)) // 8), -(-(-(-width * p["h"] // wide)) // 8)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline images are read")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if not size:
                raise ValueError("a scan without a frame")
            _USUAL.update({} if _USUAL else usual_tables())
            chosen = [(parts[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            if not stop:
                raise ValueError("the scan has no end")
            _read_scan(data[at : stop.start()], chosen, tables, every, (down, across))
            at = stop.start()
    if not size:
        raise ValueError("no frame")
    planes = []
    for p in parts.values():
        y, x, _ = p["blocks"].shape
        pixels = np.empty((8 * y, 8 * x), np.float32)
        for i in range(0, y, BAND):  # coefficients become numbers for some rows of blocks at a time
            b = np.zeros((min(BAND, y - i), x, 64))
            b[..., ZIGZAG] = p["blocks"][i : i + BAND] * steps[p["q"]]
            pixels[8 * i : 8 * (i + len(b))] = (COSINES.T @ b.reshape(-1, x, 8, 8) @ COSINES + 128).transpose(0, 2, 1, 3).reshape(-1, 8 * x)
        planes.append(pixels.repeat(high // p["v"], 0).repeat(wide // p["h"], 1)[: size[0], : size[1]])
    if len(planes) == 1:
        return planes[0].round().clip(0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2).round().clip(0, 255).astype(np.uint8)


def _read_scan(data: bytes, chosen: list[tuple[dict, int]], tables: dict, every: int, grid: tuple[int, int]) -> None:
    """Units of a scan: one block of a single component, in rows of its own; else each component's blocks of a square of the image."""
    one = len(chosen) == 1
    rows, across = chosen[0][0]["own"] if one else grid
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if every else [data]
    if len(pieces) < (-(-rows * across // every) if every else 1):
        raise ValueError("restart intervals are missing")
    look = {k: tables.get(k, _USUAL.get(k)) for k in {t for _, x in chosen for t in (x >> 4, 0x10 | x & 15)}}
    for n, piece in enumerate(pieces):
        scan, last = Scan(piece), [0] * len(chosen)
        for unit in range(n * every, min((n + 1) * every, rows * across) if every else rows * across):
            for c, (p, x) in enumerate(chosen):
                for k in range(1 if one else p["h"] * p["v"]):
                    y, z = (unit // across, unit % across) if one else (unit // across * p["v"] + k // p["h"], unit % across * p["h"] + k % p["h"])
                    last[c] = scan.block(p["blocks"][y, z], last[c], look[x >> 4], look[0x10 | x & 15])


def orientation(data: bytes) -> int:
    """The orientation of an image's EXIF part, 1 to 8; 1 where there is none, or none that can be read."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tag(body[6:])
        at += 2 + n
    return 1


def _tag(tiff: bytes) -> int:
    """Tag 0x0112 of the first directory of a TIFF header."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return 1
    try:
        at = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112:
                return value if kind == 3 and 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def upright(image: np.ndarray, how: int) -> np.ndarray:
    """An image turned and mirrored as its orientation asks: 2 mirrored, 3 upside down, 4 both, 5 to 8 with rows and columns exchanged."""
    if how >= 5:
        image = image.swapaxes(0, 1)
    if how in (3, 4, 7, 8):
        image = image[::-1]
    if how in (2, 3, 6, 7):
        image = image[:, ::-1]
    return image


def read_jpeg(data: bytes, most_blocks: int | None = MOST_BLOCKS) -> np.ndarray:
    """(h, w, 4), 0 to 255, upright; a JPEG image is opaque."""
    image = upright(decode_jpeg(data, most_blocks), orientation(data))
    if image.ndim == 2:
        image = image[..., None].repeat(3, 2)
    return np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], 2)
