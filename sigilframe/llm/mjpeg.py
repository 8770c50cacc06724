"""Media columns: AVI files of motion-JPEG frames.

A payload of bytes becomes a greyscale video without loss: each byte is the grey level of one 8 x 8 block. The block has
a DC coefficient only, the quantiser's DC step is 8, so the decoded level is exactly the byte. The Huffman table gives a
difference of category s a code of 9 - s bits, so code and value bits are 9 together, and the end-of-block code has 7:
every block takes 16 bits, and whole scans are packed and unpacked as arrays. The frames are plain baseline JPEG.

Reading parses the RIFF chunks and the idx1 index, decodes the intra frames, and finds shots where the difference of the
frames' histograms stands out from its surroundings. Frames of the packed form above are decoded by a table, all others by a baseline decoder: grey or colour, any
sampling of the components, one scan or several, restart intervals, and the usual Huffman tables where a frame brings none, as motion JPEG may.
Media are a column of a table in the shared folder, written there and read back; everything else is local to a row, and there is no shuffle.

Nulls and odd rows: a null or empty text is an empty payload, stored as 64 zero bytes; very long texts become more
frames; repeated rows get equal media. doc_id is carried as it is, null included. Media that are null or broken, or have frames of another kind (progressive,
arithmetic or lossless coding, or more blocks than `read_media` is told to read), give a row without payload and clips whose `error` says why.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilframe.functions.jpeg import BROKEN, MOST_BLOCKS, decode_jpeg, grey

from .shared import map_rows, stored

SIDE = 32  # blocks to a side of a frame
SAMPLES = SIDE * SIDE
FPS = 25
UNIT = 64
BINS = 16

_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])
_VALUE = np.array([d if d >= 0 else d + (1 << abs(d).bit_length()) - 1 for d in range(-255, 256)])
_PREFIX = ((1 << (8 - _CATEGORY)) - 1) << 1  # 8 - s ones and a zero
WORDS = (((_PREFIX << _CATEGORY) | _VALUE) << 7).astype(np.uint16)
DIFFS = np.zeros(512, np.int16)
DIFFS[WORDS >> 7] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


_DQT = _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63)
_SOF = _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
_DC = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
_AC = _segment(0xC4, bytes([0x10]) + bytes([0] * 6 + [1] + [0] * 9) + bytes([0]))
_SOS = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
HEAD = b"\xff\xd8" + _DQT + _SOF + _DC + _AC + _SOS
TAIL = b"\xff\xd9"


def jpeg_frames(payload: np.ndarray) -> list[bytes]:
    """Frames of SAMPLES bytes each, the last filled up with zeros."""
    n = max(1, -(-len(payload) // SAMPLES))
    x = np.zeros((n, SAMPLES), np.int16)
    x.reshape(-1)[: len(payload)] = payload
    d = np.empty_like(x)
    d[:, 0] = x[:, 0] - 128
    np.subtract(x[:, 1:], x[:, :-1], out=d[:, 1:])
    words = WORDS[d + 255].astype(">u2")
    return [HEAD + w.tobytes().replace(b"\xff", b"\xff\x00") + TAIL for w in words]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds the payload; its length is in the INFO list."""
    frames = jpeg_frames(np.frombuffer(payload, np.uint8))
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE * 8, SIDE * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE * 8, SIDE * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE * 8, SIDE * 8, 1, 24, b"MJPG", SIDE * SIDE * 64 * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(len(payload)).encode()))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _walk(data: bytes, start: int, end: int):
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, size
        start += 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """fps, the comment, and the frames' bytes by the idx1 index (by the movi list where there is no index)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, movi, index = {"fps": float(FPS), "comment": b"", "frames": []}, None, None
    for name, at, size in _walk(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, a, _ in _walk(data, at + 4, at + size):
                if n == b"avih":
                    out["fps"] = 1e6 / max(1, struct.unpack_from("<I", data, a)[0])
        elif name == b"LIST" and kind == b"INFO":
            out["comment"] = next((data[a : a + s] for n, a, s in _walk(data, at + 4, at + size) if n == b"ICMT"), b"")
        elif name == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        for i in range(index[0], index[0] + index[1] - 15, 16):
            if data[i + 2 : i + 4] in (b"dc", b"db"):
                off, size = struct.unpack_from("<II", data, i + 8)
                at = movi[0] + off
                out["frames"].append(data[at + 8 : at + 8 + size])
    else:
        out["frames"] = [data[a : a + s] for n, a, s in _walk(data, movi[0] + 4, movi[0] + movi[1]) if n[2:] in (b"dc", b"db")]
    return out


def decode_frames(frames: list[bytes], most_blocks: int | None = MOST_BLOCKS) -> list[np.ndarray] | np.ndarray:
    """Grey levels of each frame. Frames with our header are unpacked together, one level a block."""
    if frames and all(f.startswith(HEAD) for f in frames):
        raw = b"".join(f[len(HEAD) : -len(TAIL)].replace(b"\xff\x00", b"\xff") for f in frames)
        d = DIFFS[np.frombuffer(raw, ">u2").reshape(len(frames), SAMPLES) >> 7]
        return (np.cumsum(d, axis=1, dtype=np.int32) + 128).clip(0, 255).astype(np.uint8)
    return [grey(decode_jpeg(f, most_blocks)) for f in frames]


def shots(frames: list[np.ndarray] | np.ndarray, reach: int = 8, factor: float = 1.5, floor: float = 0.12) -> list[int]:
    """First frames of the shots. A cut is where the histogram difference passes `floor` and `factor` times the mean
    difference of the frames within `reach` on either side."""
    n = len(frames)
    if n < 2:
        return [0]
    if isinstance(frames, np.ndarray):
        hist = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / frames.shape[1]
    else:
        hist = np.stack([np.bincount((f >> 4).ravel(), minlength=BINS) / f.size for f in frames])
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    total = np.concatenate([[0.0], np.cumsum(d)])
    i = np.arange(n - 1)
    lo, hi = np.maximum(i - reach, 0), np.minimum(i + reach + 1, n - 1)
    around = (total[hi] - total[lo] - d) / np.maximum(1, hi - lo - 1)
    return [0, *(np.flatnonzero(d > np.maximum(floor, factor * around)) + 1).tolist()]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as an AVI file."""

    def make():
        def batch(c: dict) -> dict:
            made = [payload_of(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_bytes": [m[0] for m in made], "media": [write_avi(m[1]) for m in made]}

        return batch

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", make, rows=64)


def one_medium(data: bytes | None, most_blocks: int | None = MOST_BLOCKS) -> tuple[bytes | None, list[dict], str | None]:
    """The payload (None where the file is none of ours), the clips, and why there are none."""
    if data is None:
        return None, [], "no media"
    try:
        video = read_avi(data)
        if not video["frames"]:
            raise ValueError("no frames")
        levels = decode_frames(video["frames"], most_blocks)
    except BROKEN as e:
        return None, [], f"{type(e).__name__}: {e}"
    first, ms = shots(levels), 1000 / video["fps"]
    ends = [*first[1:], len(levels)]
    mean = lambda a, b: float(levels[a:b].mean()) if isinstance(levels, np.ndarray) else float(np.mean([f.mean() for f in levels[a:b]]))
    clips = [{"start_ms": round(a * ms), "end_ms": round(b * ms), "first_frame": a, "frames": b - a, "level": mean(a, b)} for a, b in zip(first, ends, strict=True)]
    payload = levels.tobytes()[: int(video["comment"])] if isinstance(levels, np.ndarray) and video["comment"].isdigit() else None
    return payload, clips, None


def read_media(media: DataFrame, most_blocks: int | None = MOST_BLOCKS) -> DataFrame:
    """Adds what the stored bytes hold: the payload, and clips (start_ms, end_ms, first_frame, frames, mean level) by shot; error: why there are none. Frames of more than
    most_blocks blocks of 64 samples are such an error, as a block takes about 500 bytes of memory; None reads frames of any size."""

    def make():
        def batch(c: dict) -> dict:
            read = [one_medium(m, most_blocks) for m in c["media"]]
            return c | {"payload": [r[0] for r in read], "clips": [r[1] for r in read], "error": [r[2] for r in read]}

        return batch

    return map_rows(media.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, media binary, payload binary, clips array<struct<start_ms:long,end_ms:long,first_frame:long,frames:long,level:double>>, error string", make, rows=64)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each shot, in time order."""
    return read_media(media).select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest of the stored form and of what is read back from it."""
    read = read_media(stored(to_media(docs), "media", "zstd"))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(";clips="), F.crc32(F.to_json("clips").cast("binary")).cast("string"), F.lit(";longest_ms="), F.array_max(F.transform("clips", lambda c: c["end_ms"] - c["start_ms"])).cast("string")).alias("feature"),
    )


def check_payload(text: str | None) -> tuple[int, str, int]:
    """For tests: what a row's payload must give."""
    _, p = payload_of(text)
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])
