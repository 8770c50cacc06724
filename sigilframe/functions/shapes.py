"""numpy kernels over masks and grey rasters: contours with their nesting, symmetry, orientation histograms and structural similarity."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from sigilframe.functions.raster import labels

STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))  # right, down, left, up


@dataclass(frozen=True)
class Contour:
    """A closed way along pixel edges: around a part (outer), or around a hole of one. parent: the contour just around it, or -1; depth: how many are around it."""

    outer: bool
    parent: int
    depth: int
    length: int
    area: int


def _sides(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges between foreground and background, the foreground on their right: direction, start (y, x), and the pixel (y, x) that each is a side of."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    found = []
    # The upper side runs right from the pixel's corner, and so on around it; `away` is the neighbour beyond the side.
    for turn, (corner, away) in enumerate((((0, 0), (-1, 0)), ((0, 1), (0, 1)), ((1, 1), (1, 0)), ((1, 0), (0, -1)))):
        y, x = np.nonzero(mask & ~p[1 + away[0] : 1 + away[0] + h, 1 + away[1] : 1 + away[1] + w])
        found.append((np.full(len(y), turn), y + corner[0], x + corner[1], y, x))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def contours(mask: np.ndarray) -> list[Contour]:
    """The contours of 8-connected parts and 4-connected holes, in order of their first edge; by following edges, all of them at once."""
    turn, y, x, py, px = _sides(mask)
    n = len(turn)
    if not n:
        return []
    h, w = mask.shape
    at = np.full((4, h + 1, w + 1), -1)
    at[turn, y, x] = np.arange(n)
    step = np.array(STEPS)
    ey, ex = y + step[turn, 0], x + step[turn, 1]
    # Where two ways go on from a corner, turning left keeps diagonal neighbours together.
    ways = np.stack([at[(turn + t) % 4, ey, ex] for t in (-1, 0, 1)])
    on = np.where(ways[0] >= 0, ways[0], np.where(ways[1] >= 0, ways[1], ways[2]))
    name, jump = np.arange(n), on
    for _ in range(max(1, n.bit_length())):  # the smallest edge of each way, over twice the distance a turn
        name, jump = np.minimum(name, name[jump]), jump[jump]
    first, of = np.unique(name, return_inverse=True)
    area = np.bincount(of, (x * ey - ex * y) / 2.0).round().astype(int)
    length = np.bincount(of)
    part = labels(mask, True)[py[first], px[first]]
    out = np.pad(~mask, 1, constant_values=True)
    rest = labels(out, False)
    away = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])[turn[first]]
    beyond = rest[py[first] + 1 + away[:, 0], px[first] + 1 + away[:, 1]]
    around = {int(c): i for i, c in enumerate(part) if area[i] > 0}  # a part's outer contour
    inside = {int(c): i for i, c in enumerate(beyond) if area[i] < 0}  # a hole's contour
    parent = [inside.get(int(beyond[i]), -1) if area[i] > 0 else around[int(part[i])] for i in range(len(first))]
    depth: list[int] = []
    for i in range(len(first)):
        d, up = 0, parent[i]
        while up >= 0:
            d, up = d + 1, parent[up]
        depth.append(d)
    return [Contour(bool(area[i] > 0), parent[i], depth[i], int(length[i]), abs(int(area[i]))) for i in range(len(first))]


def outline(mask: np.ndarray) -> tuple[float, float, float, float]:
    """Contours, holes, perimeter in pixel edges, and the deepest nesting."""
    found = contours(mask)
    return float(len(found)), float(sum(not c.outer for c in found)), float(sum(c.length for c in found)), float(max((c.depth for c in found), default=0))


def bounds(mask: np.ndarray) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of the foreground, ends exclusive; zeros without any."""
    if not mask.any():
        return 0, 0, 0, 0
    y, x = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return int(x[0]), int(y[0]), int(x[-1]) + 1, int(y[-1]) + 1


def occupancy(mask: np.ndarray) -> tuple[float, float]:
    """The bounding box's share of the raster, and the foreground's share of the bounding box."""
    x1, y1, x2, y2 = bounds(mask)
    box = (x2 - x1) * (y2 - y1)
    return box / mask.size, float(mask.sum() / box) if box else 0.0


def symmetry(mask: np.ndarray) -> tuple[float, float]:
    """What the foreground and its mirror image within the bounding box share, of what they cover together: left and right exchanged, and top and bottom. 1 without foreground."""
    x1, y1, x2, y2 = bounds(mask)
    m = mask[y1:y2, x1:x2]
    return tuple(float((m & f).sum() / (m | f).sum()) if m.size else 1.0 for f in (m[:, ::-1], m[::-1]))


def inside_share(mask: np.ndarray) -> float:
    """The share of foreground pixels whose four neighbours are foreground: near 1 for filled drawings, 0 for thin lines."""
    p = np.pad(mask, 1)
    core = mask & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return float(core.sum() / mask.sum()) if mask.any() else 0.0


def compressed_share(mask: np.ndarray) -> float:
    """The size of the mask's packed bits after compression, as a share of their size before."""
    raw = np.packbits(mask).tobytes()
    return len(zlib.compress(raw, 9)) / len(raw)


def hog(image: np.ndarray, cell: int = 8, bins: int = 9, block: int = 2) -> np.ndarray:
    """Histograms of gradient orientations from 0 to 180 degrees by cells, each pixel's gradient dealt to the two nearest bins; blocks of neighbouring cells are
    normalised together and follow each other by rows. What is left of a cell at the border doesn't count."""
    p = np.pad(image.astype(np.float64), 1, mode="edge")
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    size = np.sqrt(gx * gx + gy * gy)
    place = (np.arctan2(gy, gx) % np.pi) / (np.pi / bins) - 0.5
    low = np.floor(place)
    part = place - low
    ny, nx = image.shape[0] // cell, image.shape[1] // cell
    y, x = np.indices((ny * cell, nx * cell))
    at = (y // cell * nx + x // cell) * bins
    cut = (slice(0, ny * cell), slice(0, nx * cell))
    votes = np.zeros(ny * nx * bins)
    for b, share in ((low, 1 - part), (low + 1, part)):
        np.add.at(votes, at + (b[cut].astype(int) % bins), (size * share)[cut])
    votes = votes.reshape(ny, nx, bins)
    out = [votes[i : i + block, j : j + block].ravel() for i in range(ny - block + 1) for j in range(nx - block + 1)]
    return np.concatenate([v / np.sqrt((v * v).sum() + 1e-10) for v in out]) if out else np.zeros(0)


def _windows(image: np.ndarray, side: int) -> np.ndarray:
    """Means of all windows, by running sums."""
    t = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (t[side:, side:] - t[:-side, side:] - t[side:, :-side] + t[:-side, :-side]) / (side * side)


def ssim(a: np.ndarray, b: np.ndarray, side: int = 7) -> float:
    """Mean structural similarity of two grey rasters (0 to 1) of one size, over all windows of a side (the whole raster if that is smaller)."""
    if a.shape != b.shape:
        raise ValueError("rasters of different sizes")
    side = min(side, *a.shape)
    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = _windows(a, side), _windows(b, side)
    va, vb, cov = _windows(a * a, side) - ma * ma, _windows(b * b, side) - mb * mb, _windows(a * b, side) - ma * mb
    c1, c2 = 0.01**2, 0.03**2  # fixed values: they keep flat windows from dividing by zero
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())
