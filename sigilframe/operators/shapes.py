"""Shape features of rasters, their contours as rows, orientation histograms, and the similarity of pairs of rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilframe.functions import raster as R
from sigilframe.functions import shapes
from sigilframe.functions.batches import frames
from sigilframe.operators.raster import Extractor, Raster

#: For `raster.extract`, beside its own.
EXTRACTORS = (
    Extractor("outline", ("contours", "holes", "perimeter", "nesting"), lambda r: shapes.outline(r.mask)),
    Extractor("occupancy", ("box_share", "box_fill"), lambda r: shapes.occupancy(r.mask)),
    Extractor("symmetry", ("symmetry_x", "symmetry_y"), lambda r: shapes.symmetry(r.mask)),
    Extractor("inside_share", ("inside_share",), lambda r: (shapes.inside_share(r.mask),)),
    Extractor("compressed_share", ("compressed_share",), lambda r: (shapes.compressed_share(r.mask),)),
)


def _mapped(images: DataFrame, key: str, data: str, columns: str, rows: Callable[[Raster], list[tuple]], decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(key, columns, error): the rows of each raster; a broken or missing one is a row with an error."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames(batches):
            out = []
            for k, raw in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                try:
                    if raw is None:
                        raise FileNotFoundError("missing file")
                    out += [(k, *r, None) for r in rows(Raster(decode(bytes(raw))))]
                except Exception as e:  # a broken raster is a failure row
                    out.append((k, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, *names, "error"]).astype({n: {"int": "Int32", "boolean": "boolean"}[t] for n, t in (c.split() for c in columns.split(", ")) if t in ("int", "boolean")})

    return images.select(key, data).mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, {columns}, error string")


def contours(images: DataFrame, key: str = "icon_id", data: str = "content", decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, contour, is_outer, parent, depth, length, area, error): the tree of contours of each raster; parent is null on top."""
    return _mapped(images, key, data, "contour int, is_outer boolean, parent int, depth int, length int, area int", lambda r: [(i, c.outer, None if c.parent < 0 else c.parent, c.depth, c.length, c.area) for i, c in enumerate(shapes.contours(r.mask))], decode)


def hog(images: DataFrame, key: str = "icon_id", data: str = "content", cell: int = 8, bins: int = 9, block: int = 2, decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, hog, error): orientation histograms of the grey raster."""
    return _mapped(images, key, data, "hog array<double>", lambda r: [(shapes.hog(r.gray, cell, bins, block).tolist(),)], decode)


def similar(pairs: DataFrame, images: DataFrame, a: str = "source", b: str = "target", key: str = "icon_id", data: str = "content", side: int = 7, decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(a, b, ssim, error): the structural similarity of the grey rasters of each pair, such as feature neighbours; without one of them, or with two of different sizes, an error. Each pair carries its
    two rasters, so nothing but pairs is shuffled and no raster meets all others."""
    one = pairs.select(a, b).join(images.select(F.col(key).alias(a), F.col(data).alias("_x")), a, "left").join(images.select(F.col(key).alias(b), F.col(data).alias("_y")), b, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames(batches):
            out = []
            for x, y in zip(t["_x"], t["_y"], strict=True):
                try:
                    if x is None or y is None:
                        raise FileNotFoundError("missing file")
                    out.append((shapes.ssim(Raster(decode(bytes(x))).gray, Raster(decode(bytes(y))).gray, side), None))
                except Exception as e:  # a failure row
                    out.append((None, f"{type(e).__name__}: {e}"))
            score, error = zip(*out, strict=True) if out else ((), ())
            yield pd.DataFrame({a: t[a], b: t[b], "ssim": list(score), "error": list(error)})

    kind = lambda c: pairs.schema[c].dataType.simpleString()
    return one.select(a, b, "_x", "_y").mapInPandas(run, f"`{a}` {kind(a)}, `{b}` {kind(b)}, ssim double, error string")
