"""Features of rasters: a registry of extractors that share one decoding of each raster, and failures as rows of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigilframe.functions import raster as R
from sigilframe.functions.batches import batched, frames, parts


@dataclass
class Raster:
    """A decoded raster; parts are worked out when first wanted."""

    rgba: np.ndarray
    threshold: int = R.THRESHOLD

    @cached_property
    def mask(self) -> np.ndarray:
        return R.foreground(self.rgba, self.threshold)

    @cached_property
    def gray(self) -> np.ndarray:
        return R.gray(self.rgba, self.mask)


@dataclass(frozen=True)
class Extractor:
    """Named columns, and a function from a raster to their values."""

    name: str
    columns: tuple[str, ...]
    extract: Callable[[Raster], tuple[float, ...]]


EXTRACTORS = (
    Extractor("foreground_area_ratio", ("foreground_area_ratio",), lambda r: (float(r.mask.mean()),)),
    Extractor("canny_edge_density", ("canny_edge_density",), lambda r: (float((R.edges(r.gray) & R.dilate(r.mask)).mean()),)),
    Extractor("connected_components", ("connected_components",), lambda r: (float(R.count_components(r.mask)),)),
    Extractor("quadtree", ("quadtree_leaf_count", "quadtree_structural_variability", "quadtree_mean_leaf_size"), lambda r: R.quadtree(r.mask)),
)


def extract(images: DataFrame, key: str = "icon_id", data: str = "content", extractors: tuple[Extractor, ...] = EXTRACTORS, decode: Callable[[bytes], np.ndarray] = R.decode, threshold: int = R.THRESHOLD) -> DataFrame:
    """key, the extractors' columns, and error: null, or why a row has no features (missing data, a broken file)."""
    columns = [c for e in extractors for c in e.columns]
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            rows = []
            for k, raw in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    if raw is None:
                        raise FileNotFoundError("missing file")
                    r = Raster(decode(bytes(raw)), threshold)
                    rows.append((k, *(v for e in extractors for v in e.extract(r)), None))
                except Exception as e:  # a broken raster is a failure row
                    rows.append((k, *[None] * len(columns), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, *columns, "error"])

    return images.select(key, data).mapInPandas(run, f"`{key}` {kind}, {', '.join(f'{c} double' for c in columns)}, error string")


def split_failures(rows: DataFrame, key: str = "icon_id") -> tuple[DataFrame, DataFrame]:
    """Feature rows, and (key, error) of the failures."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select(key, "error")


def of_vector(vector: str, side: int = 8, times: int = 1, level: float = 0.0):
    """A decoder-like function for rasters given as vectors: the mask of components above `level`, each pixel repeated."""

    def decode(raw: bytes) -> np.ndarray:
        on = np.frombuffer(raw, "<f8").reshape(side, side) > level
        on = on.repeat(times, 0).repeat(times, 1)
        rgba = np.zeros((*on.shape, 4), np.uint8)
        rgba[..., 3] = np.where(on, 255, 0)
        return rgba

    return decode


def vector_bytes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, content): vectors as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, "<f8").tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=[key, "content"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, content binary")


def boxes(images: DataFrame, key: str = "icon_id", data: str = "content", decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, x1, y1, x2, y2, area) of the 4-connected components."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames(batches):
            rows = [(k, *box) for k, raw in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for box in R.component_boxes(R.foreground(decode(bytes(raw))))]
            yield pd.DataFrame(rows, columns=[key, "x1", "y1", "x2", "y2", "area"])

    return images.select(key, data).mapInPandas(run, f"`{key}` {kind}, x1 int, y1 int, x2 int, y2 int, area int")


def symbol_crops(images: DataFrame, key: str = "icon_id", data: str = "content", last_row: str | None = None, decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, content): the symbol of each table cell, in the middle of a white square of 256."""
    kind = images.schema[key].dataType.simpleString()
    src = images.select(key, data, (F.col(last_row) if last_row else F.lit(False)).alias("_last"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames(batches):
            out = []
            for raw, last in zip(b.iloc[:, 1], b["_last"], strict=True):
                rgba = decode(bytes(raw))
                dark = rgba[..., :3].mean(axis=-1) < R.THRESHOLD
                box = R.symbol_box(R.component_boxes(dark), rgba.shape[1], rgba.shape[0], bool(last))
                white = np.full((256, 256, 4), 255, np.uint8)
                out.append(R.write_png(white if box is None else R.fit_centre(rgba[box[1] : box[3], box[0] : box[2]], 256, 232, (255, 255, 255, 255))))
            yield pd.DataFrame({key: b[key], "content": out})

    return src.mapInPandas(run, f"`{key}` {kind}, content binary")


def normalized(images: DataFrame, key: str = "icon_id", data: str = "content", side: int = 256, decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, content, error): every raster fitted into a transparent square."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames(batches):
            rows = []
            for k, raw in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                try:
                    rows.append((k, R.write_png(R.fit_centre(decode(bytes(raw)), side)), None))
                except Exception as e:  # a failure row
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "content", "error"])

    return images.select(key, data).mapInPandas(run, f"`{key}` {kind}, content binary, error string")


PER_TASK = 256  # boxes of a page that are cut out together


def page_crops(pages: DataFrame, boxes: DataFrame, page: str = "page", key: str = "key", data: str = "content", tails: float = 0.0, decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, content, error): boxes (page, key, x1, y1, x2, y2, times) of grey pages as PNG files, each box's contrast stretched and the box enlarged `times`. A page is decoded once for PER_TASK of its
    boxes; what lies outside of a page is black; an empty box, a missing or a broken page is a row with an error. A task holds a page and few of its crops at a time."""
    number = F.row_number().over(Window.partitionBy(page).orderBy(key)) - 1
    box = F.struct(F.col(key).alias("key"), *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2", "times")))
    lists = boxes.withColumn("_part", F.floor(number / PER_TASK)).groupBy(page, "_part").agg(F.collect_list(box).alias("_boxes"))  # PER_TASK at most
    kind = boxes.schema[key].dataType.simpleString()

    def cut(part: pa.RecordBatch) -> Iterator[tuple]:
        for raw, wanted in zip(part.column(0), part.column(1), strict=True):
            levels, failed = None, None
            try:
                if not raw.is_valid:
                    raise FileNotFoundError("missing file")
                levels = R.luma(decode(bytes(raw.as_py())))
            except Exception as e:  # a broken page fails its boxes
                failed = f"{type(e).__name__}: {e}"
            for w in wanted.as_py():
                box = None if failed else R.cropped(levels, w["x1"], w["y1"], w["x2"], w["y2"])
                ok = box is not None and box.size > 0
                yield w["key"], R.write_png(R.opaque(R.enlarged(R.stretched(box, tails), max(1, w["times"])))) if ok else None, None if ok else failed or "ValueError: an empty box"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            of = b.column(1).type.value_type.field("key").type
            yield from batched(cut(b), pa.schema([(key, of), ("content", pa.binary()), ("error", pa.string())]))

    return lists.join(pages.select(page, data), page, "left").select(data, "_boxes").mapInArrow(run, f"`{key}` {kind}, content binary, error string")


def levels(images: DataFrame, key: str = "icon_id", data: str = "content", decode: Callable[[bytes], np.ndarray] = R.decode) -> DataFrame:
    """(key, width, height, levels, error): grey levels by rows."""
    kind = images.schema[key].dataType.simpleString()

    def read(part: pa.RecordBatch) -> Iterator[tuple]:
        for k, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            try:
                g = R.luma(decode(bytes(raw.as_py())))
                yield k, g.shape[1], g.shape[0], g.ravel().tolist(), None
            except Exception as e:  # a failure row
                yield k, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield from batched(read(b), pa.schema([(key, b.column(0).type), ("width", pa.int32()), ("height", pa.int32()), ("levels", pa.list_(pa.int32())), ("error", pa.string())]))

    return images.select(key, data).mapInArrow(run, f"`{key}` {kind}, width int, height int, levels array<int>, error string")


def grey_of_vector(side: int = 8):
    """A decoder-like function for pages given as vectors: 128 in the middle, 255 to a unit."""

    def decode(raw: bytes) -> np.ndarray:
        return R.opaque(np.floor(np.frombuffer(raw, "<f8").reshape(side, side) * 255 + 128).clip(0, 255).astype(np.uint8))

    return decode
