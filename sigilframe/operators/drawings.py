"""Rewriting of vector drawings: one parse for any number of steps, run in Arrow batches. A step takes the root element and changes it.

A drawing that can't be parsed gives a row with its error instead of stopping the run.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sigilframe.operators.graph import dealt

Step = Callable[[ET.Element], None]

# What plain icons may hold, and the layers that colour a drawing.
PLAIN_ELEMENTS = ("path", "g")
PLAIN_ATTRIBUTES = ("version", "id", "xmlns", "width", "height", "viewBox", "d")
COLOUR_LAYERS = ("grid", "color", "color-foreground", "skin", "skin-shadow", "hair")


def parse(markup: str) -> ET.Element:
    """The tree, with names free of their namespace and the default namespace kept as an attribute."""
    root = ET.fromstring(markup)
    space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    if space:
        root.attrib = {"xmlns": space} | root.attrib
    return root


def plain(name: str | None = None) -> Step:
    """Only paths and groups with their plain attributes; the root is called `name`, its size has no unit."""

    def step(root: ET.Element) -> None:
        stack = [root]
        while stack:
            e = stack.pop()
            for child in [c for c in e if c.tag not in PLAIN_ELEMENTS]:
                e.remove(child)
            e.attrib = {k: v for k, v in e.attrib.items() if k in PLAIN_ATTRIBUTES}
            stack += list(e)
        if name:
            root.set("id", name)
        for k in ("width", "height"):
            if k in root.attrib:
                root.set(k, root.get(k).replace("px", ""))

    return step


def without_layers(*ids: str) -> Step:
    def step(root: ET.Element) -> None:
        for parent in root.iter():
            for child in [c for c in parent if c.get("id") in ids]:
                parent.remove(child)

    return step


def recoloured(colours: dict[str, str], attributes: tuple[str, ...] = ("fill", "stroke")) -> Step:
    """Gives what lies within a layer (by id) that layer's colour, wherever it has one of the attributes."""

    def step(root: ET.Element) -> None:
        for layer in root.iter():
            if (colour := colours.get(layer.get("id"))) is not None:
                for e in layer.iter():
                    if e is not layer:
                        e.attrib.update({a: colour for a in attributes if a in e.attrib})

    return step


def mirrored(keep: tuple[str, ...] = ("grid",)) -> Step:
    """Turns the groups at the top around the middle of the view box, but for those in `keep`."""

    def step(root: ET.Element) -> None:
        x, _, width, _ = map(float, root.get("viewBox").split())
        for g in root.findall("g"):
            if g.get("id") not in keep:
                g.set("transform", f"{g.get('transform', '')} scale(-1, 1) translate({-(width + x):g}, 0)".strip())

    return step


def unwrapped(root: ET.Element) -> None:
    """Lifts the children of a lone group to the top, and lets the root's fill go where it is none."""
    if root.get("fill") == "none":
        del root.attrib["fill"]
    if len(root) == 1 and root[0].tag == "g":
        inner = list(root[0])
        root.remove(root[0])
        root.extend(inner)


def toned(fill: str, shadow: str, hair: str | None = None) -> tuple[Step, ...]:
    """The steps of one skin tone: skin, shadow and hair recoloured, the grid gone."""
    skin = recoloured({"skin": fill} | ({"hair": hair} if hair else {}), ("fill",))
    return skin, recoloured({"skin": fill}, ("stroke",)), recoloured({"skin-shadow": shadow}, ("fill",)), without_layers("grid")


def rewritten(rows: DataFrame, key: str, markup: str, *steps: Step) -> DataFrame:
    """(key, svg, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, m in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                try:
                    root = parse(m)
                    for s in steps:
                        s(root)
                    out.append((k, ET.tostring(root, encoding="unicode"), None))
                except Exception as e:  # a broken drawing is a failure row
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "svg", "error"])

    return dealt(rows.select(key, markup), key).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, svg string, error string")
