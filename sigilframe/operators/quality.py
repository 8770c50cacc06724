"""Checks that give the rows which break a rule, and plans of what has to be done again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(missing_in, key): keys that one side has and the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit(right_name).alias("missing_in"), key).unionByName(b.join(a, key, "left_anti").select(F.lit(left_name).alias("missing_in"), key))


def referential(rows: DataFrame, targets: DataFrame, on: str, same: dict[str, str]) -> DataFrame:
    """Rows whose key isn't among targets, or whose columns differ from the target's: the rows with `problem`. same: row column to target column."""
    t = targets.select(F.col(on), F.lit(True).alias("_has"), *(F.col(b).alias(f"_t_{a}") for a, b in same.items()))
    j = rows.join(t, on, "left")
    differ = reduce(lambda x, y: x | y, [~F.col(a).eqNullSafe(F.col(f"_t_{a}")) for a in same], F.lit(False))
    return j.withColumn("problem", F.when(F.col("_has").isNull(), "missing").when(differ, "mismatch")).where("problem is not null").select(*rows.columns, "problem")


def not_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def absent(rows: DataFrame, paths: list[Column], listing: DataFrame) -> DataFrame:
    """(key columns, path) for each expected path that the listing (path) lacks."""
    return rows.withColumn("path", F.explode(F.array(*paths))).join(listing.select("path"), "path", "left_anti")


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, n, low, high, next_free): how many numbers a group has, their range, and the smallest number at or above low that no row of
    the group has."""
    d = rows.select(group, F.col(number).cast("long").alias("x")).distinct()
    edge = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    after = d.select(group, (F.col("x") + 1).alias("x")).join(d, [group, "x"], "left_anti").groupBy(group).agg(F.min("x").alias("next_free"))
    return edge.join(after, group)


def stale(plan: DataFrame, hashes: DataFrame, memo: DataFrame) -> DataFrame:
    """Lines (line, files) of a plan that must run: those with a file whose hash differs from the memo's; absent on both sides
    counts as equal. hashes, memo: (file, hash)."""
    f = plan.select("line", F.explode_outer("files").alias("file"))
    j = f.join(hashes.select("file", F.col("hash").alias("_h")), "file", "left").join(memo.select("file", F.col("hash").alias("_m")), "file", "left")
    return j.groupBy("line").agg(F.bool_and(F.col("_h").eqNullSafe(F.col("_m"))).alias("_same")).where("not _same").select("line")


def build_plan(spark: SparkSession, groups: DataFrame, scales: list[str], target: str = "{scale}/{group}/{code}.png", source: str = "src/{group}/{code}.svg") -> DataFrame:
    """(line, files): `target TAB source` for every (group, code) and scale; the scales are a short literal list, so they are exploded, not joined."""
    g = groups.withColumn("scale", F.explode(F.array(*(F.lit(s) for s in scales))))

    def filled(t: str) -> Column:
        x = F.lit(t)
        for k in ("scale", "group", "code"):
            x = F.replace(x, F.lit("{" + k + "}"), F.col(k))
        return x

    return g.select(F.concat_ws("\t", filled(target), filled(source)).alias("line"), F.array(filled(source)).alias("files"))


def balanced(plan: DataFrame, shards: int) -> DataFrame:
    """Deals plan lines to shards by a hash: (line, shard)."""
    return plan.select("line", F.pmod(F.xxhash64("line"), F.lit(shards)).alias("shard"))


def markup_problems(rows: DataFrame, markup: str, key: str, size: str = "15", banned: tuple[str, ...] = ("rect", "circle", "ellipse", "line", "polygon", "polyline", "image", "text", "style", "mask")) -> DataFrame:
    """(key, problems) of vector markup: its size, view box, units, elements, number of paths, transforms and repeated attributes."""
    m = F.col(markup)
    head = F.regexp_extract(m, r"<svg([^>]*)>", 1)
    attr = lambda name: F.regexp_extract(head, rf'\b{name}="([^"]*)"', 1)
    paths = F.size(F.split(m, r"<path[\s/>]")) - 1
    rules = [
        (head == "", "not_svg"),
        (~attr("width").rlike(rf"^{size}(px)?$") | ~attr("height").rlike(rf"^{size}(px)?$"), "size"),
        (attr("viewBox") != f"0 0 {size} {size}", "view_box"),
        (m.rlike(r"\d(em|pt|cm|mm|in|%)\""), "unit"),
        (m.rlike(rf"<({'|'.join(banned)})[\s/>]"), "banned_element"),
        (paths != 1, "paths"),
        (m.rlike(r"\stransform="), "transform"),
        (m.rlike(r'<[^>]*\s([a-zA-Z-]+)="[^"]*"[^>]*\s\1='), "repeated_attribute"),
    ]
    return rows.select(key, F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules))).alias("problems")).where("size(problems) > 0")


LAYERS = ("grid", "color", "color-foreground", "hair", "skin", "skin-shadow", "line", "line-supplement")


def _layer(markup: Column, name: str) -> Column:
    """A layer's markup, up to the next layer or the end; empty without it."""
    return F.regexp_extract(markup, rf'(?s)<g[^>]*\sid="{name}"(.*?)(?:<g[^>]*\sid="(?:{"|".join(LAYERS)})"|</svg>|$)', 1)


def layer_problems(rows: DataFrame, markup: str, key: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(key, problems) of layered drawings: well-formed markup, the layers line, color and grid exactly once, known layers only, nothing but groups and titles
    (three at least) on top, no attribute twice, the usual view box and id."""
    m = F.col(markup)
    ids = F.regexp_extract_all(m, F.lit(r'<g[^>]*\sid="([^"]*)"'), F.lit(1))
    n = lambda name: F.size(F.filter(ids, lambda x: x == name))
    rules = [(n(x) != 1, f"layer_{x}") for x in ("line", "color", "grid")]
    rules += [(F.size(F.array_except(ids, F.array(*(F.lit(x) for x in layers)))) > 0, "unknown_layer"), (~m.contains('viewBox="0 0 72 72"'), "view_box"), (~m.rlike(r'<svg[^>]*\sid="emoji"'), "id"), (m.rlike(r"<(style|mask)[\s/>]"), "banned_element")]
    rules += [(m.rlike(r'<[^>]*\s([a-zA-Z-]+)="[^"]*"[^>]*\s\1='), "repeated_attribute")]
    listed = rows.select(key, F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules))).alias("problems"), m.alias("_m"))
    return _with_parse(listed, key).where("size(problems) > 0")


def _with_parse(rows: DataFrame, key: str) -> DataFrame:
    """Adds what only a parser tells: markup that isn't well formed, other elements than groups and titles on top, fewer than three of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for problems, text in zip(b.problems, b["_m"], strict=True):
                try:
                    tags = [c.tag.rpartition("}")[2] for c in ElementTree.fromstring(text or "")]
                    more = ["top_element"] * (not set(tags) <= {"g", "title"}) + ["top_count"] * (len(tags) < 3)
                except ElementTree.ParseError:
                    more = ["not_xml"]
                out.append([*problems, *more])
            yield pd.DataFrame({key: b[key], "problems": out})

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, problems array<string>")


def colour_problems(rows: DataFrame, markup: str, key: str, palette: list[str]) -> DataFrame:
    """(key, colours): fills and strokes outside the grid layer that the palette lacks, in order; none and white and black in short form are fine."""
    known = F.array(*(F.lit(c.lower()) for c in (*palette, "#fff", "#000", "none")))
    grid = _layer(F.col(markup), "grid")
    drawn = F.when(grid != "", F.replace(markup, grid)).otherwise(F.col(markup))
    return rows.select(key, F.array_sort(F.array_except(_colours(drawn), known)).alias("colours")).where("size(colours) > 0")


def _colours(markup: Column) -> Column:
    """Values of fill and stroke, in small letters, in either kind of quotes."""
    found = (F.regexp_extract_all(F.lower(markup), F.lit(rf"(?<![\w-])(?:fill|stroke)\s*=\s*{q}([^{q}]*){q}"), F.lit(1)) for q in "\"'")
    return F.concat(*found)


def line_problems(rows: DataFrame, markup: str, key: str, allowed: tuple[str, ...] = ("#000", "#000000", "black", "none")) -> DataFrame:
    """(key, colours): fills and strokes of the line layers other than black, in order."""
    both = F.concat(_layer(F.col(markup), "line"), F.lit(" "), _layer(F.col(markup), "line-supplement"))
    return rows.select(key, F.array_sort(F.array_except(_colours(both), F.array(*(F.lit(c) for c in allowed)))).alias("colours")).where("size(colours) > 0")


def skin_problems(rows: DataFrame, markup: str, key: str, base: tuple[str, ...], toned: str) -> DataFrame:
    """(key, problem) of drawings that have a tone (`toned`: a boolean column): no skin layer, or a colour of the untoned skin in it."""
    skin = F.concat(_layer(F.col(markup), "skin"), F.lit(" "), _layer(F.col(markup), "skin-shadow"))
    problem = F.when(~F.col(markup).rlike(r'<g[^>]*\sid="skin"'), "no_skin_layer").when(F.arrays_overlap(_colours(skin), F.array(*(F.lit(c.lower()) for c in base))), "untoned_colour")
    return rows.where(toned).select(key, problem.alias("problem")).where("problem is not null")


def code_mismatches(rows: DataFrame, code: str = "hexcode", text: str = "emoji") -> DataFrame:
    """Rows whose text isn't spelled by its code points, in hexadecimal of four digits at least, joined by -. A number that no character has is spelled by the replacement character."""
    from sigilframe.functions.text import hexcodes, replaced_codes

    return rows.where(~replaced_codes(code).eqNullSafe(hexcodes(F.col(text))))


def nearest_colour(rows: DataFrame, key: str, rgb: tuple[str, str, str], palette: list[tuple[int, int, int]]) -> DataFrame:
    """(key, colour, distance): the nearest palette entry, the first at a tie; the palette is a literal list."""
    r, g, b = (F.col(c) for c in rgb)
    squared = lambda p: (r - p[0]) * (r - p[0]) + (g - p[1]) * (g - p[1]) + (b - p[2]) * (b - p[2])
    best = F.least(*(F.struct(squared(p).cast("double").alias("d"), F.lit(i).alias("i")) for i, p in enumerate(palette)))
    names = F.array(*(F.lit("#{:02x}{:02x}{:02x}".format(*p)) for p in palette))
    return rows.select(key, best.alias("b")).select(key, F.get(names, F.col("b.i")).alias("colour"), F.sqrt("b.d").alias("distance"))
