"""Tables read from scanned pages: geometry, words in boxes, repaired numbers, corrections and reviews.

Words are rows (text, left, top, right, bottom, cx, cy, confidence) with the columns that name their page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigilframe.functions import ocr as O
from sigilframe.functions.text import plain_text

# Tops of a page's rows of entries, offsets of an entry's lines, and boxes of its parts by side (x ranges).
TOPS = (320, 660, 1000, 1340, 1710)
OFFSETS = (8, 42, 76, 110, 144, 178, 212, 246)
SIDES = {
    "left": {"label": (200, 485), "metric": (480, 700), "value": (700, 800), "common": (570, 800)},
    "right": {"label": (890, 1165), "metric": (1135, 1360), "value": (1360, 1475), "common": (1230, 1475)},
}
FULL_PAGES, PER_PAGE, ITEMS = 23, 10, 239


def items(spark: SparkSession) -> DataFrame:
    """item, page, row, side of all items of the table."""
    return placed(spark.range(1, ITEMS + 1).withColumnRenamed("id", "item"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds page, row and side to numbered items: down the pages, rows, and from left to right."""
    n = F.col("item") - 1
    return rows.withColumns({"page": (n / PER_PAGE).cast("int"), "row": ((n % PER_PAGE) / 2).cast("int"), "side": F.when(n % 2 == 0, "left").otherwise("right")})


def geometry(rows: DataFrame) -> DataFrame:
    """Adds top and the boxes label_box, metric_box and common_box (x1, y1, x2, y2), and value_x, to rows with row and side."""
    top = F.get(F.array(*(F.lit(t) for t in TOPS)), F.col("row"))
    part = lambda name, k: F.when(F.col("side") == "left", SIDES["left"][name][k]).otherwise(SIDES["right"][name][k])
    box = lambda name, a, b: F.struct(part(name, 0).alias("x1"), (F.col("top") + a).alias("y1"), part(name, 1).alias("x2"), (F.col("top") + b).alias("y2"))
    out = rows.withColumn("top", top)
    return out.withColumns({"label_box": box("label", 0, 115), "metric_box": box("metric", 0, 300), "common_box": box("common", 255, 335), "value_x": F.struct(part("value", 0).alias("x1"), part("value", 1).alias("x2"))})


def words_in_boxes(words: DataFrame, boxes: DataFrame, on: list[str], box: str) -> DataFrame:
    """Words whose centre lies in the box, edges included, of the boxes of the same page."""
    b = F.col(box)
    inside = F.col("cx").between(b["x1"], b["x2"]) & F.col("cy").between(b["y1"], b["y2"])
    return boxes.join(words, on).where(inside)


FEW_BOXES = 20_000  # with their cells; some two megabytes


def contained(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """Range join of points with boxes (box_id, x1, y1, x2, y2), edges included. Boxes are spread over a grid of their mean width, so the join has keys. Up to FEW_BOXES of them are
    broadcast, as their few keys would put all points into as many tasks; for more, no side is."""
    size = boxes.agg(F.greatest(F.avg(F.col("x2") - F.col("x1")), F.lit(1e-9))).first()[0] or 1.0
    cell = lambda v: F.floor(v / F.lit(float(size)))
    spread = boxes.withColumn("_cell", F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2")))))
    few = len(spread.select("_cell").limit(FEW_BOXES + 1).collect()) <= FEW_BOXES
    joined = points.withColumn("_cell", cell(F.col(x))).join(spread.hint("broadcast" if few else "merge"), "_cell")
    return joined.where(F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))).drop("_cell")


def in_lines(words: DataFrame, group: list[str], tolerance: float = 24.0) -> DataFrame:
    """Adds line and place: words in order of cy join the first line whose running mean is near enough; lines go by their mean, words by left. A group is
    the words of one box."""

    def order(p: pd.DataFrame) -> pd.DataFrame:
        cy, total, n, of = p.cy.to_numpy(), [], [], np.zeros(len(p), int)
        mean = np.zeros(len(p))  # of the lines so far
        down = np.argsort(cy, kind="stable")
        for i in down:
            near = np.flatnonzero(np.abs(mean[: len(n)] - cy[i]) <= tolerance)
            k = int(near[0]) if len(near) else len(n)
            if k == len(n):
                total.append(0.0)
                n.append(0)
            total[k], n[k], of[i] = total[k] + cy[i], n[k] + 1, k
            mean[k] = total[k] / n[k]
        number = np.empty(len(n), int)
        number[np.argsort(mean[: len(n)], kind="stable")] = np.arange(len(n))
        line, place = number[of], np.empty(len(p), int)
        place[down[np.lexsort((p.left.to_numpy()[down], line[down]))]] = np.arange(len(p))
        return p.assign(line=line, place=place)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.groupBy(*group).applyInPandas(order, f"{fields}, line int, place int")


def label_text(ordered: DataFrame, group: list[str]) -> DataFrame:
    """Labels from words in order: field names and numbers go, and letters and digits that run into a word's front."""
    text = plain_text("text")
    kept = F.trim(F.regexp_replace(text, r"^[A-Za-z]*\d+", ""))
    name = F.regexp_replace(F.lower(text), ":+$", "")
    rows = ordered.where((text != "") & ~name.isin("concreteness", "complexity", "familiarity") & ~text.rlike(r"^\d+$")).withColumn("_t", kept).where("_t <> ''")
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "_t"))).alias("_w")).select(*group, F.array_join(F.col("_w._t"), " ").alias("label"))


def response_text(words: DataFrame, group: list[str]) -> DataFrame:
    """The common response: words by (top, left) without the table's own and numbers."""
    text = plain_text("text")
    name = F.regexp_replace(F.lower(text), ":+$", "")
    rows = words.where((text != "") & ~name.isin("agreement", "name", "concept") & ~name.contains("agreement") & ~text.rlike("^[0-9][0-9.]*$"))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("top", "left", text.alias("t")))).alias("_w")).select(*group, F.array_join(F.col("_w.t"), " ").alias("common_response"))


# How a field's printed name begins.
STARTS = {"concreteness": "concreteness", "familiarity": "familiarity", "meaningfulness": "meaningfulness", "semantic_distance": "semantic", "complexity_metric": "metric", "concept_agreement": "concept", "name_agreement": "name"}


def field_labels(words: DataFrame, group: list[str]) -> DataFrame:
    """Per group and field the first word by (top, left) that is the field's printed name. The plain complexity has no `metric`
    on its line."""
    name = F.regexp_replace(F.lower(plain_text("text")), ":+$", "")
    w = words.withColumn("_n", name)
    metric = w.where(F.col("_n").startswith("metric")).select(*group, F.col("cy").alias("_m")).groupBy(*group).agg(F.collect_list("_m").alias("_m"))  # a few words of one box
    w = w.join(metric, group, "left")
    near = F.exists(F.coalesce("_m", F.expr("cast(array() as array<double>)")), lambda m: F.abs(m - F.col("cy")) <= 15)
    fields = [F.when(F.col("_n").startswith(start), F.lit(f)) for f, start in STARTS.items()]
    plain = F.when(((F.col("_n") == "complexity") | F.col("_n").startswith("complext")) & ~near, F.lit("complexity"))
    w = w.withColumn("field", F.explode(F.array_compact(F.array(*fields, plain))))
    first = Window.partitionBy(*group, "field").orderBy("top", "left")
    return w.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_n", "_m")


def value_box(label_top: Column, label_bottom: Column, top: Column, offset: Column, x1: Column, x2: Column) -> Column:
    """Beside the printed name, or at the line's place where the name wasn't found."""
    found = label_top.isNotNull()
    return F.struct(x1.alias("x1"), F.when(found, F.greatest(F.lit(0), label_top - 6)).otherwise(top + offset).alias("y1"), x2.alias("x2"), F.when(found, label_bottom + 12).otherwise(top + offset + 44).alias("y2"))


def best_number(words: DataFrame, group: list[str], field: str = "field", order: str = "place") -> DataFrame:
    """Per group the readable number of the highest confidence, the first at a tie; empty, 0 and empty where there is none."""
    v = words.withColumn("value", O.normalize_number(F.col("text"), F.col(field)))
    best = F.max_by(F.struct("value", "confidence", F.col("text").alias("raw")), F.when(F.col("value") != "", F.struct("confidence", -F.col(order))))
    out = v.groupBy(*group).agg(best.alias("_b"), F.max(F.col("value") != "").alias("_any"))
    pick = lambda c, none: F.when(F.col("_any"), F.col(f"_b.{c}")).otherwise(F.lit(none)).alias(c)
    return out.select(*group, pick("value", ""), pick("confidence", 0.0), pick("raw", ""))


def with_fallback(rows: DataFrame) -> DataFrame:
    """Rows (field, value, confidence, raw, other_value, other_confidence, other_raw): the reading that counts, its reason, and `replaced` where the second
    reading gave another value."""
    reason = O.review_reason(F.col("field"), F.col("value"), F.col("confidence"))
    other = O.review_reason(F.col("field"), F.col("other_value"), F.col("other_confidence"))
    r = rows.withColumn("_r", reason).withColumn("_o", other)
    take = (F.col("_r") != "") & O.takes_fallback(F.col("_r"), F.col("_o"), F.col("confidence"), F.col("other_confidence"))
    r = r.withColumn("_t", take)
    pick = lambda a, b: F.when(F.col("_t"), F.col(b)).otherwise(F.col(a))
    drop = ("_r", "_o", "_t", "other_value", "other_confidence", "other_raw")
    changed = F.when(F.col("_t") & (F.col("value") != F.col("other_value")), F.concat("value", F.lit(" -> "), "other_value"))
    return r.withColumns({"replaced": changed, "was_raw": F.col("raw"), "value": pick("value", "other_value"), "confidence": pick("confidence", "other_confidence"), "reason": pick("_r", "_o"), "raw": pick("raw", "other_raw")}).drop(*drop)


def corrected(rows: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Overlays corrections (keys, correction); `corrected` tells what changed, reasons are judged anew. Corrections are a
    hand-written list; whether it is broadcast is left to its measured size."""
    r = rows.join(corrections, keys, "left")
    change = F.col("correction").isNotNull() & (F.col("value") != F.col("correction"))
    new = F.when(change, F.col("correction")).otherwise(F.col("value"))
    shown = F.when(change, F.concat(F.when(F.col("value") != "", F.col("value")).otherwise(F.col("raw")), F.lit(" -> "), F.col("correction")))
    out = r.withColumn("corrected", shown).withColumn("value", new)
    return out.withColumn("reason", F.when(F.col("corrected").isNotNull(), O.review_reason(F.col("field"), F.col("value"), F.col("confidence"))).otherwise(F.col("reason"))).drop("correction")


def reviews(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, field, value, confidence, reason): replaced readings, corrections, and what still needs a look."""
    two = F.format_string("%.2f", F.col("confidence"))
    one = lambda when, value, reason: F.when(when, F.struct(value.alias("value"), two.alias("confidence"), reason.alias("reason")))
    shown = F.when(F.col("value") != "", F.col("value")).otherwise(F.col("raw"))
    made = F.array_compact(F.array(
        one(F.col("replaced").isNotNull(), F.col("replaced"), F.concat(F.lit("fallback_from:"), F.when(F.col("was_raw") != "", F.col("was_raw")).otherwise("blank"))),
        one(F.col("corrected").isNotNull(), F.col("corrected"), F.lit("explicit_ocr_correction")),
        one(F.col("reason") != "", shown, F.col("reason")),
    ))
    return rows.select(*keys, "field", F.explode(made).alias("r")).select(*keys, "field", "r.*")


def item_reviews(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, field, value, confidence, reason) of what is wrong with a whole item. Rows: keys, item (its number by its place), numbers (the numbers read
    in its title), label, common_response, confidence: the printed number doesn't confirm the place, the label or the common response is missing."""
    two = F.format_string("%.2f", F.col("confidence"))
    one = lambda when, field, value, reason: F.when(when, F.struct(F.lit(field).alias("field"), value.alias("value"), two.alias("confidence"), F.lit(reason).alias("reason")))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    made = F.array_compact(F.array(
        one(~F.array_contains(F.coalesce("numbers", F.expr("cast(array() as array<string>)")), F.col("item").cast("string")), "appendix_item", F.array_join(F.coalesce("numbers", F.expr("cast(array() as array<string>)")), " "), "item_number_not_confirmed"),
        one(empty(F.col("label")), "label", F.lit(""), "missing_label"),
        one(empty(F.col("common_response")), "common_response", F.lit(""), "missing_common_response"),
    ))
    return rows.select(*keys, F.explode(made).alias("r")).select(*keys, "r.*")


def mean_confidence(words: DataFrame, group: list[str]) -> DataFrame:
    """Mean of the confidences that aren't negative, 0 where there are none."""
    return words.groupBy(*group).agg(F.coalesce(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))


def violations(rows: DataFrame, key: str = "appendix_item", n: int = ITEMS) -> DataFrame:
    """(problem, key): missing and unexpected item numbers, repeated ones, and values out of range."""
    spark = rows.sparkSession
    want = spark.range(1, n + 1).select(F.col("id").alias(key))
    have = rows.select(F.col(key).try_cast("bigint").alias(key))
    long = rows.select(F.col(key).try_cast("bigint").alias(key), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in O.FIELDS))).alias("x"))
    reason = O.review_reason(F.col("x.f"), F.col("x.v"), F.lit(100.0))
    parts = [
        want.join(have, key, "left_anti").select(F.lit("missing_item").alias("problem"), key),
        have.join(want, key, "left_anti").select(F.lit("unexpected_item").alias("problem"), key),
        have.groupBy(key).count().where("count > 1").select(F.lit("repeated_item").alias("problem"), key),
        long.where(reason != "").select(F.concat_ws(":", "x.f", reason).alias("problem"), key),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def validated(rows: DataFrame, key: str = "appendix_item", n: int = ITEMS) -> DataFrame:
    """The rows, or an error with the first violations."""
    bad = violations(rows, key, n).orderBy("problem", key).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.problem} {r[key]}" for r in bad))
    return rows
