"""Column expressions that repair and judge numbers read from scanned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a table entry in the order of their lines, and which of them are shares of agreement.
FIELDS = ("concreteness", "complexity", "familiarity", "meaningfulness", "semantic_distance", "complexity_metric", "concept_agreement", "name_agreement")
AGREEMENTS = ("concept_agreement", "name_agreement")
METRIC = "complexity_metric"


def _two(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; nested conditions would repeat it at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_number(raw: Column, field: Column) -> Column:
    """Digits as two-place text: lost decimal points are put back by the field's kind and the number of digits. Empty
    where nothing can be read."""
    share = field.isin(*AGREEMENTS)

    def put(x: Column, at: int) -> Column:
        return F.concat(x.substr(1, at), F.lit("."), x.substr(at + 1, 20))

    def one_point(kept: Column) -> Column:
        head = F.substring_index(kept, ".", 1)
        return F.when(kept.rlike(r"\..*\."), F.concat(head, F.lit("."), F.replace(kept.substr(F.length(head) + 1, F.length(kept)), F.lit(".")))).otherwise(kept)

    def pointed(x: Column) -> Column:
        n, whole = F.length(x), ~x.contains(".")
        return F.when(whole & ~share & (n == 2), F.concat(put(x, 1), F.lit("0"))).when(whole & (n == 3), put(x, 1)).when(whole & share & (n == 4), put(x, 2)).otherwise(x)

    def within(value: Column) -> Column:
        digits = F.replace(value, F.lit("."))
        again = F.when(F.length(digits) == 3, F.concat(put(digits, 2), F.lit("0"))).when(F.length(digits) == 4, put(digits, 2)).otherwise(value)
        number = value.try_cast("double")
        return F.coalesce(_two(F.when(share & (number > 100), again.try_cast("double")).otherwise(number)), F.lit(""))

    def read(x: Column) -> Column:
        digits = F.replace(x, F.lit("."))
        metric = F.when(digits == "", "").otherwise(F.coalesce(digits.try_cast("decimal(38,0)").cast("string"), F.lit("")))
        return F.when(x == "", "").when(field == METRIC, metric).otherwise(let(pointed(x), within))

    return let(one_point(F.regexp_replace(raw, "[^0-9.]", "")), read)


def review_reason(field: Column, value: Column, confidence: Column) -> Column:
    """Why a value needs a look; empty if it doesn't. Bounds and least confidences by the field's kind."""
    by_kind = lambda metric, share, rating: F.when(field == METRIC, metric).when(field.isin(*AGREEMENTS), share).otherwise(rating)

    def judged(number: Column) -> Column:
        return (
            F.when(number.isNull(), "invalid_numeric")
            .when(~number.between(by_kind(0, 0, 1), by_kind(100, 100, 5)), by_kind("complexity_metric_out_of_range", "agreement_out_of_range", "rating_out_of_range"))
            .when(confidence < by_kind(70, 80, 85), "low_confidence")
            .otherwise("")
        )

    return F.when(F.coalesce(value, F.lit("")) == "", "missing_numeric").otherwise(let(value.try_cast("double"), judged))


def takes_fallback(reason: Column, other_reason: Column, confidence: Column, other_confidence: Column) -> Column:
    """Whether a second reading replaces the first: a hard failure by a usable one, any failure by a clean one; a clean one stays; else by confidence."""
    bad, clean = reason != "", other_reason == ""
    return (
        F.when(bad & (reason != "low_confidence") & other_reason.isin("", "low_confidence"), True)
        .when(bad & clean, True)
        .when(~clean & ~bad, False)
        .otherwise(other_confidence > confidence + 10)
    )
