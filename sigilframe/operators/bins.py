"""Visual channels as quantile bins, and rows that differ in few of them.

Rows of equal bins are one class, so many equal rows cost no more than one. Two classes within `most` mismatches agree wholly in one at least of most + 1 groups of channels (a pigeonhole), so classes meet
by the bins of a group alone, are compared in the join itself, and are told once: by the first group in which they agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilframe.operators.stats import quantiles, unpivoted
from sigilframe.schema import FEATURES


def binned(rows: DataFrame, index: str, features: tuple[str, ...] = FEATURES, bins: int = 4) -> DataFrame:
    """(index, bins): for each feature how many of its bins - 1 exact quantiles lie below the value. Rows with a null or NaN feature are left out."""
    whole = rows.where(" and ".join(f"{f} is not null and not isnan({f})" for f in features)).select(index, *features)
    shares = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = quantiles(unpivoted(whole, [], features), ["feature"], "value", shares)
    one = cuts.agg(*(F.max(F.when(F.col("feature") == f, F.col(q))).alias(f"_{f}_{q}") for f in features for q in shares))
    joined = whole.crossJoin(F.broadcast(one))  # a single row
    level = lambda f: sum(((F.col(f) > F.col(f"_{f}_{q}")).cast("int") for q in shares), F.lit(0))
    return joined.select(index, F.array(*(level(f) for f in features)).alias("bins"))


def classes(of_rows: DataFrame, index: str) -> DataFrame:
    """(class, bins, n): rows of equal bins, named by their smallest index."""
    return of_rows.groupBy("bins").agg(F.min(index).alias("class"), F.count(F.lit(1)).alias("n")).select("class", "bins", "n")


def members(of_rows: DataFrame, index: str) -> DataFrame:
    """(index, class) of every row."""
    twin = F.xxhash64("bins").alias("twin")  # with a second key both sides are dealt for this join, so a hot class can be split
    return of_rows.select(index, "bins", twin).join(classes(of_rows, index).select("class", "bins", twin), ["bins", "twin"]).select(index, "class")


def near_classes(found: DataFrame, channels: int, most: int = 1) -> DataFrame:
    """(a, b, mismatches): pairs of classes (class, bins) a < b that differ in 1 to `most` channels."""
    groups = [range(g * channels // (most + 1), (g + 1) * channels // (most + 1)) for g in range(most + 1)]
    keys = F.array(*(F.struct(F.lit(g).alias("g"), F.array(*(F.col("bins")[i] for i in part)).alias("part")) for g, part in enumerate(groups)))
    one = found.select("class", "bins", F.explode(keys).alias("key"))
    x, y = one.alias("x"), one.alias("y")
    differ = lambda i: (F.col("x.bins")[i] != F.col("y.bins")[i]).cast("int")
    agree = [F.col("x.key.g") == g for g in range(most + 1)]
    misses = [sum((differ(i) for i in part), F.lit(0)) for part in groups]
    first = [F.least(*misses[:k], F.lit(1), F.lit(1)) > 0 for k in range(most + 1)]  # no group before this one agrees wholly
    at_first = F.coalesce(*(F.when(a, f) for a, f in zip(agree, first, strict=True)))
    mismatches = sum((differ(i) for i in range(channels)), F.lit(0))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (mismatches <= most) & at_first)
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), mismatches.alias("mismatches"))
