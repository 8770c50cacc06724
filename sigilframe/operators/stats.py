"""Descriptive statistics of feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilframe.operators.graph import settled
from sigilframe.schema import FEATURES


def complete(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows whose features are all numbers; text is read as a number where it can be. Infinities stay."""
    kinds = dict(rows.dtypes)
    cast = rows.withColumns({f: F.col(f).try_cast("double") for f in features if kinds[f] != "double"})
    return cast.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features]))


def summary(rows: DataFrame, features: tuple[str, ...] = FEATURES, digits: int = 6) -> DataFrame:
    """Count, mean, median, sample deviation, least and greatest of each feature by set; rows without a set are left out. The median of a feature without
    values is null."""
    by = ["set_id", "set_name"]
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    named = rows.where("set_id is not null and set_name is not null")
    one = named.groupBy(*by).agg(*((f(x) if name == "count" else F.bround(f(x), digits)).alias(f"{x}_{name}") for x in features for name, f in stats.items()))
    middle = quantiles(unpivoted(named, by, features), [*by, "feature"], "value", {"median": 0.5})
    wide = middle.groupBy(*by).agg(*(F.bround(F.max(F.when(F.col("feature") == x, F.col("median"))), digits).alias(f"{x}_median") for x in features))
    order = [f"{x}_{name}" for x in features for name in ("count", "mean", "median", "std", "min", "max")]
    return one.join(wide, by, "left").select(*by, *order)


def unpivoted(rows: DataFrame, keep: list[str], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(keep, feature, value): a row for each feature."""
    return rows.select(*keep, F.explode(F.create_map(*(x for f in features for x in (F.lit(f), F.col(f))))).alias("feature", "value"))


def running(counts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds upto to (by, value, n): how many rows of the group have that value or a smaller one. The total runs within ranges of (by, value) and
    over the ranges, so no task sees all values of a group; for the second step a group has as many rows as ranges."""
    spread = counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id())
    spread = spread.withColumn("inside", F.sum("n").over(Window.partitionBy("part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    spread = settled(spread)  # both readers meet the same ranges
    parts = spread.groupBy(*by, "part").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "part", F.coalesce(before, F.lit(0)).alias("before"))
    return spread.join(parts, [*by, "part"]).withColumn("upto", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, and a column for each share): exact quantiles, interpolated between neighbours. Equal values are counted first and the counts added up by ranges;
    a group's values are never in one task. Nulls don't count; a group of nulls alone has no row, nor has a group whose `by` is null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = running(counts, by, value).join(total, by)
    at = {name: (F.col("total") - 1) * F.lit(p) for name, p in shares.items()}
    ends = [F.min(F.when(F.col("upto") > f(x), F.col(value))).alias(f"{name}_{k}") for name, x in at.items() for k, f in (("lo", F.floor), ("hi", F.ceil))]
    got = placed.groupBy(*by, "total").agg(*ends)

    def between(lo: Column, hi: Column, part: Column) -> Column:
        return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)  # equal ends may be infinite

    return got.select(*by, *(between(F.col(f"{name}_lo"), F.col(f"{name}_hi"), x - F.floor(x)).alias(name) for name, x in at.items()))


def standardized(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds z_<feature>: distance from the mean in population deviations; a constant feature is only centred."""
    one = rows.agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))
    joined = rows.crossJoin(F.broadcast(one))  # a single row
    return joined.select(*rows.columns, *(((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}"))).alias(f"z_{f}") for f in features))


def ranks(rows: DataFrame, key: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """key, feature, rank: average ranks, equal values sharing theirs. Counts of the distinct values are summed first, then by `running`."""
    long = unpivoted(rows, [key], features)
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, ["feature"]).select("feature", "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    return long.join(placed, ["feature", "value"]).select(key, "feature", "rank")


def spearman(rows: DataFrame, key: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature_a, feature_b, rho) for all pairs of features."""
    wide = ranks(rows, key, features).groupBy(key).pivot("feature", list(features)).agg(F.first("rank"))
    one = wide.agg(*(F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(features) for b in features[i:]))
    pairs = [(a, b, f"{a}|{b}" if i <= j else f"{b}|{a}") for i, a in enumerate(features) for j, b in enumerate(features)]
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{k}`").alias("rho")) for a, b, k in pairs))).alias("x")).select("x.*")


def principal_components(rows: DataFrame, key: str, features: tuple[str, ...] = FEATURES, k: int = 2) -> DataFrame:
    """Scores pc1..pck of standardized features, and explained shares. The covariance is one aggregate of the features' products; only that small matrix
    reaches the driver. Each component's largest loading is positive."""
    import numpy as np

    z = [f"z_{f}" for f in features]
    scaled = standardized(rows, features)
    got = scaled.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z[i:], i))).first()
    c = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(z))] for i in range(len(z))])
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[:k]
    axes = [vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i]) for i in order]
    share = values[order] / max(values.sum(), 1e-300)
    cols = [sum((F.col(n) * float(w) for n, w in zip(z, a, strict=True)), F.lit(0.0)).alias(f"pc{i + 1}") for i, a in enumerate(axes)]
    return scaled.select(key, *cols, *(F.lit(float(s)).alias(f"share{i + 1}") for i, s in enumerate(share)))


def box_stats(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 interquartile ranges) of each feature and set."""
    long = unpivoted(rows, ["set_id"], features)
    q = quantiles(long, ["feature", "set_id"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = long.join(q, ["feature", "set_id"]).where(F.col("value").between(F.col("q1") - fence, F.col("q3") + fence))
    return inside.groupBy("feature", "set_id", "q1", "median", "q3").agg(F.min("value").alias("low"), F.max("value").alias("high"))
