"""First rows of groups, extremes, and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilframe.operators.graph import written
from sigilframe.operators.records import numbered


def first_of_groups(rows: DataFrame, group: list[str], order: list[Column | str], n: int, total: int | None = None) -> DataFrame:
    """The first n rows of each group (none for 0), then the first `total` of those (all for 0 or None). Spark cuts groups off before the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    return ranked.orderBy(*order).limit(total) if total else ranked


def extremes(rows: DataFrame, features: tuple[str, ...], key: str, n: int = 12) -> DataFrame:
    """The n lowest and n highest rows of each feature: (feature, side, place, key, value), ties by key. A null or NaN is no extreme. One scan; Spark cuts each
    side off at n before the shuffle."""
    sides = [F.struct(F.lit(f).alias("feature"), F.lit(side).alias("side"), (F.col(f) * sign).alias("_o"), F.col(f).alias("value")) for f in features for side, sign in (("low", 1), ("high", -1))]
    long = rows.select(key, F.explode(F.array(*sides)).alias("_x")).select(key, "_x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    place = F.row_number().over(Window.partitionBy("feature", "side").orderBy("_o", key))
    return long.withColumn("place", place).where(F.col("place") <= n).select("feature", "side", "place", key, "value")


def best_by_confidence(rows: DataFrame, group: list[str], confidence: str, position: str) -> DataFrame:
    """Of each group the row of the highest confidence, the first at a tie."""
    cols = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*cols), F.struct(confidence, -F.col(position))).alias("_r")).select(*group, "_r.*")


def quotas(sizes: DataFrame, stratum: str, n: int, whole: int = 0) -> DataFrame:
    """(stratum, n, quota) of strata (stratum, n): those of at most `whole` rows keep all; what is left of a sample of n rows is dealt to the others in proportion, the rest by
    the largest remainder, ties by stratum. A null stratum is one too."""
    small = F.col("n") <= whole
    got = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0)).alias("rows")).first()
    share = min(max(n - got.kept, 0), got.rows)
    part, rows = f"cast(n as decimal(19,0)) * cast({share} as decimal(18,0))", f"cast({max(got.rows, 1)} as decimal(19,0))"  # of large tables beyond 64 bits
    base = sizes.withColumns({"quota": F.when(small, F.col("n")).otherwise(F.expr(f"({part}) div {rows}")), "_rest": F.when(small, -1).otherwise(F.expr(f"({part}) % {rows}").cast("long"))})
    base = written(base.select(stratum, "n", F.col("quota").cast("long").alias("quota"), F.col("_rest").cast("long").alias("_rest")))
    more = share - (base.where("_rest >= 0").agg(F.sum("quota")).first()[0] or 0)
    placed = numbered(base, [F.desc("_rest"), F.col(stratum).asc_nulls_first()], "_n")
    return placed.select(stratum, "n", (F.col("quota") + ((F.col("_n") <= more) & (F.col("_rest") >= 0)).cast("long")).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0, whole: int = 0) -> DataFrame:
    """A sample of n rows, by stratum as `quotas` says: in each the rows whose hash of seed and key comes first, ties by key. Rows are numbered in order of (stratum, hash) within ranges, so
    a stratum of any size is spread over tasks; the same seed draws the same rows, in whatever order they come."""
    marked = rows.withColumn("_mark", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    placed = numbered(marked, [F.col(stratum).asc_nulls_first(), "_mark", key], "_t")
    sizes = placed.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("_first"))
    wanted = written(quotas(sizes.select(stratum, "n"), stratum, n, whole).join(sizes.select(F.col(stratum).alias("_s"), "_first"), F.col(stratum).eqNullSafe(F.col("_s"))).select("_s", "_first", "quota"))
    return placed.join(wanted, placed[stratum].eqNullSafe(wanted["_s"])).where(F.col("_t") - F.col("_first") < F.col("quota")).select(*rows.columns)
