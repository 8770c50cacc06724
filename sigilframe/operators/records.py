"""Emoji-like records: variants, enhancements, searches, exports and imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilframe.operators.graph import written

# Code points of the skin tone modifiers.
MODIFIERS = ("1F3FB", "1F3FC", "1F3FD", "1F3FE", "1F3FF")


def with_variants(rows: DataFrame, variants: str) -> DataFrame:
    """Every record as rows: its variants (an array of records of the same kind) in order, and itself after them; `variant` numbers them."""
    base = [c for c in rows.columns if c != variants]
    fields = rows.schema[variants].dataType.elementType.fieldNames()
    own = F.struct(*(F.col(c) for c in fields))
    x = rows.select(*(F.col(c).alias(f"_b_{c}") for c in base if c not in fields), F.posexplode(F.concat(F.coalesce(variants, F.array()), F.array(own))).alias("variant", "_v"))
    return x.select(*(F.col(f"_b_{c}").alias(c) for c in base if c not in fields), "variant", "_v.*")


def enhanced(rows: DataFrame, extra: DataFrame, key: str = "hexcode", base: str = "skintone_base_hexcode") -> DataFrame:
    """Adds the columns of `extra` (key, ...): those of the base record where it has a base, else its own; empty where there are none."""
    cols = [c for c in extra.columns if c != key]
    own = extra.select(key, *(F.col(c).alias(f"_o_{c}") for c in cols))
    of_base = extra.select(F.col(key).alias(base), F.lit(True).alias("_has"), *(F.col(c).alias(f"_b_{c}") for c in cols))
    j = rows.join(own, key, "left").join(of_base, base, "left")
    return j.select(*rows.columns, *(F.coalesce(F.when(F.coalesce(F.col(base), F.lit("")) != "", F.when(F.col("_has"), F.col(f"_b_{c}")).otherwise(F.col(f"_o_{c}"))).otherwise(F.col(f"_o_{c}")), F.lit("")).alias(c) for c in cols))


def missing_designs(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(openmoji_author, '') = '' AND coalesce(skintone, '') = '' AND coalesce(`group`, '') <> ''")


def designed(rows: DataFrame) -> DataFrame:
    """Records that have an author, or belong to none of the groups that want one."""
    return rows.join(missing_designs(rows).select("hexcode"), "hexcode", "left_anti").select(*rows.columns)


def emoji_tables(rows: DataFrame, *extras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The published table (designed records and all extras, in order of `emoji_keys`) and the list of missing designs."""
    return reduce(DataFrame.unionByName, [designed(rows), *extras]).orderBy(*emoji_keys()), missing_designs(rows)


def emoji_keys() -> list[Column]:
    """By order, what has none last, then by group, subgroup and hexcode."""
    number = F.nullif(F.col("order").cast("string"), F.lit("")).try_cast("double")
    return [number.asc_nulls_last(), F.col("group").asc_nulls_last(), F.col("subgroups").asc_nulls_last(), F.col("hexcode").asc_nulls_last()]


def code_summary(rows: DataFrame, group: list[str], low: int = 0xE000, high: int = 0xF8FF) -> DataFrame:
    """(group, n, combos, first, last, next_free): of a group's hexcodes how many there are and how many are combinations, the least and greatest single
    code in the private-use area, and the least free code from the least on among all the group's codes."""
    from sigilframe.operators.quality import gaps

    parts = F.split("hexcode", "-")
    r = rows.select(*group, (F.size(parts) > 1).alias("_combo"), F.conv(F.get(parts, F.lit(0)), 16, 10).cast("long").alias("_x"))
    private = F.when(F.col("_x").between(low, high) & ~F.col("_combo"), F.col("_x"))
    counts = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("_combo").alias("combos"), F.min(private).alias("first"), F.max(private).alias("last"))
    one = r.where(private.isNotNull()).select(F.struct(*group).alias("_g"), "_x")
    free = gaps(one, "_g", "_x").select("_g.*", "next_free")
    return counts.join(free, group, "left")


def base_records(rows: DataFrame) -> DataFrame:
    """Records without skin tone that aren't themselves modifiers."""
    return rows.where((F.coalesce("skintone", F.lit("")) == "") & ~F.col("hexcode").isin(*MODIFIERS))


def tagged(column: str, value: str) -> Column:
    return F.array_contains(F.split(F.coalesce(column, F.lit("")), ", *"), value)


def search(rows: DataFrame, equal: dict[str, str] | None = None, tags: list[str] | None = None, skintone: bool | None = None, title: str | None = None) -> DataFrame:
    """Rows that meet any condition; all rows if there is none."""
    conditions = [F.col(c) == v for c, v in (equal or {}).items()]
    conditions += [tagged("tags", t) | tagged("openmoji_tags", t) for t in tags or []]
    if skintone is not None:
        has = F.coalesce("skintone", F.lit("")) != ""
        conditions.append(has if skintone else ~has)
    if title is not None:
        conditions.append(F.col("title").contains(title))
    return rows.where(reduce(lambda a, b: a | b, conditions)) if conditions else rows


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds `name`: numbers from 1 in an order. Rows are numbered within ranges and over them, so no task sees all rows. The ranges are drawn from a sample, so
    the rows are written with theirs: worked out twice, they needn't be the same ones."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    spread = written(spread.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    out = spread.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_n") + F.col("_b"))  # a row for each partition
    return out.select(*dict.fromkeys([*rows.columns, name]))


def typed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Numbers instead of text: order from 1, unicode and skintone or -1."""
    number = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")).try_cast("double"), F.lit(-1.0)).alias(c)
    out = numbered(rows, order, "order")
    return out.select(*(number(c) if c in ("unicode", "skintone") else F.col(c) for c in out.columns))


def record_paths(rows: DataFrame, root: str) -> DataFrame:
    """Adds the files of a record: files.color.svg and files.black.svg."""
    at = lambda kind: F.struct(F.concat(F.lit(f"{root}/{kind}/svg/"), F.col("hexcode"), F.lit(".svg")).alias("svg"))
    return rows.withColumn("files", F.struct(at("color").alias("color"), at("black").alias("black")))


def imports(files: DataFrame, records: DataFrame, present: DataFrame) -> DataFrame:
    """(path, hexcode, target, status) of new files (path): ERROR without a record, else OVERWRITE or NEW by whether the target is present."""
    code = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.svg$", "")
    j = files.select("path").withColumn("hexcode", code).join(records.select("hexcode", "group", "subgroups"), "hexcode", "left")
    j = j.withColumn("target", F.when(F.col("group").isNotNull(), F.concat_ws("/", F.lit("src"), "group", "subgroups", F.concat("hexcode", F.lit(".svg")))))
    j = j.join(present.select(F.col("path").alias("target"), F.lit(True).alias("_there")), "target", "left")
    return j.select("path", "hexcode", "target", F.when(F.col("target").isNull(), "ERROR").when(F.col("_there"), "OVERWRITE").otherwise("NEW").alias("status"))


def allowed_types(rows: DataFrame, types: list[str]) -> DataFrame:
    """Adds reason: null for files to fetch, else why not; an empty list allows every type."""
    reason = F.when(F.col("url").isNull(), "no_url")
    if types:
        reason = reason.when(~F.col("mime").isin(*types), F.concat(F.lit("mime:"), F.coalesce("mime", F.lit(""))))
    return rows.withColumn("reason", reason)


def in_batches(rows: DataFrame, key: str, size: int = 50) -> DataFrame:
    """(batch, keys): distinct keys in batches of at most `size`, for keyed requests. Batches form within ranges of keys, so no task
    sees them all; a range's last batch may be short."""
    d = rows.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    d = d.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1) / size))
    return d.groupBy("_p", "_n").agg(F.array_sort(F.collect_list(key)).alias("keys")).select(F.concat_ws("-", "_p", "_n").alias("batch"), "keys")
