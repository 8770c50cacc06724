"""Writers: tables as CSV and JSON, manifests, matrices, and HTML from small results."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.functions.text import escape, html_escaped
from sigilframe.schema import CATALOG, FEATURES, METADATA


def csv(rows: DataFrame, path: str, columns: tuple[str, ...] | None = None, order: list[str] | None = None) -> None:
    """A CSV folder with header and fixed columns, in order of `order` where given."""
    out = rows.select(*(columns or rows.columns))
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def catalog(rows: DataFrame, path: str) -> None:
    csv(rows, path, CATALOG)


def features(rows: DataFrame, path: str) -> None:
    csv(rows, path, (*METADATA, *FEATURES), ["icon_id"])


def pairs(rows: DataFrame, path: str) -> None:
    """A CSV folder; without rows a file without a header."""
    if rows.isEmpty():
        rows.limit(0).select(F.lit("").alias("x")).write.mode("overwrite").text(path)
    else:
        csv(rows, path, order=["rank"])


def json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def run_metadata(spark: SparkSession, source: str, output: str, rows: int, selected: int, per_set: int | None, extractors) -> DataFrame:
    """One row that describes a feature run."""
    import numpy as np

    made = [(e.name, list(e.columns)) for e in extractors]
    return spark.createDataFrame(
        [(source, output, rows, selected, per_set, (np.__version__, platform.python_version()), made)],
        "input string, output string, row_count long, selected_row_count long, per_set_limit long, dependencies struct<numpy:string,python:string>, features array<struct<name:string,columns:array<string>>>",
    )


def wide_matrix(distances: DataFrame, targets: list) -> DataFrame:
    """A row for each source and a column for each of the given targets; only for the small results that a wide file can hold."""
    return distances.groupBy("source").pivot("target", targets).agg(F.first("distance")).orderBy("source")


def manifest(rows: DataFrame) -> DataFrame:
    """(list, title, url, reason): files to fetch (without a reason) as downloaded, those left out as skipped; a row each, so a listing of any length is written in parts."""
    fetched = F.col("reason").isNull()
    return rows.select(F.when(fetched, "downloaded").otherwise("skipped").alias("list"), "title", F.when(fetched, F.col("url")).alias("url"), "reason")


def kind_manifest(rows: DataFrame, kind: str) -> DataFrame:
    """Counts by kind and in all."""
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("n"))


def grouped(rows: DataFrame, group: str, order: list[str], each: int = 1000) -> DataFrame:
    """(group, part, items) with the rows of a group in order, `each` of them a part, so no row grows with its group. Rows are numbered by ranges: a large group is spread over tasks."""
    from sigilframe.operators.graph import written
    from sigilframe.operators.records import numbered

    cols = [*order, *(c for c in rows.columns if c not in (group, *order))]
    placed = numbered(rows, [F.col(group).asc_nulls_first(), *order], "_t")
    first = written(placed.groupBy(F.col(group).alias("_g")).agg(F.min("_t").alias("_f")))
    parts = placed.join(first, placed[group].eqNullSafe(first["_g"])).withColumn("part", F.floor((F.col("_t") - F.col("_f")) / each))
    return parts.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("items"))  # `each` at most


def sorted_words(rows: DataFrame) -> DataFrame:
    """(line) of a word database, in order of lower-cased words."""
    return rows.orderBy(F.lower("word"), "word").select(F.concat(F.to_json(F.struct(F.col("word").alias("w"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("word").alias("w")))) - 6), F.lit(": "), F.to_json("parts")).alias("line"))


def tsv(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def path_list(listing: DataFrame, strip: str = r"\.svg$") -> DataFrame:
    """(name) of a listing's distinct files, in order, a row each."""
    return listing.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), strip, "").alias("name")).distinct().orderBy("name")


def constants_module(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(line) of a generated module: one exported constant a row."""
    return rows.orderBy(name).select(F.concat(F.lit("export const "), F.col(name), F.lit(" = "), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit(";")).alias("line"))


def html_rows(rows: DataFrame, title: str, order: list[str] | None = None) -> DataFrame:
    """(part, line) of a report, a line for each row and those of its frame (part 0 and 2); nothing is left out, and Spark writes it, in order."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>"))
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    top = f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>"
    body = rows.select(F.lit(1).alias("part"), F.concat(F.lit("<tr>"), *(cell(c) for c in rows.columns), F.lit("</tr>")).alias("line"), F.struct(*(order or rows.columns)).alias("_o"))
    frame = rows.sparkSession.createDataFrame([(0, top), (2, "</table></body></html>")], "part int, line string")
    return body.unionByName(frame, allowMissingColumns=True).orderBy("part", "_o").select("part", "line")


def html_table(rows: DataFrame, title: str, order: list[str] | None = None) -> str:
    """The same report as one text, of all rows; for results that a page can show."""
    return "".join(r.line for r in html_rows(rows, title, order).collect())
