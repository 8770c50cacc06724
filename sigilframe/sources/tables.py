"""Readers of catalogs, features, ratings, lookups and listings. A missing side table reads as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigilframe.functions import text as X
from sigilframe.operators.catalog import EXTENSIONS, last_wins
from sigilframe.schema import CATALOG_TYPE, EMOJI_TYPE, FEATURES, METADATA, PICTOGRAM_TYPE, RATINGS_TYPE, REVIEW_TYPE, WORDS_TYPE, strings

#: Text that the feature reader takes for missing.
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def or_empty(spark: SparkSession, path: str, schema: StructType, read) -> DataFrame:
    return read() if exists(spark, path) else spark.createDataFrame([], schema)


def csv_strings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Text columns with a header; what is missing is the empty text."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True).na.fill("")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return csv_strings(spark, path, CATALOG_TYPE)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Complete feature rows: metadata with missing words as empty text, features as numbers, rows that lack one left out."""
    from sigilframe.operators.stats import complete

    raw = spark.read.schema(strings(*METADATA, *FEATURES)).csv(path, header=True, escape='"', multiLine=True)
    cleaned = raw.select(*(F.when(F.col(c).isin(*MISSING) | F.col(c).isNull(), F.lit("")).otherwise(F.col(c)).alias(c) for c in METADATA), *FEATURES)
    return complete(cleaned)


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of image files below a folder, paths from the folder on; contents aren't read."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    prefix = full.split(":", 1)[-1].rstrip("/").lstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    bare = F.regexp_replace("path", "^[a-z]+:/+", "")
    inner = F.when(bare.startswith(prefix), bare.substr(F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare)
    return found.select(inner.alias("path"), "length").where(X.suffix(X.base_name("path")).isin(*EXTENSIONS))


def path_columns(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds group, subgroup and code from .../group/subgroup/code.svg."""
    parts = F.split(path, "/")
    return rows.withColumns({"group": F.try_element_at(parts, F.lit(-3)), "subgroup": F.try_element_at(parts, F.lit(-2)), "code": X.stem(F.element_at(parts, -1))})


def pictograms(spark: SparkSession, path: str) -> DataFrame:
    """key, label, category, notes by pictogram number; of repeated numbers the last."""
    rows = or_empty(spark, path, PICTOGRAM_TYPE, lambda: spark.read.schema(PICTOGRAM_TYPE).json(path, multiLine=True))
    rows = rows.select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.get("keywords", F.lit(0))["keyword"], F.lit("")).alias("label"), X.first_categories("categories", "tags").alias("category"),
        F.concat(F.lit("arasaac_id="), F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("notes"), F.monotonically_increasing_id().alias("_at"),
    )
    return last_wins(rows, "key", "_at").drop("_at")


def emoji(spark: SparkSession, path: str) -> DataFrame:
    """key, label, category, notes by hexcode; of repeated codes the last."""
    rows = or_empty(spark, path, EMOJI_TYPE, lambda: spark.read.schema(EMOJI_TYPE).json(path, multiLine=True)).na.fill("")
    rows = rows.select(F.col("hexcode").alias("key"), F.col("annotation").alias("label"), X.joined_parts("group", "subgroups").alias("category"), X.notes(emoji="emoji", tags="tags").alias("notes"), F.monotonically_increasing_id().alias("_at"))
    return last_wins(rows, "key", "_at").drop("_at")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return or_empty(spark, path, RATINGS_TYPE, lambda: csv_strings(spark, path, RATINGS_TYPE)).where("appendix_item <> ''")


def rating_lookup(spark: SparkSession, path: str) -> DataFrame:
    rows = ratings(spark, path).select(F.col("appendix_item").alias("key"), "label", F.lit("").alias("category"), X.notes(appendix_item="appendix_item").alias("notes"), F.monotonically_increasing_id().alias("_at"))
    return last_wins(rows, "key", "_at").drop("_at")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return csv_strings(spark, path, REVIEW_TYPE)


def words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a tab-separated reading: level 5 with text and readable numbers, and their derived edges and centres."""
    raw = spark.read.csv(path, header=True, sep="\t", quote="")
    whole = {c: F.col(c).try_cast("double").cast("int") for c in ("left", "top", "width", "height")}
    w = raw.where((F.trim("level") == "5") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("text", *(v.alias(c) for c, v in whole.items()), F.col("conf").try_cast("double").alias("confidence"))
    w = w.dropna(subset=["left", "top", "width", "height", "confidence"])
    w = w.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")})
    return w.withColumns({"cx": (F.col("left") + F.col("right")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2}).select(*WORDS_TYPE.fieldNames())


def records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header, all columns as text."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True).na.fill("")


def positional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV whose header is skipped and whose columns go by place."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, escape='"')


def named_files(spark: SparkSession, names: list[str] | DataFrame, base: str) -> DataFrame:
    """(name, url, file) of a list of files (a list, or rows with a name), as one request for their metadata wants it."""
    rows = names.select("name") if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select("name", F.concat(F.lit(base), X.url_path("name")).alias("url"), X.safe_name("name").alias("file"))


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct keys that aren't among those done, in order, so that bulk work can be taken up again."""
    return rows.select(key).distinct().join(done.select(key), key, "left_anti").orderBy(key)


def lexical_entries(spark: SparkSession, path: str, row_tag: str = "LexicalEntry") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def svg_documents(spark: SparkSession, root: str) -> DataFrame:
    """(name, svg) of a folder's vector files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").option("recursiveFileLookup", True).load(root)
    return rows.select(X.stem(X.base_name("path")).alias("name"), F.decode("content", "UTF-8").alias("svg"))


def pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """cells of each row of a Markdown table, without its header and rule."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|"))
    cells = F.transform(F.slice(F.split(F.trim("value"), r"\|"), 2, F.size(F.split(F.trim("value"), r"\|")) - 2), lambda c: F.trim(c))
    rows = lines.select(cells.alias("cells"), F.monotonically_increasing_id().alias("_at"))
    rule = rows.where(F.forall("cells", lambda c: c.rlike("^:?-+:?$"))).agg(F.min("_at").alias("_rule"))
    return rows.crossJoin(F.broadcast(rule)).where(F.col("_at") > F.coalesce("_rule", F.lit(-1))).select("cells")  # a single row


def symbol_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, parts) of a word database script."""
    from sigilframe.operators.symbols import word_parts

    schema = "word string, parts array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([x for v in b["value"] for x in word_parts(v).items()], columns=["word", "parts"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def symbol_database(spark: SparkSession, path: str) -> DataFrame:
    """(variable, section, name, body, error) of database scripts, a folder of them or one: an entry of each section (characters, kerning, centres, paths, shapes, words) with its value as
    JSON; a script that can't be read is a row with an error. A missing file reads as an empty one."""
    from sigilframe.functions.script import assignments

    schema = "variable string, section string, name string, body string, error string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)

    def run(batches):
        import json

        import pandas as pd

        for b in batches:
            rows = []
            for script in b["value"]:
                try:
                    found = assignments(script)
                    rows += [(v, section, name, json.dumps(body, ensure_ascii=False, separators=(",", ":")), None) for v, data in found.items() if isinstance(data, dict) for section, entries in data.items() if isinstance(entries, dict) for name, body in entries.items()]
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["variable", "section", "name", "body", "error"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)
