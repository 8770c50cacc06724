"""Queries that write the supplied tables in a file format, in a new folder of the shared one, and read them back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.operators import catalog, raster, records
from sigilframe.plans import catalog_queries, feature_queries
from sigilframe.plans.catalog_queries import CATALOG_SQL, table
from sigilframe.schema import EMOJI, FEATURES, METADATA, RATINGS_TYPE
from sigilframe.sources import sinks, tables
from sigilframe.sources.folders import new_path


def json_arrays(rows: DataFrame, bucket: str, path: str) -> None:
    """Files of one JSON array each, for every value of `bucket`, a group of bounded size."""
    cols = [c for c in rows.columns if c != bucket]
    rows.groupBy(bucket).agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value")).write.partitionBy(bucket).text(path)


def catalog_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "catalog")
    sinks.catalog(catalog_queries.catalog_rows(spark, d), path)
    return tables.catalog(spark, path)


def catalog_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Labels as pictograms, emoji and ratings, each in files of its format, looked up by icons of three sets; every third icon has no record."""
    path, lab = new_path(spark, "lookups"), table(spark, d, "labels").withColumn("bucket", F.expr("doc_id div 1000"))
    some, doc = lab.where("doc_id % 3 <> 1"), F.col("doc_id").cast("string")
    words = F.when(F.col("toxic") == 1, F.array().cast("array<struct<keyword:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("word "), doc).alias("keyword"))))
    lists = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    json_arrays(some.select("bucket", F.col("doc_id").alias("_id"), words.alias("keywords"), F.when(F.col("quality") == 1, lists(4)).otherwise(F.array().cast("array<string>")).alias("categories"), F.array(F.lit("t1"), F.lit("t2")).alias("tags")), "bucket", path + "/pictograms")
    code = F.hex(F.col("doc_id") + 0x1F000)
    text = {"hexcode": code, "emoji": doc, "annotation": F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("face "), doc)), "group": F.when(F.col("quality") == 1, "faces").otherwise(""), "subgroups": F.lit("all"), "tags": F.lit("a, b")}
    json_arrays(some.select("bucket", *(text.get(c, F.lit("")).alias(c) for c in EMOJI)), "bucket", path + "/emoji")
    rated = {"appendix_item": F.when(F.col("toxic") == 1, "").otherwise(doc), "label": F.concat(F.lit('Item "'), doc, F.lit('", rated'))}
    sinks.csv(some.select(*(rated.get(c, F.lit("")).alias(c) for c in RATINGS_TYPE.fieldNames())), path + "/ratings")
    top = "icon_data/iconsets/"
    paths = F.array(F.concat(F.lit(top + "07_arasaac_pictograms/png_300/"), doc, F.lit(".png")), F.concat(F.lit(top + "10_openmoji/color/svg/"), code, F.lit(".svg")), F.concat(F.lit(top + "01_mcdougall_symbol_icon_set/extracted_icons_png/mcdougall_"), F.lpad(doc, 7, "0"), F.lit("_x.png")))
    files = lab.select(F.explode(paths).alias("path"))
    built = catalog.build_catalog(files, tables.pictograms(spark, path + "/pictograms"), tables.emoji(spark, path + "/emoji"), tables.rating_lookup(spark, path + "/ratings"))
    return built.select("relative_path", "label", "category", "notes")


LOOKUPS = """WITH l AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t, doc_id % 3 <> 1 AS has, upper(to_hex(doc_id + 126976)) AS code FROM labels)
SELECT 'icon_data/iconsets/07_arasaac_pictograms/png_300/' || doc_id || '.png' AS relative_path, CASE WHEN has AND NOT t THEN 'word ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS label, CASE WHEN NOT has THEN '' WHEN q THEN 'c1; c2; c3' ELSE 't1; t2' END AS category, CASE WHEN has THEN 'arasaac_id=' || doc_id ELSE '' END AS notes FROM l
UNION ALL SELECT 'icon_data/iconsets/10_openmoji/color/svg/' || code || '.svg', CASE WHEN has AND NOT t THEN 'face ' || doc_id ELSE code END, CASE WHEN NOT has THEN '' WHEN q THEN 'faces / all' ELSE 'all' END, CASE WHEN has THEN 'emoji=' || doc_id || '; tags=a, b' ELSE '' END FROM l
UNION ALL SELECT 'icon_data/iconsets/01_mcdougall_symbol_icon_set/extracted_icons_png/mcdougall_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '_x.png', CASE WHEN has AND NOT t THEN 'Item "' || doc_id || '", rated' ELSE 'McDougall item ' || doc_id END, '', 'appendix_item=' || doc_id FROM l"""


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Labels as ratings, and side tables whose files aren't there beside them, which read as empty ones."""
    path, n = new_path(spark, "none"), F.count(F.lit(1)).alias("n")
    rated = {"appendix_item": F.col("doc_id").cast("string"), "label": F.concat(F.lit("item "), F.col("doc_id").cast("string"))}
    sinks.csv(table(spark, d, "labels").select(*(rated.get(c, F.lit("")).alias(c) for c in RATINGS_TYPE.fieldNames())), path + "/ratings")
    kinds = {"pictograms": tables.pictograms, "emoji": tables.emoji, "ratings": tables.ratings, "words": tables.symbol_words}
    out = None
    for name, read in kinds.items():
        one = read(spark, f"{path}/{name}").agg(n).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def feature_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows as CSV; every fifth label is a word for missing, every seventh row lacks a feature and is left out by the reader."""
    f, idx = feature_queries.features(spark, d), F.col("idx")
    meta = {"icon_id": F.lpad(idx.cast("string"), 9, "0"), "label": F.when(idx % 5 == 0, "NA").otherwise(F.concat(F.lit('say "'), idx.cast("string"), F.lit('", a'))), "category": F.lit(""), "normalized_path": F.concat(F.lit("p/"), idx.cast("string"))}
    rows = f.select(*(meta[c].alias(c) if c in meta else F.col(c) for c in METADATA), *(F.when(idx % 7 == 0, F.lit(None)).otherwise(F.col(c)).alias(c) if c == FEATURES[2] else F.col(c) for c in FEATURES))
    path = new_path(spark, "features")
    sinks.features(rows, path)
    return feature_queries.rounded(tables.features(spark, path), *FEATURES)


FEATURE_CSV = "SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS icon_id, 'set_' || label AS set_id, 'Set ' || label AS set_name, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'say \"' || vec_id || '\", a' END AS label, '' AS category, 'p/' || vec_id AS normalized_path, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS {f}" for i, f in enumerate(FEATURES)) + " FROM embeddings WHERE vec_id % 7 <> 0"


def pair_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "pairs")
    sinks.pairs(feature_queries.QUERIES["closest_pairs_all"][0](spark, d), path)
    return tables.positional_csv(spark, path, "rank long, a long, b long, distance double")


def empty_pair_csv(spark: SparkSession, d: str) -> DataFrame:
    """Without pairs the file has no header either: the lines of both files."""
    path, rows = new_path(spark, "pairs"), table(spark, d, "region").select(F.col("r_regionkey").alias("rank"))
    sinks.pairs(rows.where("rank < 0"), path + "/none")
    sinks.pairs(rows, path + "/some")
    lines = lambda x: spark.read.text(f"{path}/{x}").agg(F.count(F.lit(1)).alias("lines")).select(F.lit(x).alias("kind"), "lines")
    return lines("none").unionByName(lines("some"))


def word_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Events as the words of a reading: clicks are of another level, errors have no text, every eleventh has a broken number, quotes stand for themselves."""
    e, n = table(spark, d, "events"), F.col("event_id")
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit('"w'), n.cast("string")))
    cols = {"level": F.when(F.col("event_type") == "click", "4").otherwise("5"), "left": F.when(n % 11 == 0, "x").otherwise((n % 500).cast("string")), "top": (n % 700).cast("string"), "width": (n % 90).cast("string"), "height": (n % 30).cast("string"), "conf": F.concat((n % 100).cast("string"), F.lit(".5")), "text": text}
    path = new_path(spark, "words")
    e.select(*(v.alias(c) for c, v in cols.items())).write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.words(spark, path)


WORDS = "SELECT '\"w' || event_id AS text, CAST(event_id % 500 AS INT) AS \"left\", CAST(event_id % 700 AS INT) AS top, CAST(event_id % 90 AS INT) AS width, CAST(event_id % 30 AS INT) AS height, CAST(event_id % 500 + event_id % 90 AS INT) AS \"right\", CAST(event_id % 700 + event_id % 30 AS INT) AS bottom, event_id % 500 + (event_id % 90) / 2.0::DOUBLE AS cx, event_id % 700 + (event_id % 30) / 2.0::DOUBLE AS cy, event_id % 100 + 0.5::DOUBLE AS confidence FROM events WHERE event_type NOT IN ('click', 'error') AND event_id % 11 <> 0"


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers as CSV, read by the header as text and by place with types."""
    c, path = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('the "'), "c_name", F.lit('", of')).alias("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")), new_path(spark, "customers")
    sinks.csv(c, path)
    text = tables.records_csv(spark, path).select(F.col("c_custkey").cast("long").alias("k"), "c_name", "c_mktsegment")
    place = tables.positional_csv(spark, path, "k long, n string, s string").select("k", F.length("n").cast("long").alias("n"))
    return text.join(place, "k")


def xml_entries(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "entries")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("word"), F.split("p_name", " ").alias("component")).write.format("xml").option("rootTag", "Lexicon").option("rowTag", "LexicalEntry").save(path)
    return tables.lexical_entries(spark, path).select(F.col("id").cast("long").alias("id"), "word", F.array_join("component", "|").alias("parts"))


def pipe_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a Markdown table between other lines, in one file as such tables are."""
    n, path = table(spark, d, "nation").orderBy("n_nationkey"), new_path(spark, "table")
    rows = n.select(F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" |  "), "n_name", F.lit(" | |")).alias("value"), (F.col("n_nationkey") + 10).alias("o"))
    head = spark.createDataFrame([("# Nations", 0), ("", 1), ("| Key | Name | Note |", 2), ("| --- | :-: | --: |", 3)], "value string, o long")
    head.unionByName(rows.withColumn("o", F.col("o").cast("long"))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return tables.pipe_table(spark, path).select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(2)).alias("note"))


def word_database(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names as words of parts, written in order of lower-cased words as a script and read back."""
    p, path = table(spark, d, "part"), new_path(spark, "database")
    w = p.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit("_"), F.col("p_partkey").cast("string")).alias("word"), F.split("p_name", " ").alias("parts"))
    sinks.sorted_words(w).write.text(path)
    return tables.symbol_words(spark, path).select("word", F.array_join("parts", "|").alias("parts"))


def symbol_database(spark: SparkSession, d: str) -> DataFrame:
    """Parts as scripts of characters, centres, kerning, paths and shapes, a thousand parts a script, and all sections read back."""
    path, k = new_path(spark, "scripts"), F.col("p_partkey").cast("string")
    say = lambda text: F.concat(*(k if x == "@" else F.col("p_size").cast("string") if x == "#" else F.replace("p_name", F.lit(" "), F.lit(" \\\"")) if x == "~" else F.lit(x) for x in re.split("([@#~])", text) if x))
    entries = {
        "center": (F.col("p_partkey") % 2 == 0, say('"~@": -16')), "chars": (F.lit(True), say('"~@": {"w": #, h: 1.6e2, "d": ["shape@", {"x": 4, "y": -8.5, "d": "path@"}]}')), "kerning_left": (F.col("p_partkey") % 3 == 0, say("'@': 0x0E")),
        "kerning_right": (F.col("p_partkey") % 5 == 0, say("'@': 2 // the lowest\n")), "paths": (F.lit(True), say("path@: {form: 'line', x1: 0, y1: 0, x2: #, y2: +12}")), "shapes": (F.lit(True), say('"shape@": [{"x": 1, "y": 2, "d": "path@",},]')),
    }
    part = table(spark, d, "part").withColumn("bucket", F.expr("p_partkey div 1000"))
    lists = part.groupBy("bucket").agg(*(F.array_join(F.collect_list(F.when(*e)), ", ").alias(name) for name, e in entries.items()))
    body = F.concat(F.lit("/* data\n */ var DATA = {\n"), F.concat_ws(",\n", *(F.concat(F.lit(f'\t"{name}": {{'), F.col(name), F.lit("}")) for name in entries)), F.lit("\n};\n"))
    lists.select("bucket", body.alias("value")).write.partitionBy("bucket").text(path)
    return tables.symbol_database(spark, path)


SCRIPT = """WITH p AS (SELECT p_partkey AS k, p_size AS s, replace(p_name, ' ', ' "') || p_partkey AS n FROM part)
SELECT 'DATA' AS variable, section, name, body, CAST(NULL AS VARCHAR) AS error FROM (
SELECT 'center' AS section, n AS name, '-16' AS body FROM p WHERE k % 2 = 0 UNION ALL SELECT 'chars', n, '{"w":' || s || ',"h":160.0,"d":["shape' || k || '",{"x":4,"y":-8.5,"d":"path' || k || '"}]}' FROM p UNION ALL SELECT 'kerning_left', k::VARCHAR, '14' FROM p WHERE k % 3 = 0
UNION ALL SELECT 'kerning_right', k::VARCHAR, '2' FROM p WHERE k % 5 = 0 UNION ALL SELECT 'paths', 'path' || k, '{"form":"line","x1":0,"y1":0,"x2":' || s || ',"y2":12}' FROM p UNION ALL SELECT 'shapes', 'shape' || k, '[{"x":1,"y":2,"d":"path' || k || '"}]' FROM p)"""


def failure_json(spark: SparkSession, d: str) -> DataFrame:
    """Rasters, every third of them broken or missing: features and failures, both written and read back."""
    rows = feature_queries.raster_rows(spark, d).withColumn("content", F.when(F.col("idx") % 6 == 1, F.lit(None)).when(F.col("idx") % 6 == 4, F.substring("content", 1, 100)).otherwise(F.col("content")))
    chosen = tuple(e for e in raster.EXTRACTORS if e.name == "connected_components")
    good, bad = raster.split_failures(raster.extract(rows, "idx", extractors=chosen, decode=raster.of_vector("v")), "idx")
    path = new_path(spark, "failures")
    sinks.json(bad, path)
    read = spark.read.schema("idx long, error string").json(path)
    return read.select("idx", F.substring_index("error", ":", 1).alias("problem")).unionByName(good.select("idx", F.lit("").alias("problem")))


def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    n, path = table(spark, d, "embeddings").count(), new_path(spark, "metadata")
    sinks.json(sinks.run_metadata(spark, "in.csv", "out.csv", n, n, 100, raster.EXTRACTORS), path)
    m = spark.read.json(path)
    return m.select("input", "output", "row_count", "selected_row_count", "per_set_limit", F.array_join(F.flatten("features.columns"), ",").alias("columns"))


def wide_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the five regions' keys, one column a region."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    long = r.select(F.col("k").alias("source"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(5)))).alias("target"))
    out = sinks.wide_matrix(long.withColumn("distance", F.abs(F.col("source") - F.col("target")).cast("double")), list(range(5)))
    return out.select("source", *(F.col(str(i)).alias(f"to_{i}") for i in range(5)))


def download_manifest(spark: SparkSession, d: str) -> DataFrame:
    e, path = table(spark, d, "events"), new_path(spark, "manifest")
    rows = records.allowed_types(e.select(F.col("event_id").cast("string").alias("title"), F.when(F.col("value") > 1, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("url"), F.col("event_type").alias("mime")), ["click", "view"])
    sinks.json(sinks.manifest(rows), path)
    return spark.read.schema("list string, title string, url string, reason string").json(path)


def listing_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of four text outputs: separated values, a generated module, the names of a listing, and a report."""
    n, path = table(spark, d, "nation"), new_path(spark, "lines")
    named = n.select("n_nationkey", F.concat("n_name", F.lit(" & <b>'s")).alias("n_name"))
    sinks.tsv(named, ["n_name", "n_nationkey"]).write.text(path + "/tsv")
    sinks.constants_module(n.select(F.col("n_name").alias("k"), F.concat(F.lit('v"'), F.col("n_nationkey").cast("string")).alias("v")), "k", "v").write.text(path + "/module")
    sinks.path_list(n.select(F.concat(F.lit("a/b/"), "n_name", F.lit(".svg")).alias("path"))).write.text(path + "/paths")
    sinks.html_rows(named, "Nations", ["n_nationkey"]).select("line").write.text(path + "/report")
    out = None
    for kind in ("tsv", "module", "paths", "report"):
        one = spark.read.text(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out.where("line <> ''")


LINES = """SELECT 'tsv' AS kind, n_name || ' & <b>''s' || chr(9) || n_nationkey AS line FROM nation UNION ALL SELECT 'module', 'export const ' || n_name || ' = "v\\"' || n_nationkey || '";' FROM nation UNION ALL SELECT 'paths', n_name FROM nation
UNION ALL SELECT 'report', '<tr><td>' || n_nationkey || '</td><td>' || n_name || ' &amp; &lt;b&gt;&#x27;s</td></tr>' FROM nation UNION ALL SELECT 'report', '</table></body></html>'
UNION ALL SELECT 'report', '<!doctype html><html><head><meta charset=''utf-8''><title>Nations</title></head><body><h1>Nations</h1><table><tr><th>n_nationkey</th><th>n_name</th></tr>'"""

QUERIES = {
    "catalog_csv_round_trip": (catalog_csv_round_trip, CATALOG_SQL),
    "catalog_lookups": (catalog_lookups, LOOKUPS),
    "missing_sources": (missing_sources, "SELECT unnest(['pictograms', 'emoji', 'words']) AS source, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'ratings', count(*) FROM labels"),
    "feature_csv_round_trip": (feature_csv_round_trip, FEATURE_CSV),
    "pair_csv_round_trip": (pair_csv_round_trip, feature_queries.QUERIES["closest_pairs_all"][1]),
    "empty_pair_csv": (empty_pair_csv, "SELECT 'none' AS kind, CAST(0 AS BIGINT) AS lines UNION ALL SELECT 'some', count(*) + 1 FROM region"),
    "word_tsv": (word_tsv, WORDS),
    "csv_records": (csv_records, "SELECT CAST(c_custkey AS BIGINT) AS k, 'the \"' || c_name || '\", of' AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS c_mktsegment, length(c_name) + 10 AS n FROM customer"),
    "xml_entries": (xml_entries, "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS word, replace(p_name, ' ', '|') AS parts FROM part"),
    "pipe_table_rows": (pipe_table_rows, "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, '' AS note FROM nation"),
    "symbol_database": (symbol_database, SCRIPT),
    "word_database": (word_database, "SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || '_' || p_partkey AS word, replace(p_name, ' ', '|') AS parts FROM part"),
    "failure_json": (failure_json, "SELECT CAST(vec_id AS BIGINT) AS idx, CASE vec_id % 6 WHEN 1 THEN 'FileNotFoundError' WHEN 4 THEN 'ValueError' ELSE '' END AS problem FROM embeddings"),
    "run_metadata": (run_metadata, f"SELECT 'in.csv' AS input, 'out.csv' AS output, count(*) AS row_count, count(*) AS selected_row_count, CAST(100 AS BIGINT) AS per_set_limit, '{','.join(FEATURES)}' AS columns FROM embeddings"),
    "wide_matrix": (wide_matrix, "SELECT CAST(r_regionkey AS BIGINT) AS source, " + ", ".join(f"CAST(abs(r_regionkey - {i}) AS DOUBLE) AS to_{i}" for i in range(5)) + " FROM region"),
    "download_manifest": (download_manifest, "SELECT CASE WHEN value > 1 AND event_type IN ('click', 'view') THEN 'downloaded' ELSE 'skipped' END AS list, CAST(event_id AS VARCHAR) AS title, CASE WHEN value > 1 AND event_type IN ('click', 'view') THEN 'u' || event_id END AS url, CASE WHEN NOT coalesce(value > 1, false) THEN 'no_url' WHEN event_type NOT IN ('click', 'view') THEN 'mime:' || event_type END AS reason FROM events"),
    "listing_lines": (listing_lines, LINES),
}
