"""Queries over catalogs, names, lookups and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.functions import text as X
from sigilframe.operators import catalog, graph, records, sampling, stats
from sigilframe.sources import sinks

IDS = [s[0] for s in catalog.SETS]
PLACE = {p[0]: (p[1][0], p[2]) for p in catalog.PLACES} | {"11_iso_7010_safety_signs": ("svg/Warning Symbols/", ".svg")}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def set_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def icon_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of icon sets: every seventh in another folder, every eleventh of an unknown set, every fifth with a suffix in capitals."""
    p = table(spark, d, "pages")
    n = F.col("page_id") % 13
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))
    name = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[^A-Za-z0-9]+", "_-"), F.lit("_"), F.col("page_id").cast("string"))
    suffix = pick([PLACE[i][1] for i in IDS])
    set_id = F.when(F.col("page_id") % 11 == 0, "99_unknown").otherwise(pick(IDS))
    folder = F.when(F.col("page_id") % 7 == 0, "other/").otherwise(pick([PLACE[i][0] for i in IDS]))
    return p.select("page_id", F.concat(F.lit("icon_data/iconsets/"), set_id, F.lit("/"), folder, name, F.when(F.col("page_id") % 5 == 0, F.upper(suffix)).otherwise(suffix)).alias("path"))


def _case(values: list[str]) -> str:
    return "CASE CAST(page_id % 13 AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PATHS = f"""p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '99_unknown' ELSE {_case(IDS)} END AS set_id, CASE WHEN page_id % 7 = 0 THEN 'other/' ELSE {_case([PLACE[i][0] for i in IDS])} END AS folder,
 regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '_-', 'g') || '_' || page_id AS stem, CASE WHEN page_id % 5 = 0 THEN upper({_case([PLACE[i][1] for i in IDS])}) ELSE {_case([PLACE[i][1] for i in IDS])} END AS suffix FROM pages),
q AS (SELECT *, 'icon_data/iconsets/' || set_id || '/' || folder || stem || suffix AS path, trim(regexp_replace(regexp_replace(stem, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS slug FROM p)"""


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    lookup = labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("label "), F.col("doc_id").cast("string"))).alias("label"), F.lit("").alias("category"), F.concat(F.lit("n="), F.col("quality").cast("string")).alias("notes"))
    return catalog.build_catalog(icon_paths(spark, d), lookup.limit(0), lookup.limit(0), lookup)


SET_NAMES = " UNION ALL ".join(f"SELECT '{a}' AS set_id, '{b}' AS set_name, '{c}' AS source, '{u}' AS source_url" for a, b, c, u in catalog.SETS)
CATEGORIES = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in catalog.SET_CATEGORIES.items())
CATALOG_SQL = f"""WITH {PATHS}, s AS ({SET_NAMES})
SELECT substr(sha1(path), 1, 16) AS icon_id, q.set_id, set_name, path AS relative_path, stem || suffix AS filename, slug AS label,
 CASE q.set_id {CATEGORIES} WHEN '04_ocha_humanitarian_icons' THEN 'iconsets' WHEN '05_mulberry_symbols' THEN 'iconsets' WHEN '11_iso_7010_safety_signs' THEN 'iconsets' WHEN '06_blissymbolics' THEN 'Blissymbolics char' ELSE '' END AS category,
 lower(substr(suffix, 2)) AS format, s.source, source_url, 'icon_data/normalized_256/' || q.set_id || '/' || substr(replace(lower(slug), ' ', '_'), 1, 80) || '__' || substr(sha1(path), 1, 12) || '.png' AS normalized_path,
 CASE q.set_id WHEN '06_blissymbolics' THEN 'bliss_kind=char' ELSE '' END AS notes
FROM q JOIN s ON q.set_id = s.set_id WHERE folder <> 'other/'"""


def canonical_filter_category(spark: SparkSession, d: str) -> DataFrame:
    p = icon_paths(spark, d).withColumn("set_id", F.get(F.split("path", "/"), F.lit(2)))
    inner = F.regexp_replace("path", "^([^/]*/){3}", "")
    return p.select("page_id", catalog.is_canonical(F.col("set_id"), inner).alias("canonical"), catalog.infer_category(F.col("set_id"), F.col("path")).alias("category"), catalog.infer_category(F.col("set_id"), F.col("path"), True).alias("category_fixed"))


def _canonical_sql() -> str:
    fixed = "regexp_extract(path, '^([^/]*/){3}([^/]*)/?', 2)"
    same = lambda x: f"CASE set_id {CATEGORIES} WHEN '04_ocha_humanitarian_icons' THEN {x.replace('@', '1')} WHEN '05_mulberry_symbols' THEN {x} WHEN '11_iso_7010_safety_signs' THEN {x} WHEN '06_blissymbolics' THEN 'Blissymbolics ' || regexp_replace(split_part(path, '/', 5), 's$', '') ELSE '' END"
    fix4 = f"CASE set_id {CATEGORIES} WHEN '04_ocha_humanitarian_icons' THEN replace({fixed}, 'humanitarian-icons-v2-1-', '') WHEN '05_mulberry_symbols' THEN {fixed} WHEN '11_iso_7010_safety_signs' THEN {fixed} WHEN '06_blissymbolics' THEN 'Blissymbolics ' || regexp_replace(split_part(path, '/', 5), 's$', '') ELSE '' END"
    one = "'iconsets'"
    return f"WITH {PATHS} SELECT page_id, set_id <> '99_unknown' AND folder <> 'other/' AS canonical, {same(one)} AS category, {fix4} AS category_fixed FROM q"


def slug_labels(spark: SparkSession, d: str) -> DataFrame:
    name = X.base_name("path")
    return icon_paths(spark, d).select("page_id", X.stem(name).alias("stem"), X.suffix(name).alias("suffix"), X.slug_label(name).alias("label"), X.short_label(X.slug_label(name), 20).alias("short"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return icon_paths(spark, d).select("page_id", X.icon_id("path").alias("icon_id"), X.normalized_path("path", F.get(F.split("path", "/"), F.lit(2))).alias("normalized"))


def lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    note = labels.select("doc_id", F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("m"))
    return docs.select("doc_id", "source").join(note, "doc_id", "left").select("doc_id", X.or_else(F.col("m"), F.concat(F.lit("item "), F.col("doc_id").cast("string"))).alias("label"), F.col("m").isNotNull().alias("found"))


def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def first_n_per_set(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_of_groups(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], 12)


def sample_then_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("role", "conv_id", "turn")
    return sampling.first_of_groups(rows, ["role"], ["conv_id", "turn"], 40, 60)


def complete_case_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_type") == "error", "abc").when(F.col("event_type") == "view", " 1.5 ").otherwise(F.col("value").cast("string")).alias("v"))
    return stats.complete(e, ("k", "v"))


def grouped_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source in parts of a hundred."""
    g = sinks.grouped(table(spark, d, "documents").select("source", "doc_id", "lang"), "source", ["doc_id"], each=100)
    return g.select("source", "part", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["lang"])), ",").alias("items"))


def explode_variants_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    c = c.select("conv_id", "turn", "n", F.when(F.col("turn") % 2 == 1, F.array(F.struct((F.col("turn") + 1000).alias("turn"), (F.col("n") * 2).alias("n")))).alias("skins"))
    return records.with_variants(c, "skins").withColumn("variant", F.col("variant").cast("long"))


def predicate_or_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("annotation"), F.concat_ws(", ", "lang", "source").alias("tags"), F.lit("").alias("openmoji_tags"), F.lit("").alias("skintone"), F.col("text").alias("title"))
    return records.search(docs, {"annotation": "es"}, ["src3"], None, "th the").select("doc_id")


def name_cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, d, "part").select("p_partkey", X.component_name(k).alias("component"), X.variable_name(k).alias("variable"), X.constant_name(k).alias("constant"), X.title_name(k).alias("title"), X.url_slug("p_name").alias("slug"), X.url_path("p_name").alias("url"))


CAP = "list_transform(string_split(k, '-'), lambda w: upper(w[1:1]) || w[2:])"
CASES = f"""WITH p AS (SELECT p_partkey, p_name, replace(p_name, ' ', '-') AS k FROM part), c AS (SELECT *, array_to_string({CAP}, '') AS c, array_to_string({CAP}, ' ') AS t FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'Icon' ELSE '' END || c || 'Icon' AS component, lower(c[1:1]) || c[2:] AS variable, upper(replace(k, '-', '_')) AS constant, t AS title, replace(lower(p_name), ' ', '-') AS slug, url_encode(p_name) AS url FROM c"""


def markup_cleanup(spark: SparkSession, d: str) -> DataFrame:
    h = F.regexp_replace(F.col("html"), "<(/?)html", "<$1svg")
    return table(spark, d, "pages").select("page_id", F.sha2(X.clean_svg(h), 256).alias("cleaned"), X.view_box(h).alias("view_box"))


def recursive_expand(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a tree (a part's parent is half its key): the leaves below each of the first parts, in order."""
    p = table(spark, d, "part")
    edges = p.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), (F.col("p_partkey") % 2).alias("pos"), F.col("p_partkey").alias("child"))
    roots = p.where("p_partkey between 1 and 15").select(F.col("p_partkey").alias("node"))
    parts = sinks.grouped(graph.leaves(edges, roots), "root", ["path", "leaf"])
    parts = parts.select("root", "part", F.size("items").alias("n"), F.array_join(F.transform("items", lambda x: x["leaf"].cast("string")), ",").alias("leaves"))
    return parts.groupBy("root").agg(F.sum("n").cast("long").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "leaves"))), lambda x: x["leaves"]), ",").alias("leaves"))


def category_reach(spark: SparkSession, d: str) -> DataFrame:
    """Depths of parts reachable from part 1 over links that also lead back."""
    p = table(spark, d, "part")
    down = p.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"))
    edges = down.unionByName(down.where("child % 5 = 0").select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    r = graph.reachable(edges, spark.range(1, 2).withColumnRenamed("id", "node"))
    return r.select("node", F.col("depth").cast("long").alias("depth"))


def kind_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.kind_manifest(table(spark, d, "events"), "event_type").select(F.coalesce("event_type", F.lit("total")).alias("kind"), "n")


def import_status(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    files = o.select(F.concat(F.lit("new/"), F.col("o_custkey").cast("string"), F.lit(".svg")).alias("path")).distinct()
    rec = c.select((F.col("c_custkey") * 2).cast("string").alias("hexcode"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("string").alias("subgroups"))
    there = rec.where("cast(hexcode as long) % 4 = 0").select(F.concat_ws("/", F.lit("src"), "group", "subgroups", F.concat("hexcode", F.lit(".svg"))).alias("path"))
    return records.imports(files, rec, there)


IMPORTS = """WITH f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS h FROM orders), r AS (SELECT CAST(c_custkey * 2 AS VARCHAR) AS h, 'src/' || c_mktsegment || '/' || c_nationkey || '/' || c_custkey * 2 || '.svg' AS t, c_custkey % 2 = 0 AS there FROM customer)
SELECT 'new/' || f.h || '.svg' AS path, f.h AS hexcode, t AS target, CASE WHEN t IS NULL THEN 'ERROR' WHEN there THEN 'OVERWRITE' ELSE 'NEW' END AS status FROM f LEFT JOIN r ON f.h = r.h"""


def type_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("title"), F.when(F.col("value") > 1, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("url"), F.col("event_type").alias("mime"))
    m = records.allowed_types(e, ["click", "view"])
    return m.groupBy(F.coalesce("reason", F.lit("fetch")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))


def enhanced_records(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("hexcode"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string"))).alias("skintone_base_hexcode"))
    extra = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("hexcode"), F.concat(F.lit("tag"), F.col("n_nationkey").cast("string")).alias("openmoji_tags"))
    return records.enhanced(rows, extra)


ENHANCED = """WITH r AS (SELECT n_name AS hexcode, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'NATION_' || n_regionkey END AS b FROM nation), x AS (SELECT n_name AS h, 'tag' || n_nationkey AS t FROM nation WHERE n_nationkey % 2 = 0)
SELECT r.hexcode, r.b AS skintone_base_hexcode, coalesce(CASE WHEN r.b <> '' AND y.h IS NOT NULL THEN y.t ELSE o.t END, '') AS openmoji_tags FROM r LEFT JOIN x o ON o.h = r.hexcode LEFT JOIN x y ON y.h = r.b"""

QUERIES = {
    "set_counts": (set_counts, "SELECT source, count(*) AS n FROM documents GROUP BY source"),
    "catalog_rows": (catalog_rows, CATALOG_SQL),
    "canonical_filter_category": (canonical_filter_category, _canonical_sql()),
    "slug_labels": (slug_labels, f"WITH {PATHS} SELECT page_id, stem, lower(suffix) AS suffix, slug AS label, CASE WHEN length(slug) <= 20 THEN slug ELSE slug[1:19] || '...' END AS short FROM q"),
    "stable_ids": (stable_ids, f"WITH {PATHS} SELECT page_id, substr(sha1(path), 1, 16) AS icon_id, 'icon_data/normalized_256/' || set_id || '/' || substr(replace(lower(slug), ' ', '_'), 1, 80) || '__' || substr(sha1(path), 1, 12) || '.png' AS normalized FROM q"),
    "lookup_with_fallback": (lookup_with_fallback, "SELECT d.doc_id, coalesce(nullif(CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN '' ELSE 'q' || quality END, ''), 'item ' || d.doc_id) AS label, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "dedupe_last_wins": (dedupe_last_wins, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "first_n_per_set": (first_n_per_set, "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12"),
    "sample_then_limit": (sample_then_limit, "SELECT * FROM (SELECT role, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) <= 40) ORDER BY conv_id, turn LIMIT 60"),
    "complete_case_filter": (complete_case_filter, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_type = 'view' THEN 1.5 ELSE value END AS v FROM events WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL AND value IS NOT NULL"),
    "grouped_catalog": (grouped_catalog, "SELECT source, part, count(*) AS n, string_agg(concat_ws(':', doc_id, lang), ',' ORDER BY doc_id) AS items FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS part FROM documents) GROUP BY source, part"),
    "explode_variants_union": (explode_variants_union, "WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, CAST(CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS variant, turn, n FROM c UNION ALL SELECT conv_id, 0, turn + 1000, n * 2 FROM c WHERE turn % 2 = 1"),
    "predicate_or_search": (predicate_or_search, "SELECT doc_id FROM documents WHERE lang = 'es' OR lang = 'src3' OR source = 'src3' OR contains(text, 'th the')"),
    "name_cases": (name_cases, CASES),
    "markup_cleanup": (markup_cleanup, "WITH h AS (SELECT page_id, regexp_replace(html, '<(/?)html', '<\\1svg', 'g') AS h FROM pages) SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<\\?xml[^>]*>|<!DOCTYPE[^>]*>', '', 'g'), '<!--[^>]*-->', '', 'g'), '</?svg[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned, coalesce(nullif(regexp_extract(h, 'viewBox=\"([^\"]+)\"', 1), ''), '0 0 200 200') AS view_box FROM h"),
    "recursive_expand": (recursive_expand, "WITH RECURSIVE w AS (SELECT p_partkey AS root, p_partkey AS node, CAST([] AS BIGINT[]) AS path FROM part WHERE p_partkey BETWEEN 1 AND 15 UNION ALL SELECT root, p_partkey, list_append(path, p_partkey % 2) FROM w JOIN part ON p_partkey > 1 AND p_partkey // 2 = node), l AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey > 1 AND p_partkey // 2 = node)) SELECT root, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY path) AS leaves FROM l GROUP BY root"),
    "category_reach": (category_reach, "WITH RECURSIVE w AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION ALL SELECT p_partkey, depth + 1 FROM w JOIN part ON p_partkey > 1 AND p_partkey // 2 = node) SELECT node, min(depth) AS depth FROM w GROUP BY node"),
    "kind_manifest": (kind_manifest, "SELECT coalesce(event_type, 'total') AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type)"),
    "import_status": (import_status, IMPORTS),
    "type_filter": (type_filter, "SELECT CASE WHEN NOT coalesce(value > 1, false) THEN 'no_url' WHEN event_type NOT IN ('click', 'view') THEN 'mime:' || event_type ELSE 'fetch' END AS reason, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS first_title FROM events GROUP BY 1"),
    "enhanced_records": (enhanced_records, ENHANCED),
}
