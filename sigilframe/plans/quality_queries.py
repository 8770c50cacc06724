"""Queries of table repair, checks, plans and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigilframe.functions import ocr as O
from sigilframe.operators import drawings, ocr, quality, records, sampling, symbols

FIELD = "element_at(array('concreteness', 'complexity_metric', 'name_agreement'), cast(l_linenumber % 3 as int) + 1)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as readings of table fields: raw text with lost points and stray marks, and a confidence."""
    li = table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    raw = F.concat(F.when(F.col("l_tax") > 0.05, "~").otherwise(""), F.substring(cents.cast("string"), 1, (F.col("l_quantity") % 5).cast("int")), F.when(F.col("l_discount") > 0.07, ".").otherwise(""))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(FIELD).alias("field"), raw.alias("raw"), (F.col("l_quantity") * 2).alias("confidence"))


READ = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'concreteness' WHEN 1 THEN 'complexity_metric' ELSE 'name_agreement' END AS field,
 CASE WHEN l_tax > 0.05 THEN '~' ELSE '' END || substr(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 1, CAST(l_quantity % 5 AS INT)) || CASE WHEN l_discount > 0.07 THEN '.' ELSE '' END AS raw, l_quantity * 2 AS confidence FROM lineitem)"""
# In these readings a point can only stand last.
VALUE = """v AS (SELECT *, regexp_replace(raw, '[^0-9.]', '', 'g') AS k, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM r),
w AS (SELECT *, CASE WHEN k LIKE '%.' THEN k WHEN field = 'concreteness' AND length(k) = 2 THEN k[1:1] || '.' || k[2:] || '0' WHEN length(k) = 3 THEN k[1:1] || '.' || k[2:] WHEN field = 'name_agreement' AND length(k) = 4 THEN k[1:2] || '.' || k[3:] ELSE k END AS s FROM v),
n AS (SELECT *, CASE WHEN k = '' THEN '' WHEN field = 'complexity_metric' THEN coalesce(CAST(TRY_CAST(g AS BIGINT) AS VARCHAR), '') ELSE coalesce(printf('%.2f', CASE WHEN field = 'name_agreement' AND TRY_CAST(s AS DOUBLE) > 100 THEN CAST(CASE length(g) WHEN 3 THEN g[1:2] || '.' || g[3:] || '0' WHEN 4 THEN g[1:2] || '.' || g[3:] ELSE s END AS DOUBLE) ELSE TRY_CAST(s AS DOUBLE) END), '') END AS value FROM w)"""


def _reason(value: str, confidence: str) -> str:
    num = f"TRY_CAST({value} AS DOUBLE)"
    return f"CASE WHEN {value} = '' THEN 'missing_numeric' WHEN field = 'complexity_metric' THEN CASE WHEN NOT {num} BETWEEN 0 AND 100 THEN 'complexity_metric_out_of_range' WHEN {confidence} < 70 THEN 'low_confidence' ELSE '' END WHEN field = 'name_agreement' THEN CASE WHEN NOT {num} BETWEEN 0 AND 100 THEN 'agreement_out_of_range' WHEN {confidence} < 80 THEN 'low_confidence' ELSE '' END ELSE CASE WHEN NOT {num} BETWEEN 1 AND 5 THEN 'rating_out_of_range' WHEN {confidence} < 85 THEN 'low_confidence' ELSE '' END END"


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
REASONED = f"WITH {READ}, {VALUE}, q AS (SELECT *, {_reason('value', 'confidence')} AS reason FROM n)"


def valued(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    r = r.withColumn("value", O.normalize_number(F.col("raw"), F.col("field")))
    return r.withColumn("reason", O.review_reason(F.col("field"), F.col("value"), F.col("confidence")))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def ocr_number_repair(spark: SparkSession, d: str) -> DataFrame:
    return valued(spark, d).select(*KEYS, "field", "raw", "value")


def review_reason(spark: SparkSession, d: str) -> DataFrame:
    return valued(spark, d).select(*KEYS, "reason")


def fallback_rows(spark: SparkSession, d: str) -> DataFrame:
    r = valued(spark, d).drop("reason")
    other = F.when(F.col("l_partkey") % 2 == 0, "3.50").otherwise("")
    return ocr.with_fallback(r.withColumns({"other_value": other, "other_confidence": F.when(other != "", 70.0).otherwise(0.0), "other_raw": other}))


def fallback_arbitration(spark: SparkSession, d: str) -> DataFrame:
    return fallback_rows(spark, d).select(*KEYS, "value", "confidence", "reason", (F.col("replaced").isNotNull()).alias("replaced"))


FALLBACK = f"""{REASONED}, o AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN '3.50' ELSE '' END AS ov, CASE WHEN l_partkey % 2 = 0 THEN 70.0 ELSE 0.0 END AS oc FROM q), p AS (SELECT *, {_reason('ov', 'oc')} AS orsn FROM o),
t AS (SELECT *, reason <> '' AND CASE WHEN reason <> 'low_confidence' AND orsn IN ('', 'low_confidence') THEN true WHEN orsn = '' THEN true ELSE oc > confidence + 10 END AS take FROM p)"""


def corrected_rows(spark: SparkSession, d: str) -> DataFrame:
    fix = spark.createDataFrame([(int(i), "concreteness", f"{1 + i % 4}.25") for i in range(1, 30)], "l_suppkey long, field string, correction string")
    return ocr.corrected(fallback_rows(spark, d), fix, ["l_suppkey", "field"])


def corrections_overlay(spark: SparkSession, d: str) -> DataFrame:
    return corrected_rows(spark, d).select(*KEYS, "value", "reason", "corrected")


def review_long(spark: SparkSession, d: str) -> DataFrame:
    r = ocr.reviews(corrected_rows(spark, d), KEYS)
    return r.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("confidence").alias("confidence"))


CORRECTED = f"""{FALLBACK}, u AS (SELECT {KEY}, field, raw, CASE WHEN take THEN ov ELSE value END AS v, CASE WHEN take THEN oc ELSE confidence END AS c, CASE WHEN take THEN orsn ELSE reason END AS rs, CASE WHEN take THEN ov ELSE raw END AS rw,
 CASE WHEN take AND value <> ov THEN value || ' -> ' || ov END AS replaced FROM t),
x AS (SELECT u.*, CASE WHEN field = 'concreteness' AND l_suppkey BETWEEN 1 AND 29 THEN CAST(1 + l_suppkey % 4 AS VARCHAR) || '.25' END AS fix FROM u),
y AS (SELECT *, CASE WHEN fix IS NOT NULL AND fix <> v THEN (CASE WHEN v <> '' THEN v ELSE rw END) || ' -> ' || fix END AS corrected, CASE WHEN fix IS NOT NULL AND fix <> v THEN fix ELSE v END AS nv FROM x),
z AS (SELECT *, CASE WHEN corrected IS NULL THEN rs ELSE {_reason('nv', 'c')} END AS nr FROM y)"""
REVIEWS = f"""{CORRECTED}, m AS (SELECT field, replaced AS value, c, 'fallback_from:' || CASE WHEN raw <> '' THEN raw ELSE 'blank' END AS reason FROM z WHERE replaced IS NOT NULL
 UNION ALL SELECT field, corrected, c, 'explicit_ocr_correction' FROM z WHERE corrected IS NOT NULL UNION ALL SELECT field, CASE WHEN nv <> '' THEN nv ELSE rw END, c, nr FROM z WHERE nr <> '')
SELECT field, reason, count(*) AS n, min(value) AS low, max(printf('%.2f', c)) AS confidence FROM m GROUP BY field, reason"""

BOXES = [(i, 5.0 * i, 1000.0 * i, 5.0 * i + 12, 1000.0 * i + 30000) for i in range(10)]


def box_containment_join(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame([(int(i), *b) for i, *b in BOXES], "box_id long, x1 double, y1 double, x2 double, y2 double")
    hit = ocr.contained(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), boxes, "l_quantity", "l_extendedprice")
    return hit.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"))


BOX_SQL = "WITH b(box_id, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {a}, {b}, {c}, {e})" for i, a, b, c, e in BOXES) + ") SELECT box_id, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem JOIN b ON l_quantity BETWEEN x1 AND x2 AND l_extendedprice BETWEEN y1 AND y2 GROUP BY box_id"


def max_confidence_first_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.round("value", 0).alias("confidence"), "event_type")
    return sampling.best_by_confidence(e, ["user_id"], "confidence", "event_id")


def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("value") - 10).alias("confidence"))
    return ocr.mean_confidence(e, ["user_id"]).withColumn("mean_confidence", F.round("mean_confidence", 6))


def item_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items, numbered by their keys, over as many pages as that takes."""
    n = records.numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "item")
    g = ocr.geometry(ocr.placed(n))
    return g.select("o_orderkey", F.col("item").cast("long").alias("item"), *(F.col(c).cast("long").alias(c) for c in ("page", "row", "top")), "side", F.col("label_box.x1").cast("long").alias("x1"), F.col("common_box.y2").cast("long").alias("y2"))


ITEMS = """SELECT o_orderkey, item, CAST((item - 1) // 10 AS BIGINT) AS page, CAST(((item - 1) % 10) // 2 AS BIGINT) AS row, CAST([320, 660, 1000, 1340, 1710][((item - 1) % 10) // 2 + 1] AS BIGINT) AS top, CASE WHEN (item - 1) % 2 = 0 THEN 'left' ELSE 'right' END AS side,
CAST(CASE WHEN (item - 1) % 2 = 0 THEN 200 ELSE 890 END AS BIGINT) AS x1, CAST([320, 660, 1000, 1340, 1710][((item - 1) % 10) // 2 + 1] + 335 AS BIGINT) AS y2 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS item FROM orders)"""


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as words of one box, in lines."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") * 10).alias("cy"), (F.col("event_id") % 100).cast("int").alias("left"))
    return ocr.in_lines(e, ["user_id"]).select("user_id", "event_id", "line", "place")


PALETTE = [(r, g, b) for r in (0, 96, 190) for g in (20, 120, 220) for b in (40, 200)] + [(255, 255, 255), (10, 10, 10), (128, 0, 0), (0, 128, 0), (0, 0, 128), (77, 77, 77)]


def nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 256).alias("r"), ((F.col("p_partkey") * 91) % 256).alias("g"), ((F.col("p_size") * 5) % 256).cast("long").alias("b"))
    return quality.nearest_colour(p, "p_partkey", ("r", "g", "b"), PALETTE).withColumn("distance", F.round("distance", 6))


PALETTE_SQL = "WITH c(i, r, g, b, name) AS (VALUES " + ", ".join(f"({i}, {p[0]}, {p[1]}, {p[2]}, '#{p[0]:02x}{p[1]:02x}{p[2]:02x}')" for i, p in enumerate(PALETTE)) + "), p AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_size * 5) % 256 AS b FROM part), d AS (SELECT p_partkey, name, i, CAST((p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b) AS DOUBLE) AS q FROM p, c) SELECT p_partkey, name AS colour, round(sqrt(q), 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY q, i) = 1"


def reconcile_missing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_custkey") + 7).alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return quality.reconcile(c, o, "k", "customer", "orders")


def referential_violations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("k"), (F.col("s_suppkey") % 5).cast("int").alias("region"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("k"), "n_regionkey")
    return quality.referential(s, n, "k", {"region": "n_regionkey"}).select("s_suppkey", "k", "problem")


def uniqueness_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_unique(table(spark, d, "documents").select(F.sha2("text", 256).alias("hash")), "hash")


def absent_files(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    listing = n.where("k % 2 = 0").select(F.concat(F.lit("color/"), "name").alias("path")).unionByName(n.where("k % 3 = 0").select(F.concat(F.lit("black/"), "name").alias("path")))
    return quality.absent(n.select("name"), [F.concat(F.lit("color/"), F.col("name")), F.concat(F.lit("black/"), F.col("name"))], listing).select("name", "path")


def hashed_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1("text").alias("h"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    now = docs.select(name.alias("file"), F.col("h").alias("hash"))
    memo = docs.select(name.alias("file"), F.when(F.col("doc_id") % 50 == 0, "changed").otherwise(F.col("h")).alias("hash"))
    plan = docs.select(F.concat(F.lit("build "), F.expr("doc_id div 3").cast("string")).alias("line"), name.alias("file")).groupBy("line").agg(F.collect_list("file").alias("files"))
    return plan, now, memo


def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    return quality.stale(*hashed_documents(spark, d))


def build_plan(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_custkey").cast("string").alias("code"))
    return quality.build_plan(spark, g, ["72", "618"]).select("line")


def id_gaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.gaps(table(spark, d, "orders").select("o_orderstatus", (F.col("o_orderkey") + F.expr("o_orderkey div 9")).alias("x")), "o_orderstatus", "x")


def markup_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("m", F.regexp_replace("html", "<html", "<svg width=\"15\" height=\"15\""))
    return quality.markup_problems(p, "m", "page_id", banned=("script", "style", "div")).select("page_id", F.array_join("problems", ",").alias("problems"))


MARKUP = """WITH p AS (SELECT page_id, replace(html, '<html', '<svg width="15" height="15"') AS m FROM pages), h AS (SELECT page_id, m, regexp_extract(m, '<svg([^>]*)>', 1) AS s FROM p),
r AS (SELECT page_id, concat_ws(',', CASE WHEN s = '' THEN 'not_svg' END, CASE WHEN NOT (s LIKE '%width="15"%' AND s LIKE '%height="15"%') THEN 'size' END, CASE WHEN regexp_extract(s, 'viewBox="([^"]*)"', 1) <> '0 0 15 15' THEN 'view_box' END,
 CASE WHEN regexp_matches(m, '\\d(em|pt|cm|mm|in|%)"') THEN 'unit' END, CASE WHEN regexp_matches(m, '<(script|style|div)[\\s/>]') THEN 'banned_element' END, CASE WHEN len(regexp_extract_all(m, '<path[\\s/>]')) <> 1 THEN 'paths' END, CASE WHEN regexp_matches(m, '\\stransform=') THEN 'transform' END) AS problems FROM h)
SELECT page_id, problems FROM r WHERE problems <> ''"""


def part_drawings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as layered drawings; every ninth is broken."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('<svg id="emoji" viewBox="0 0 72 72"><g id="grid"><rect width="'), k, F.lit('" /></g><g id="skin"><path d="M'), k, F.lit('" fill="#fcea2b" stroke="#fcea2b" /></g><g id="line"><path d="M0" stroke="#000" /></g>'))
    return table(spark, d, "part").select("p_partkey", F.concat(body, F.when(F.col("p_partkey") % 9 == 4, "").otherwise("</svg>")).alias("svg_in"))


def drawing_tones(spark: SparkSession, d: str) -> DataFrame:
    r = drawings.rewritten(part_drawings(spark, d), "p_partkey", "svg_in", *drawings.toned("#a57939", "#8b5e2b"), drawings.mirrored())
    return r.select("p_partkey", "svg", F.col("error").isNotNull().alias("failed"))


TONES = """SELECT p_partkey, CASE WHEN p_partkey % 9 <> 4 THEN '<svg id="emoji" viewBox="0 0 72 72"><g id="skin" transform="scale(-1, 1) translate(-72, 0)"><path d="M' || p_partkey || '" fill="#a57939" stroke="#a57939" /></g><g id="line" transform="scale(-1, 1) translate(-72, 0)"><path d="M0" stroke="#000" /></g></svg>' END AS svg, p_partkey % 9 = 4 AS failed FROM part"""


def running_layout(spark: SparkSession, d: str) -> DataFrame:
    """Turns as characters: x runs on by width and by the gap to the one before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 100).cast("long").alias("w"), (F.length("text") % 200).cast("long").alias("h"), F.when(F.col("turn") % 3 == 0, "(digit)").when(F.col("turn") % 3 == 1, "comma").otherwise("(uppercase)").alias("name"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("k", symbols.default_kerning(F.col("h")))
    prev = F.lag("name").over(order)
    closes = symbols.touches(F.lag("w").over(order), F.col("w"), F.lag("k").over(order), F.col("k"))
    c = c.withColumn("gap", symbols.spacing(prev, F.col("name"), closes).cast("long"))
    x = F.sum(F.col("gap") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    return c.select("conv_id", "turn", "gap", x.alias("x"))


LAYOUT = """WITH c AS (SELECT conv_id, turn, length(text) % 100 AS w, length(text) % 200 AS h, CASE turn % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END AS n FROM conversations),
k AS (SELECT *, CASE WHEN h = 0 THEN 12 WHEN h <= 80 THEN 2 WHEN h <= 144 THEN 6 ELSE 14 END AS k FROM c),
l AS (SELECT *, lag(n) OVER o AS pn, lag(w) OVER o AS pw, lag(k) OVER o AS pk FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CAST(CASE WHEN pn IS NULL OR (pw > 24 AND w > 24 AND (pk & k) = 0) THEN 0 WHEN pn = n AND n IN ('d', 'u') THEN 16 WHEN n = 'c' THEN 24 ELSE 32 END AS BIGINT) AS gap FROM l)
SELECT conv_id, turn, gap, CAST(sum(gap + w) OVER (PARTITION BY conv_id ORDER BY turn) - w AS BIGINT) AS x FROM g"""

QUERIES = {
    "ocr_number_repair": (ocr_number_repair, f"WITH {READ}, {VALUE} SELECT {KEY}, field, raw, value FROM n"),
    "review_reason": (review_reason, f"{REASONED} SELECT {KEY}, reason FROM q"),
    "fallback_arbitration": (fallback_arbitration, f"{FALLBACK} SELECT {KEY}, CASE WHEN take THEN ov ELSE value END AS value, CASE WHEN take THEN oc ELSE confidence END AS confidence, CASE WHEN take THEN orsn ELSE reason END AS reason, take AND value <> ov AS replaced FROM t"),
    "corrections_overlay": (corrections_overlay, f"{CORRECTED} SELECT {KEY}, nv AS value, nr AS reason, corrected FROM z"),
    "review_long": (review_long, REVIEWS),
    "box_containment_join": (box_containment_join, BOX_SQL),
    "max_confidence_first_wins": (max_confidence_first_wins, "SELECT user_id, event_id, round(value, 0) AS confidence, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0) DESC, event_id) = 1"),
    "mean_confidence": (mean_confidence, "SELECT user_id, round(coalesce(avg(value - 10) FILTER (value - 10 >= 0), 0), 6) AS mean_confidence FROM events GROUP BY user_id"),
    "item_numbering": (item_numbering, ITEMS),
    "word_lines": (word_lines, None),
    "nearest_palette": (nearest_palette, PALETTE_SQL),
    "reconcile_missing": (reconcile_missing, "WITH c AS (SELECT c_custkey + 7 AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT 'orders' AS missing_in, k FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'customer', k FROM o WHERE k NOT IN (SELECT k FROM c)"),
    "referential_violations": (referential_violations, "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM supplier LEFT JOIN (SELECT n_nationkey + 1 AS n_nationkey, n_regionkey FROM nation) n ON s_nationkey = n_nationkey WHERE n_nationkey IS NULL OR s_suppkey % 5 <> n_regionkey"),
    "uniqueness_violations": (uniqueness_violations, "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) <> 1"),
    "absent_files": (absent_files, "SELECT n_name AS name, 'color/' || n_name AS path FROM nation WHERE n_nationkey % 2 <> 0 UNION ALL SELECT n_name, 'black/' || n_name FROM nation WHERE n_nationkey % 3 <> 0"),
    "incremental_plan": (incremental_plan, "SELECT DISTINCT 'build ' || (doc_id // 3) AS line FROM documents WHERE doc_id % 50 = 0"),
    "build_plan": (build_plan, "SELECT s || '/' || c_mktsegment || '/' || c_custkey || '.png' || chr(9) || 'src/' || c_mktsegment || '/' || c_custkey || '.svg' AS line FROM customer, (VALUES ('72'), ('618')) t(s)"),
    "id_gaps": (id_gaps, "WITH d AS (SELECT DISTINCT o_orderstatus, o_orderkey + o_orderkey // 9 AS x FROM orders), e AS (SELECT o_orderstatus, count(*) AS n, min(x) AS low, max(x) AS high FROM d GROUP BY 1), f AS (SELECT o_orderstatus, min(x + 1) AS next_free FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.o_orderstatus = a.o_orderstatus AND b.x = a.x + 1) GROUP BY 1) SELECT e.o_orderstatus, n, low, high, next_free FROM e JOIN f ON e.o_orderstatus = f.o_orderstatus"),
    "markup_rule_violations": (markup_rule_violations, MARKUP),
    "running_layout": (running_layout, LAYOUT),
    "drawing_tones": (drawing_tones, TONES),
}
