"""Queries of records, readings, drawings and words whose operators the other modules' queries don't run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.functions import text as X
from sigilframe.operators import graph, ocr, quality, records, symbols
from sigilframe.plans import catalog_queries, feature_queries
from sigilframe.plans.catalog_queries import table
from sigilframe.sources import tables


def record_text(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    code = F.hex(F.col("p_partkey") + 0x1F000)
    ident = F.concat(F.upper("p_name"), F.lit(","), k)
    return p.select(
        "p_partkey", X.safe_name(F.concat(F.lit("File:"), F.replace("p_name", F.lit(" "), F.lit("/")))).alias("safe"), X.plain_text(F.concat(F.lit(" é "), "p_name", F.lit(" ## (x)/y "))).alias("plain"), X.symbol_name(ident).alias("symbol"),
        X.fill_template(F.lit("{name} of {size}, {other}"), F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))).alias("filled"),
        X.code_point(code).alias("point"), X.hex_of(X.code_point(code)).alias("code"), X.characters(F.concat(F.lit("41-"), code)).alias("text"),
        X.notes(key=k, name=F.lit(None).cast("string")).alias("notes"), X.joined_parts("p_name", F.lit(""), k).alias("joined"), X.first_categories(F.split("p_name", " "), F.array(F.lit("t"))).alias("first"),
    )


TEXT = """SELECT p_partkey, replace(p_name, ' ', '_') AS safe, p_name || ' (x)/y' AS plain, replace(p_name, ' ', '_') || '_' || substr(sha1(upper(p_name) || ',' || p_partkey), 1, 12) AS symbol, p_name || ' of ' || p_size || ', {other}' AS filled,
 CAST(p_partkey + 126976 AS BIGINT) AS point, upper(to_hex(CAST(p_partkey + 126976 AS BIGINT))) AS code, 'A' || chr(CAST(p_partkey + 126976 AS INT)) AS text, 'key=' || p_partkey || '; name=' AS notes, p_name || ' / ' || p_partkey AS joined, array_to_string(string_split(p_name, ' ')[1:3], '; ') AS first FROM part"""


def emoji_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records: some without an author, some with a skin tone, one in six without an order."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.hex(k + 0x1F000).alias("hexcode"), "c_custkey", F.when(k % 4 == 0, "").otherwise("someone").alias("openmoji_author"), F.when(k % 5 == 0, "2").otherwise("").alias("skintone"), F.when(k % 8 == 0, "").otherwise(F.col("c_mktsegment")).alias("group"),
        F.col("c_nationkey").cast("string").alias("subgroups"), F.when(k % 6 == 0, "").otherwise((k % 50).cast("string")).alias("order"), F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("unicode"),
    )


EMOJI_SQL = """e AS (SELECT upper(to_hex(CAST(c_custkey + 126976 AS BIGINT))) AS hexcode, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'someone' END AS author, CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE '' END AS skintone, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_mktsegment END AS grp,
 CAST(c_nationkey AS VARCHAR) AS sub, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 50 END AS o, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey END AS unicode FROM customer)"""


def emoji_published(spark: SparkSession, d: str) -> DataFrame:
    """Designed records and two tables of extras in their published order."""
    rows = emoji_rows(spark, d)
    extra = rows.select(F.concat(F.lit("E"), "hexcode").alias("hexcode"), *[c for c in rows.columns if c != "hexcode"])
    published, _ = records.emoji_tables(rows, extra.where("openmoji_author = ''"), extra.where("skintone = '2'").withColumn("hexcode", F.concat(F.lit("F"), "hexcode")))
    return records.numbered(published, records.emoji_keys(), "position").select("hexcode", "position")


PUBLISHED = f"""WITH {EMOJI_SQL}, u AS (SELECT hexcode, o, grp, sub FROM e WHERE NOT (author = '' AND skintone = '' AND grp <> '') UNION ALL SELECT 'E' || hexcode, o, grp, sub FROM e WHERE author = '' UNION ALL SELECT 'FE' || hexcode, o, grp, sub FROM e WHERE skintone = '2')
SELECT hexcode, row_number() OVER (ORDER BY o NULLS LAST, grp, sub, hexcode) AS position FROM u"""


def emoji_missing(spark: SparkSession, d: str) -> DataFrame:
    return records.missing_designs(emoji_rows(spark, d)).select("hexcode", "subgroups")


def base_emoji(spark: SparkSession, d: str) -> DataFrame:
    return records.base_records(emoji_rows(spark, d).withColumn("hexcode", F.when(F.col("c_custkey") == 3, "1F3FB").otherwise(F.col("hexcode")))).select("c_custkey")


def typed_export(spark: SparkSession, d: str) -> DataFrame:
    return records.typed(emoji_rows(spark, d).drop("order"), ["hexcode"]).select("hexcode", F.col("order").cast("long").alias("order"), "unicode", "skintone")


def record_files(spark: SparkSession, d: str) -> DataFrame:
    return records.record_paths(emoji_rows(spark, d), "root").select("hexcode", F.col("files.color.svg").alias("color"), F.col("files.black.svg").alias("black"))


def code_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders' keys as codes by status: private-use ones, others, and combinations."""
    k = F.col("o_orderkey")
    code = F.when(k % 5 == 0, F.concat(F.hex(k % 6000 + 0xE000), F.lit("-200D"))).otherwise(F.hex(k % 9000 + 0xE000))
    return records.code_summary(table(spark, d, "orders").select("o_orderstatus", code.alias("hexcode")), ["o_orderstatus"])


SUMMARY = """WITH r AS (SELECT o_orderstatus, o_orderkey % 5 = 0 AS c, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 6000 ELSE o_orderkey % 9000 END + 57344 AS x FROM orders), p AS (SELECT DISTINCT o_orderstatus, x FROM r WHERE NOT c AND x BETWEEN 57344 AND 63743),
f AS (SELECT o_orderstatus, min(x + 1) AS next_free FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.o_orderstatus = a.o_orderstatus AND b.x = a.x + 1) GROUP BY 1)
SELECT r.o_orderstatus, count(*) AS n, count(*) FILTER (c) AS combos, CAST(min(x) FILTER (NOT c AND x BETWEEN 57344 AND 63743) AS BIGINT) AS first, CAST(max(x) FILTER (NOT c AND x BETWEEN 57344 AND 63743) AS BIGINT) AS last, CAST(any_value(next_free) AS BIGINT) AS next_free FROM r LEFT JOIN f ON r.o_orderstatus = f.o_orderstatus GROUP BY r.o_orderstatus"""


def keyed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Keys in batches for requests: how many keys there are, and whether each is in one batch of at most 50."""
    b = records.in_batches(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")), "k")
    return b.select(F.explode("keys").alias("k"), F.size("keys").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("different"), (F.max("s") <= 50).alias("small"))


def resumed_keys(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k"))
    return tables.not_yet(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), done, "k")


def named_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files of a wiki, of a folder, or without either."""
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("File:"), "p_name", F.lit(" "), key, F.lit(".svg"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("GHS/"), key, F.lit(".png"))).otherwise(F.concat(F.lit("plain"), key))
    return tables.named_files(spark, table(spark, d, "part").select(name.alias("name")), "https://example.org/")


def path_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of paths in order of their parts."""
    p = catalog_queries.icon_paths(spark, d)
    return records.numbered(p, [F.split("path", "/"), F.col("page_id")], "position").select("page_id", "position")


def pair_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that a sheet shows: the first 24."""
    return feature_queries.QUERIES["closest_pairs_all"][0](spark, d).where("rank <= 24")


def files_below(spark: SparkSession, d: str) -> DataFrame:
    """Files of the categories below part 2, each once: a part's category is half its key, links also lead back, and every part is a file of two categories."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    up = F.expr("p_partkey div 2")
    rows = lambda a, kind, b: p.where("p_partkey > 1").select(a.alias("category"), F.lit(kind).alias("kind"), b.alias("title"))
    members = rows(up, "category", k).unionByName(rows(k, "category", F.greatest(up, F.lit(2)))).unionByName(rows(up, "file", k + 1000000)).unionByName(rows(k, "file", k + 1000000))
    return graph.files_below(members, spark.createDataFrame([(2,)], "node long"))


BELOW = """WITH RECURSIVE w AS (SELECT CAST(2 AS BIGINT) AS n UNION SELECT t FROM w JOIN (SELECT p_partkey // 2 AS c, p_partkey AS t FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, greatest(p_partkey // 2, 2) FROM part WHERE p_partkey > 1) e ON e.c = w.n)
SELECT DISTINCT p_partkey + 1000000 AS title FROM part WHERE p_partkey > 1 AND (p_partkey IN (SELECT n FROM w) OR p_partkey // 2 IN (SELECT n FROM w))"""


def layered(spark: SparkSession, d: str) -> DataFrame:
    """Parts as layered drawings with one fault each, by the key modulo 12."""
    n = F.col("p_partkey") % 12
    fault = lambda k, bad, good: F.when(n == k, bad).otherwise(good)
    stroke = F.when(n == 6, '"#ff0000"').when(n == 11, '"transparent"').when(n == 3, "'#00ff00'").when(n == 9, '"#000"').otherwise('"#000000"')
    pieces = [
        F.lit('<svg id="'), fault(1, "other", "emoji"), F.lit('" viewBox="0 0 72 72"><g id="grid"><path stroke="#b3b3b3" /></g>'), fault(2, "", '<g id="color"><path fill="#FCEA2B" stroke="#FFF" /></g>'), fault(3, '<g id="colour" />', ""),
        fault(4, "<path />", ""), fault(5, '<g id="skin"><path fill="#fcea2b" fill="none" /></g>', '<g id="skin"><path fill="#a57939" /></g>'), F.lit('<g id="line"><path stroke='), stroke, F.lit(' fill="'), fault(8, "", "none"), F.lit('" /></g>'), fault(7, '<g id="line" />', ""),
        fault(8, "<style />", ""), fault(9, "", "</svg>"),
    ]
    return table(spark, d, "part").select("p_partkey", n.alias("n"), F.concat(*pieces).alias("svg"))


def layer_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.layer_problems(layered(spark, d), "svg", "p_partkey").select("p_partkey", F.array_join(F.array_sort("problems"), ",").alias("problems"))


LAYER_SQL = """SELECT p_partkey, ['id', 'layer_color', 'unknown_layer', 'top_element', 'not_xml,repeated_attribute', '', 'layer_line', 'banned_element,top_element', 'not_xml'][p_partkey % 12] AS problems FROM part WHERE p_partkey % 12 IN (1, 2, 3, 4, 5, 7, 8, 9)"""


def palette_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.colour_problems(layered(spark, d), "svg", "p_partkey", ["#fcea2b", "#000000", "#A57939"]).select("p_partkey", F.array_join("colours", ",").alias("colours"))


def line_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.line_problems(layered(spark, d), "svg", "p_partkey").select("p_partkey", F.array_join("colours", ",").alias("colours"))


def skin_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = layered(spark, d).withColumns({"toned": F.col("n") != 11, "svg": F.when(F.col("n") == 10, F.replace("svg", F.lit('id="skin"'), F.lit('id="hair"'))).otherwise(F.col("svg"))})
    return quality.skin_problems(rows, "svg", "p_partkey", ("#fcea2b", "#5c9e31"), "toned")


def code_checks(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    rows = p.select("p_partkey", F.concat(F.when(k % 9 == 4, "42-").otherwise("0041-"), F.hex(k + 0x1F000)).alias("hexcode"), X.characters(F.concat(F.lit("41-"), F.hex(k + 0x1F000))).alias("emoji"))
    return quality.code_mismatches(rows).select("p_partkey", "hexcode")


def item_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items of a table: the number that was read, label and response are missing in turn."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 239 + 1).alias("item"), F.when(k % 3 == 0, F.array(F.lit("7"))).when(k % 3 == 1, F.array((k % 239 + 1).cast("string"), F.lit("12"))).alias("numbers"), F.when(k % 4 == 0, " ").otherwise("label").alias("label"), F.when(k % 5 != 0, "answer").alias("common_response"), (k % 100).cast("double").alias("confidence"))
    return ocr.item_reviews(rows, ["o_orderkey"])


ITEM_REVIEWS = """WITH r AS (SELECT o_orderkey, o_orderkey % 239 + 1 AS item, printf('%.2f', CAST(o_orderkey % 100 AS DOUBLE)) AS confidence FROM orders)
SELECT o_orderkey, 'appendix_item' AS field, CASE WHEN o_orderkey % 3 = 0 THEN '7' ELSE '' END AS value, confidence, 'item_number_not_confirmed' AS reason FROM r WHERE o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0 AND item <> 7)
UNION ALL SELECT o_orderkey, 'label', '', confidence, 'missing_label' FROM r WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'common_response', '', confidence, 'missing_common_response' FROM r WHERE o_orderkey % 5 = 0"""


def table_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entries of a table of 2,000: item numbers of which some repeat, are missing or unexpected, and a rating out of range in every 40th."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.when(k % 50 == 7, k + 1).otherwise(k).cast("string").alias("appendix_item"), *(F.when((F.lit(f) == "familiarity") & (k % 40 == 0), "5.01").otherwise("3.00").alias(f) for f in ocr.O.FIELDS))
    return ocr.violations(rows, n=2000)


VIOLATIONS = """WITH r AS (SELECT CAST(CASE WHEN c_custkey % 50 = 7 THEN c_custkey + 1 ELSE c_custkey END AS BIGINT) AS i, c_custkey % 40 = 0 AS bad FROM customer), w AS (SELECT CAST(range AS BIGINT) AS i FROM range(1, 2001))
SELECT 'missing_item' AS problem, i AS appendix_item FROM w WHERE i NOT IN (SELECT i FROM r) UNION ALL SELECT 'unexpected_item', i FROM r WHERE i NOT IN (SELECT i FROM w) UNION ALL SELECT 'repeated_item', i FROM r GROUP BY i HAVING count(*) > 1 UNION ALL SELECT 'familiarity:rating_out_of_range', i FROM r WHERE bad"""


def reading(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the words of an order's entry, in lines of ten points."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    names = ["Concreteness:", "12", "a1Semantic", "Complexity", "metric", "Complexity", "Name"]
    return li.select("l_orderkey", n.alias("place"), F.get(F.array(*(F.lit(x) for x in names)), (n - 1).cast("int")).alias("text"), (n * 40).alias("top"), (n * 40 + 30).alias("bottom"), F.lit(5).alias("left"), F.when(n == 5, 175.0).otherwise(n * 40.0 + 15).alias("cy"))


def label_texts(spark: SparkSession, d: str) -> DataFrame:
    return ocr.label_text(reading(spark, d), ["l_orderkey"])


def responses(spark: SparkSession, d: str) -> DataFrame:
    return ocr.response_text(reading(spark, d), ["l_orderkey"])


def field_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each field's printed name stands, and the box of its value beside it or, without the name, at the place of its line."""
    found = ocr.field_labels(reading(spark, d), ["l_orderkey"]).select("l_orderkey", "field", F.col("top").alias("t"), F.col("bottom").alias("b"))
    orders = table(spark, d, "lineitem").select("l_orderkey").distinct().withColumn("field", F.explode(F.array(F.lit("concreteness"), F.lit("complexity"), F.lit("complexity_metric"), F.lit("familiarity"), F.lit("name_agreement"))))
    box = ocr.value_box(F.col("t"), F.col("b"), F.lit(320), F.lit(42), F.lit(700), F.lit(800))
    return orders.join(found, ["l_orderkey", "field"], "left").select("l_orderkey", "field", F.col("t").isNotNull().alias("found"), *(box[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


# A name's top is 40 times its line. The word in line 5 lies beside line 4, which is no plain complexity then.
PLACES = """WITH o AS (SELECT l_orderkey, list(DISTINCT CAST(l_linenumber AS INT)) AS h FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, unnest([{'field': 'concreteness', 'k': CASE WHEN list_contains(h, 1) THEN 1 END}, {'field': 'complexity', 'k': CASE WHEN list_contains(h, 4) AND NOT list_contains(h, 5) THEN 4 WHEN list_contains(h, 6) THEN 6 END}, {'field': 'complexity_metric', 'k': CASE WHEN list_contains(h, 5) THEN 5 END},
 {'field': 'familiarity', 'k': NULL}, {'field': 'name_agreement', 'k': CASE WHEN list_contains(h, 7) THEN 7 END}]) AS x FROM o)
SELECT l_orderkey, x.field AS field, x.k IS NOT NULL AS found, CAST(700 AS BIGINT) AS x1, CAST(CASE WHEN x.k IS NOT NULL THEN x.k * 40 - 6 ELSE 362 END AS BIGINT) AS y1, CAST(800 AS BIGINT) AS x2, CAST(CASE WHEN x.k IS NOT NULL THEN x.k * 40 + 42 ELSE 406 END AS BIGINT) AS y2 FROM f"""


def best_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Of an order's words the readable number of the highest confidence."""
    li = table(spark, d, "lineitem")
    w = li.select("l_orderkey", F.col("l_linenumber").alias("place"), F.lit("familiarity").alias("field"), F.when(F.col("l_linenumber") % 2 == 0, F.concat((F.col("l_linenumber") % 5).cast("string"), F.lit(".5"))).otherwise("none").alias("text"), (F.col("l_quantity") % 10).cast("double").alias("confidence"))
    return ocr.best_number(w, ["l_orderkey", "field"])


BEST = """WITH w AS (SELECT l_orderkey, l_linenumber AS p, CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber % 5) || '.5' END AS t, CAST(l_quantity % 10 AS DOUBLE) AS c FROM lineitem), o AS (SELECT DISTINCT l_orderkey FROM w), b AS (SELECT * FROM w WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, p) = 1)
SELECT o.l_orderkey, 'familiarity' AS field, coalesce(t || '0', '') AS value, coalesce(c, 0.0) AS confidence, coalesce(t, '') AS raw FROM o LEFT JOIN b ON o.l_orderkey = b.l_orderkey"""

SYMBOLS = symbols.Symbols(
    chars={
        "person": {"w": 64, "h": 160, "d": [{"form": "line", "x1": 0, "y1": 0, "x2": 64, "y2": 160}]}, "house": {"w": 96, "h": 160, "d": "wall"}, "indicator_plural": {"w": 16, "d": []}, "indicator_action": {"w": 24, "d": []},
        "comma": {"w": 16, "h": 40, "d": []}, "question_mark": {"w": 32, "h": 160, "d": []}, "sun": {"w": 64, "h": 160, "d": [{"form": "circle", "x": 32, "y": 96, "r": 24}, {"form": "dot", "x": 32, "y": 96}, {"form": "disc", "x": 8, "y": 8, "r": 6.5}]},
        "river": {"w": 80, "h": 200, "d": [
            {"x": 4, "y": 8, "d": [{"form": "arc", "x1": 0, "y1": 64, "x2": 40, "y2": 64, "rx": 20, "ry": 10}, {"form": "bigarc", "x1": 0, "y1": 100, "x2": 30, "y2": 70, "rx": 15.5, "ry": 15.5}]},
            {"form": "quadratic", "x1": 0, "y1": 64, "qx": 20, "qy": 90, "x2": 40, "y2": 64}, {"form": "text", "x": 0, "y": 40, "w": 20, "h": 16, "fontsize": 16, "text": "<1>"},
        ]},
    },
    words={"people": ["person", "indicator_plural"], "home": ["people", "house"], "loop": ["person", "around"], "around": ["loop"], "deep": ["deep0"]} | {f"deep{i}": [f"deep{i + 1}"] for i in range(99)} | {"deep99": ["person"]},
    shapes={"wall": [{"form": "line", "x1": 0, "y1": 160, "x2": 96, "y2": 160}]},
)
SPELLED = (["house"], ["person", "indicator_plural"], ["people", "comma"], ["indicator_action", "people"], ["home", "indicator_action"], ["nowhere"], ["sun"], ["river", "indicator_plural"], ["loop"], ["deep"])


def spelled(spark: SparkSession, d: str) -> DataFrame:
    """Parts as words of one of ten spellings: one contains itself, one is a hundred words deep."""
    choice = F.get(F.array(*(F.array(*(F.lit(x) for x in s)) for s in SPELLED)), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("word"), choice.alias("parts"))


def word_expansion(spark: SparkSession, d: str) -> DataFrame:
    x = symbols.expanded(spelled(spark, d), SYMBOLS)
    return x.select("word", "pos", F.coalesce("error", F.concat_ws("+", "name", "indicators")).alias("name"))


LOOPS = "the word loop contains itself"
EXPANDED = f"""SELECT CAST(p_partkey AS VARCHAR) AS word, x.pos AS pos, x.name AS name FROM (SELECT p_partkey, unnest(CASE p_partkey % 10 WHEN 0 THEN [{{'pos': 0, 'name': 'house'}}] WHEN 1 THEN [{{'pos': 0, 'name': 'person+indicator_plural'}}] WHEN 2 THEN [{{'pos': 0, 'name': 'person+indicator_plural'}}, {{'pos': 1, 'name': 'comma'}}]
 WHEN 3 THEN [{{'pos': 0, 'name': 'indicator_action'}}, {{'pos': 1, 'name': 'person+indicator_plural'}}] WHEN 4 THEN [{{'pos': 0, 'name': 'person+indicator_action+indicator_plural'}}, {{'pos': 1, 'name': 'house'}}] WHEN 5 THEN [{{'pos': 0, 'name': 'question_mark'}}] WHEN 6 THEN [{{'pos': 0, 'name': 'sun'}}] WHEN 7 THEN [{{'pos': 0, 'name': 'river+indicator_plural'}}]
 WHEN 8 THEN [{{'pos': NULL, 'name': '{LOOPS}'}}] ELSE [{{'pos': 0, 'name': 'person'}}] END) AS x FROM part)"""


def word_layout(spark: SparkSession, d: str) -> DataFrame:
    return symbols.laid_out(spelled(spark, d), SYMBOLS)


# By hand: 32 between characters, 24 before a comma, nothing where no zone meets; indicators centred above theirs, 16 apart, raised where that is higher than 192.
PLACED = {
    0: [("house", 0, 0)], 1: [("person", 0, 0), ("indicator_plural", 24, 0)], 2: [("person", 0, 0), ("indicator_plural", 24, 0), ("comma", 88, 0)], 3: [("indicator_action", 0, 0), ("person", 56, 0), ("indicator_plural", 80, 0)],
    4: [("person", 0, 0), ("indicator_action", 4, 0), ("indicator_plural", 44, 0), ("house", 96, 0)], 5: [("question_mark", 0, 0)], 6: [("sun", 0, 0)], 7: [("river", 0, 0), ("indicator_plural", 32, 8)], 9: [("person", 0, 0)],
}
LAID_OUT = "WITH v(k, pos, name, x, y) AS (VALUES " + ", ".join(f"({k}, {i}, '{n}', {x}, {y})" for k, v in PLACED.items() for i, (n, x, y) in enumerate(v)) + f") SELECT CAST(p_partkey AS VARCHAR) AS word, CAST(pos AS INTEGER) AS pos, name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN p_partkey % 10 = 8 THEN '{LOOPS}' END AS error FROM part LEFT JOIN v ON v.k = p_partkey % 10"


def word_drawings(spark: SparkSession, d: str) -> DataFrame:
    return symbols.drawings(spelled(spark, d), SYMBOLS)


def _drawn(width: int, *body: tuple[int, int, int, int] | str) -> str:
    shown = "".join(x if isinstance(x, str) else '<line class="symbol-line" x1="{}" y1="{}" x2="{}" y2="{}"/>'.format(*x) for x in body)
    return f"'<svg xmlns=\"http://www.w3.org/2000/svg\" viewBox=\"-32 -32 {width + 64} 384\">{shown}</svg>'"


# By hand: heights count from 320 down, a group's offset is added, a text is centred on half its width and stands on its height.
SUN = ('<circle class="symbol-line" cx="32" cy="224" r="24"/>', '<circle class="symbol-dot" cx="32" cy="224" r="4"/>', '<circle class="symbol-disc" cx="8" cy="312" r="6.5"/>')
RIVER = (
    '<path class="symbol-line" d="M 4,248 A 20,10 0 0,0 44,248"/>', '<path class="symbol-line" d="M 4,212 A 15.5,15.5 0 1,0 34,242"/>', '<path class="symbol-line" d="M 0,256 Q 20,230 40,256"/>',
    '<text class="symbol-text" text-anchor="middle" x="10" y="296" style="font-size:16">&lt;1&gt;</text>',
)
BODIES = {
    0: _drawn(96, (0, 160, 96, 160)), 1: _drawn(64, (0, 320, 64, 160)), 2: _drawn(104, (0, 320, 64, 160)), 3: _drawn(120, (56, 320, 120, 160)), 4: _drawn(192, (0, 320, 64, 160), (96, 160, 192, 160)), 5: _drawn(32), 6: _drawn(64, *SUN),
    7: _drawn(80, *RIVER), 9: _drawn(64, (0, 320, 64, 160)),
}
DRAWN = "SELECT CAST(p_partkey AS VARCHAR) AS word, CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in BODIES.items()) + f" END AS svg, CASE WHEN p_partkey % 10 = 8 THEN '{LOOPS}' END AS error FROM part"


def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.lit(-20.0).alias("left"), (F.col("n_nationkey") * 30.0).alias("right"), F.lit(0.0).alias("top"), F.lit(320.0).alias("bottom"))
    return symbols.grid_lines(n, 4).select("n_nationkey", "kind", "x1", "y1", "x2", "y2")


GRID = """WITH b AS (SELECT n_nationkey, n_nationkey * 30.0::DOUBLE AS r, unnest(range(-1, CAST(ceil(greatest(n_nationkey * 30, 320) / 80.0) AS BIGINT) + 1)) AS i FROM nation), l AS (SELECT n_nationkey, r, i * 80.0::DOUBLE AS a, CASE WHEN i % 4 = 0 THEN 'major' ELSE 'minor' END AS kind FROM b)
SELECT n_nationkey, kind, a AS x1, 0.0::DOUBLE AS y1, a AS x2, 320.0::DOUBLE AS y2 FROM l WHERE a <= r UNION ALL SELECT n_nationkey, kind, -20.0::DOUBLE, a, r, a FROM l WHERE a <= 320"""

# Neither transparent nor an empty value is a colour of the palette or black; white and black in short form are, and single quotes hold values too.
COLOURS = "SELECT p_partkey, CASE p_partkey % 12 WHEN 3 THEN '#00ff00' WHEN 6 THEN '#ff0000' WHEN 8 THEN '' ELSE 'transparent' END AS colours FROM part WHERE p_partkey % 12 IN (3, 6, 8, 11)"

QUERIES = {
    "record_text": (record_text, TEXT),
    "emoji_published": (emoji_published, PUBLISHED),
    "emoji_missing": (emoji_missing, f"WITH {EMOJI_SQL} SELECT hexcode, sub AS subgroups FROM e WHERE author = '' AND skintone = '' AND grp <> ''"),
    "base_emoji": (base_emoji, "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey <> 3 AND c_custkey + 126976 NOT BETWEEN 127995 AND 127999"),
    "typed_export": (typed_export, f"WITH {EMOJI_SQL} SELECT hexcode, row_number() OVER (ORDER BY hexcode) AS \"order\", CAST(unicode AS DOUBLE) AS unicode, CASE WHEN skintone = '' THEN -1.0::DOUBLE ELSE 2.0::DOUBLE END AS skintone FROM e"),
    "record_files": (record_files, f"WITH {EMOJI_SQL} SELECT hexcode, 'root/color/svg/' || hexcode || '.svg' AS color, 'root/black/svg/' || hexcode || '.svg' AS black FROM e"),
    "code_summary": (code_summary, SUMMARY),
    "keyed_batches": (keyed_batches, "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS different, true AS small FROM orders"),
    "resumed_keys": (resumed_keys, "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)"),
    "named_files": (named_files, "SELECT CASE p_partkey % 3 WHEN 0 THEN 'File:' || p_name || ' ' || p_partkey || '.svg' WHEN 1 THEN 'GHS/' || p_partkey || '.png' ELSE 'plain' || p_partkey END AS name, 'https://example.org/' || CASE p_partkey % 3 WHEN 0 THEN 'File%3A' || replace(p_name, ' ', '%20') || '%20' || p_partkey || '.svg' WHEN 1 THEN 'GHS%2F' || p_partkey || '.png' ELSE 'plain' || p_partkey END AS url, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_partkey || '.svg' WHEN 1 THEN 'GHS_' || p_partkey || '.png' ELSE 'plain' || p_partkey END AS file FROM part"),
    "path_order": (path_order, f"WITH {catalog_queries.PATHS} SELECT page_id, row_number() OVER (ORDER BY string_split(path, '/'), page_id) AS position FROM q"),
    "pair_sheet": (pair_sheet, f"SELECT * FROM ({feature_queries.QUERIES['closest_pairs_all'][1]}) WHERE rank <= 24"),
    "files_below": (files_below, BELOW),
    "layer_checks": (layer_checks, LAYER_SQL),
    "palette_checks": (palette_checks, COLOURS),
    "line_checks": (line_checks, COLOURS),
    "skin_checks": (skin_checks, "SELECT p_partkey, CASE p_partkey % 12 WHEN 10 THEN 'no_skin_layer' ELSE 'untoned_colour' END AS problem FROM part WHERE p_partkey % 12 IN (5, 10)"),
    "code_checks": (code_checks, "SELECT p_partkey, '42-' || upper(to_hex(CAST(p_partkey + 126976 AS BIGINT))) AS hexcode FROM part WHERE p_partkey % 9 = 4"),
    "item_reviews": (item_reviews, ITEM_REVIEWS),
    "table_violations": (table_violations, VIOLATIONS),
    "label_texts": (label_texts, "SELECT l_orderkey, string_agg(CASE l_linenumber WHEN 3 THEN 'Semantic' WHEN 5 THEN 'metric' ELSE 'Name' END, ' ' ORDER BY l_linenumber) AS label FROM lineitem WHERE l_linenumber IN (3, 5, 7) GROUP BY l_orderkey"),
    "responses": (responses, "SELECT l_orderkey, string_agg(['Concreteness', '', 'a1Semantic', 'Complexity', 'metric', 'Complexity'][l_linenumber], ' ' ORDER BY l_linenumber) AS common_response FROM lineitem WHERE l_linenumber NOT IN (2, 7) GROUP BY l_orderkey"),
    "field_places": (field_places, PLACES),
    "best_numbers": (best_numbers, BEST),
    "word_expansion": (word_expansion, EXPANDED),
    "word_layout": (word_layout, LAID_OUT),
    "word_drawings": (word_drawings, DRAWN),
    "grid_rows": (grid_rows, GRID),
}
