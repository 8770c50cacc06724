"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations alone.

Every version of a text is addressed by its SHA-256. The ledger holds, for each blob, the rules (with their versions) that
have scanned it and the spans found; a scan takes the distinct blobs of its input, leaves out the pairs of blob and
rule version that the ledger has, scans the rest, and appends them. Findings are then joined back to every path of a
blob. So a text is scanned once, however often it was committed, and a changed rule rescans blobs for that rule alone.
The ledger is a folder of Parquet files, to which each scan appends by one Spark write; a later session that names the folder goes on with it.

Spans come from built-in functions: splitting by the pattern gives the texts between matches, extraction gives the matches, and
their lengths add up to code-point positions, in steps of STEP matches so that many matches cost no more each. Both run only where a cheap test has
found the pattern. Copies of a blob are merged before the shuffle; findings are one row a blob, and only blobs with findings take part in the join back,
where Spark can split a hot blob's paths.

Nulls and odd rows: a null text counts as empty; an empty one has no spans; a null path or doc_id is carried; repeated rows
stay; columns besides the two named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, scratch, stored


@dataclass(frozen=True)
class Rule:
    """find: pattern of a match; least: the fewest characters of its group `group`; test: a pattern found in every text with a kept match."""

    name: str
    version: int
    find: str
    group: int
    least: int
    test: str

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# The patterns of the three base kinds, in their order. Runs shorter than the least are no matches of hex
# and access here, which is the same as dropping them: a run's matches never begin inside a failing one and pass.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", 1, ASSIGN, 2, 12, "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
)

SPAN = "array<struct<start:int,rule:int,end:int>>"
LEDGER = "blob string, rules array<string>, spans array<struct<start:int,rule:int,end:int>>"
STEP = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; a function of elements would work it out for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walked(items: Column, kind: str, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Rows (of array type `kind`) that a walk over items makes. step(at, out, x) gives the position after x and `out` with its rows, as a struct of at
    and out. Items are taken in blocks, whose rows are joined once, so the cost of an item doesn't grow with their number."""
    none, blocks = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def whole(items: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(items, i + 1, STEP), F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, x: step(a["at"], a["out"], x))
            return let(inner, lambda v: F.struct(v["at"].alias("at"), F.concat(acc["blocks"], F.array(v["out"])).alias("blocks")))

        starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(STEP))
        return F.when(F.size(items) > 0, F.aggregate(starts, F.struct(F.lit(0).alias("at"), blocks.alias("blocks")), block, lambda acc: F.flatten(acc["blocks"]))).otherwise(none)

    return let(items, whole)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Kept matches of a rule as array<struct<start, rule, end>>; end is exclusive, positions are code points."""
    between = F.split(text, rule.find, -1).alias("between")
    found = F.regexp_extract_all(text, F.lit(rule.find), F.lit(0)).alias("found")
    sized = F.regexp_extract_all(text, F.lit(rule.find), F.lit(rule.group)).alias("sized")
    both = F.filter(F.arrays_zip(between, found, sized), lambda x: x["found"].isNotNull())  # the text behind the last match has none
    steps = F.transform(both, lambda x: F.struct(F.length(x["between"]).alias("skip"), F.length(x["found"]).alias("n"), (F.length(x["sized"]) >= rule.least).alias("keep")))

    def step(at: Column, out: Column, x: Column) -> Column:
        a = at + x["skip"]
        new = F.array(F.struct(a.alias("start"), F.lit(number).alias("rule"), (a + x["n"]).alias("end")))
        return F.struct((a + x["n"]).alias("at"), F.when(x["keep"], F.concat(out, new)).otherwise(out).alias("out"))

    return F.when(text.rlike(rule.test), walked(steps, SPAN, step)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """blob, rules, spans; a row for each blob and scan. Empty where nothing was scanned yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def scan(versions: DataFrame, path: str = "path", text: str = "text", rules: Sequence[Rule] = RULES, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger (a folder; without one, a new one) has not seen, and adds it there. Returns the whole ledger and the findings of every
    path (path, blob, spans in order of start and rule)."""
    spark = versions.sparkSession
    folder = ledger or scratch(spark, "ledger")
    known = read_ledger(spark, folder)
    keyed = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    blobs = keyed.groupBy("blob").agg(F.first("text").alias("text"))
    tags = F.array(*(F.lit(r.tag) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("new", tags)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most a row for each rule version
        todo = blobs.join(seen, "blob", "left").withColumn("new", F.array_except(tags, F.coalesce("seen", F.expr("cast(array() as array<string>)")))).where(F.size("new") > 0)
    none = F.expr(f"cast(array() as {SPAN})")
    spans = [F.when(F.array_contains("new", r.tag), spans_of(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    scanned = todo.select("blob", F.col("new").alias("rules"), F.array_sort(F.concat(*spans)).alias("spans"))
    scanned.write.mode("append").parquet(folder)
    whole = read_ledger(spark, folder)
    return whole, findings(keyed.select("path", "blob"), whole, rules)


def by_blob(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, spans: what these rule versions have found; a ledger may hold other versions' spans too. Only blobs with findings."""
    tags = F.array(*(F.lit(r.tag) for r in rules))
    current = F.filter("spans", lambda s: F.array_contains("rules", F.get(tags, s["rule"])))
    found = ledger.withColumn("spans", current).where(F.size("spans") > 0)
    # One row a blob and scan. Stored, so that Spark knows its size, and can split a hot blob's paths where they are too many for one task.
    return stored(found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "found")


def findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Joins what the ledger found to every path of its blob."""
    return paths.join(by_blob(ledger, rules), "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def spelled(spans: str = "spans", rules: Sequence[Rule] = RULES) -> Column:
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    _, found = scan(docs, "doc_id", "text", ledger=ledger)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(), 256).alias("base_sha256"), spelled().alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or joint run of overlapping spans, replaced."""
    pieces = "array<struct<at:int,n:int>>"

    def step(at: Column, out: Column, s: Column) -> Column:
        new = F.array(F.struct(at.alias("at"), (s["start"] - at).alias("n")))
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] < at, out).otherwise(F.concat(out, new)).alias("out"))

    kept = F.transform(walked(spans, pieces, step), lambda p: F.substring(text, p["at"] + 1, p["n"]))
    return F.concat(F.array_join(F.concat(kept, F.array(F.lit(""))), mask), F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """A pipeline stage: every document stays, its secrets masked; n_chars follows the new text."""
    whole, _ = scan(docs, "doc_id", "text", ledger=ledger)
    blob, spans = fresh(docs, "_blob", "_spans")
    found = by_blob(whole, RULES).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    masked = docs.withColumn(blob, F.sha2("text", 256)).join(found, blob, "left")
    n = "n_chars" if "n_chars" in docs.columns else None
    out = masked.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans))))
    if n:
        out = out.withColumn(n, F.when(F.col(spans).isNull(), F.col(n)).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


# The same matches in DuckDB's dialect: texts between matches and matches give the positions.
def _oracle() -> str:
    def sql(pattern: str) -> str:
        return "'" + pattern.replace("'", "''").replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]") + "'"

    parts = []
    for k, r in enumerate(RULES):
        split = r.find.replace("((?i:", "(?i:").replace("))[", ")[").replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")
        split = split.replace("(?i:password|passwd|secret|token|api_?key)", "(?:(?i:password|passwd|secret|token|api_?key))")
        parts.append(f"SELECT doc_id, {k} AS k, string_split_regex(t, {sql(split)}) AS b, regexp_extract_all(t, {sql(r.find)}, 0) AS m, list_transform(regexp_extract_all(t, {sql(r.find)}, {r.group}), lambda x: length(x) >= {r.least}) AS ok FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(parts)}),
y AS (SELECT doc_id, k, b, m, ok, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (SELECT doc_id, k, list_sum(list_transform(b[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS s, length(m[i]) AS n FROM y WHERE ok[i]),
s AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
 string_agg(CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


ORACLE = _oracle()
