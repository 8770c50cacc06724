"""The catalog: which files are icons, what they are called, and where their metadata comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.functions import text as X
from sigilframe.schema import CATALOG

# The icon sets (id, name, source, address).
SETS = (
    ("01_mcdougall_symbol_icon_set", "McDougall Symbol/Icon Set", "McDougall et al. BURO eprint", "https://eprints.bournemouth.ac.uk/10165/"),
    ("02_aiga_dot_symbol_signs", "AIGA/DOT Symbol Signs", "AIGA/Wikimedia Commons", "https://www.aiga.org/resources/symbol-signs"),
    ("03_mapbox_maki_icons", "Mapbox Maki", "Mapbox Maki GitHub", "https://github.com/mapbox/maki"),
    ("04_ocha_humanitarian_icons", "OCHA Humanitarian Icons", "MapAction OCHA humanitarian icons for GIS", "https://github.com/mapaction/ocha-humanitarian-icons-for-gis"),
    ("05_mulberry_symbols", "Mulberry Symbols", "Mulberry Symbols GitHub", "https://github.com/mulberrysymbols/mulberry-symbols"),
    ("06_blissymbolics", "Blissymbolics", "Blissymbolics GitHub", "https://github.com/blissymbolics/blissymbols"),
    ("07_arasaac_pictograms", "ARASAAC Pictograms", "ARASAAC API/static pictograms", "https://arasaac.org"),
    ("08_ghs_hazard_pictograms", "GHS Hazard Pictograms", "OSHA Hazard Communication Pictograms", "https://www.osha.gov/hazcom/pictograms"),
    ("09_universal_symbols_healthcare_webfont", "Universal Symbols Healthcare Webfont", "webfont-medical-icons GitHub", "https://github.com/samcome/webfont-medical-icons"),
    ("10_openmoji", "OpenMoji", "OpenMoji GitHub", "https://github.com/hfg-gmuend/openmoji"),
    ("11_iso_7010_safety_signs", "ISO 7010 Safety Signs", "ISO7010-Font GitHub", "https://github.com/Adewra/ISO7010-Font"),
    ("12_iso_15223_medical_device_symbols", "ISO 15223 Medical Device Symbols", "medical-device-symbols GitHub", "https://github.com/t4dhg/medical-device-symbols"),
    ("13_usp_pictograms_manual", "USP Pictograms", "USP Pictograms", "https://www.usp.org/health-quality-safety/usp-pictograms"),
)
EXTENSIONS = (".svg", ".png", ".gif", ".jpg", ".jpeg")
# Where a set keeps its icons (id, path prefixes within the set, suffix). Set 11 goes by a folder anywhere instead.
PLACES = (
    ("01_mcdougall_symbol_icon_set", ("extracted_icons_png/",), ".png"),
    ("02_aiga_dot_symbol_signs", ("png_512/",), ".png"),
    ("03_mapbox_maki_icons", ("icons/",), ".svg"),
    ("04_ocha_humanitarian_icons", ("humanitarian-icons-v2-1-svg/",), ".svg"),
    ("05_mulberry_symbols", ("EN/",), ".svg"),
    ("06_blissymbolics", ("rendered_svg/chars/", "rendered_svg/words/"), ".svg"),
    ("07_arasaac_pictograms", ("png_300/",), ".png"),
    ("08_ghs_hazard_pictograms", ("png_osha/",), ".png"),
    ("09_universal_symbols_healthcare_webfont", ("packages/svg/",), ".svg"),
    ("10_openmoji", ("color/svg/",), ".svg"),
    ("12_iso_15223_medical_device_symbols", ("src/icons/",), ".svg"),
    ("13_usp_pictograms_manual", ("gif/pictogif/",), ".gif"),
)
# Categories that depend on the set alone.
SET_CATEGORIES = {
    "03_mapbox_maki_icons": "cartography / point of interest",
    "08_ghs_hazard_pictograms": "chemical hazard",
    "09_universal_symbols_healthcare_webfont": "healthcare wayfinding",
    "12_iso_15223_medical_device_symbols": "medical device label",
    "13_usp_pictograms_manual": "medication instruction",
}


def icon_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SETS), "set_id string, set_name string, source string, source_url string")


def is_canonical(set_id: Column, inner: Column, stem: Column | None = None, suffix: Column | None = None) -> Column:
    """Whether a path within its set is one of the set's icons; false for unknown sets. stem, suffix: the file name's, where they are columns already."""
    name = X.base_name(inner)
    stem, suffix = X.stem(name) if stem is None else stem, X.suffix(name) if suffix is None else suffix
    rule = F.when(F.lit(False), F.lit(False))
    for set_name, prefixes, wanted in PLACES:
        at = F.lit(False)
        for p in prefixes:
            at = at | inner.startswith(p)
        rule = rule.when(set_id == set_name, at & (suffix == wanted))
    rule = rule.when(set_id == "11_iso_7010_safety_signs", inner.contains("Warning Symbols/") & (suffix == ".svg") & ~stem.contains("_Original"))
    return rule.otherwise(False)


def infer_category(set_id: Column, path: Column, fixed: bool = False, by_set: dict[str, str] | None = None) -> Column:
    """The category that a path tells. By default the folder of sets 04, 05 and 11 is counted from the top of the workspace, so it is the
    folder of all sets; `fixed` counts within the set."""
    parts = F.split(path, "/")
    folder = F.get(parts, F.lit(3 if fixed else 1))
    known = F.when(F.lit(False), F.lit(""))
    for s, c in (SET_CATEGORIES if by_set is None else by_set).items():
        known = known.when(set_id == s, c)
    return (
        known.when(set_id == "04_ocha_humanitarian_icons", F.coalesce(F.regexp_replace(folder, "^humanitarian-icons-v2-1-", ""), F.lit("")))
        .when(set_id == "05_mulberry_symbols", F.coalesce(folder, F.lit("AAC")))
        .when(set_id == "06_blissymbolics", F.when(F.size(parts) > 4, F.concat(F.lit("Blissymbolics "), F.regexp_replace(F.get(parts, F.lit(4)), "s$", ""))).otherwise("Blissymbolics"))
        .when(set_id == "11_iso_7010_safety_signs", F.coalesce(folder, F.lit("safety sign")))
        .otherwise("")
    )


def _rules(spark: SparkSession) -> DataFrame:
    """A row for each set: where its icons lie, with which suffix, and its category where one is fixed. As a table they are joined; as conditions they made the generated code too large."""
    places = {name: (list(prefixes), wanted) for name, prefixes, wanted in PLACES}
    rows = [(s, *places.get(s, ([], None)), SET_CATEGORIES.get(s)) for s, *_ in SETS]
    return spark.createDataFrame(rows, "set_id string, _places array<string>, _wanted string, _category string")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order, as when a dictionary is filled."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def build_catalog(files: DataFrame, pictograms: DataFrame, emoji: DataFrame, ratings: DataFrame, fixed_categories: bool = False) -> DataFrame:
    """Catalog rows of files (path from the workspace's top). pictograms, emoji, ratings: key, label, category, notes, one row a
    key. Metadata that is missing or empty gives way to what the path tells."""
    f = files.select("path", F.split("path", "/").alias("parts")).where(F.size("parts") >= 3)
    f = f.withColumns({"name": F.element_at("parts", -1), "set_id": F.get("parts", F.lit(2)), "inner": F.regexp_replace("path", "^([^/]*/){3}", "")})
    f = f.withColumns({"stem": X.stem("name"), "suffix": X.suffix("name")}).where(F.col("suffix").isin(*EXTENSIONS))
    spark = files.sparkSession
    f = f.join(F.broadcast(icon_sets(spark).join(_rules(spark), "set_id")), "set_id")  # thirteen rows
    placed = (F.col("suffix") == F.col("_wanted")) & F.exists("_places", lambda p: F.col("inner").startswith(p))
    signs = (F.col("set_id") == "11_iso_7010_safety_signs") & F.col("inner").contains("Warning Symbols/") & (F.col("suffix") == ".svg") & ~F.col("stem").contains("_Original")
    f = f.where(F.coalesce(placed, F.lit(False)) | signs)
    item, sid, stem = F.regexp_extract("stem", r"mcdougall_(\d+)", 1), F.col("set_id"), F.col("stem")
    bliss, rated = sid == "06_blissymbolics", sid == "01_mcdougall_symbol_icon_set"
    f = f.withColumns({"number": F.when(rated & (item != ""), item.cast("bigint").cast("string")), "slug": X.slug_label(F.col("name")), "sha": F.sha1(F.col("path").cast("binary"))})
    f = f.withColumn("key", F.when(sid.isin("07_arasaac_pictograms", "10_openmoji"), stem).when(rated, F.col("number")))
    metadata = None
    for set_name, rows in (("07_arasaac_pictograms", pictograms), ("10_openmoji", emoji), ("01_mcdougall_symbol_icon_set", ratings)):
        one = rows.select(F.lit(set_name).alias("set_id"), "key", F.col("label").alias("m_label"), F.col("category").alias("m_category"), F.col("notes").alias("m_notes"))
        metadata = one if metadata is None else metadata.unionByName(one)
    f = f.join(metadata, ["set_id", "key"], "left")
    numbered = F.col("number").isNotNull()
    own = F.when(bliss, X.slug_label(F.regexp_replace(stem, "__[0-9a-f]{12}$", ""))).when(numbered, F.concat(F.lit("McDougall item "), "number")).otherwise(F.col("slug"))
    own_notes = F.when(bliss, F.concat(F.lit("bliss_kind="), F.when(F.get("parts", F.lit(4)) == "chars", "char").otherwise("word"))).when(numbered, F.concat(F.lit("appendix_item="), "number")).otherwise("")
    f = f.withColumns({"own": own, "own_notes": own_notes, "own_category": F.coalesce("_category", infer_category(sid, F.col("path"), fixed_categories, {}))})
    return f.select(
        F.substring("sha", 1, 16).alias("icon_id"), "set_id", "set_name", F.col("path").alias("relative_path"), F.col("name").alias("filename"), X.or_else(F.col("m_label"), F.col("own")).alias("label"),
        X.or_else(F.col("m_category"), F.col("own_category")).alias("category"), F.substring("suffix", 2, 10).alias("format"), "source", "source_url",
        X.normalized_name(F.col("slug"), F.col("sha"), sid).alias("normalized_path"), F.coalesce("m_notes", "own_notes").alias("notes"),
    ).select(*CATALOG)


def in_path_order(rows: DataFrame, path: str = "relative_path") -> DataFrame:
    """Sorts paths part by part, so a folder's files stand together."""
    return rows.orderBy(F.split(path, "/"))
