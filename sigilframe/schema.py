"""Schemas of the tables that operators pass on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

FEATURES = ("foreground_area_ratio", "canny_edge_density", "connected_components", "quadtree_leaf_count", "quadtree_structural_variability", "quadtree_mean_leaf_size")
METADATA = ("icon_id", "set_id", "set_name", "label", "category", "normalized_path")
CATALOG = ("icon_id", "set_id", "set_name", "relative_path", "filename", "label", "category", "format", "source", "source_url", "normalized_path", "notes")


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


CATALOG_TYPE = strings(*CATALOG)
FEATURES_TYPE = StructType([*strings(*METADATA).fields, *(StructField(f, DoubleType()) for f in FEATURES)])
RATINGS = ("concreteness", "complexity", "familiarity", "meaningfulness", "semantic_distance", "complexity_metric", "concept_agreement", "name_agreement")
RATINGS_TYPE = strings("appendix_item", "label", *RATINGS, "common_response", "source_page", "ocr_confidence", "verified")
REVIEW_TYPE = strings("appendix_item", "source_page", "field", "value", "confidence", "reason")
WORDS_TYPE = StructType([StructField("text", StringType()), *(StructField(c, IntegerType()) for c in ("left", "top", "width", "height", "right", "bottom")), *(StructField(c, DoubleType()) for c in ("cx", "cy", "confidence"))])
PICTOGRAM_TYPE = StructType([
    StructField("_id", LongType()),
    StructField("keywords", ArrayType(strings("keyword"))),
    StructField("categories", ArrayType(StringType())),
    StructField("tags", ArrayType(StringType())),
])
EMOJI = ("emoji", "hexcode", "group", "subgroups", "annotation", "tags", "openmoji_tags", "openmoji_author", "openmoji_date", "skintone", "skintone_combination", "skintone_base_emoji", "skintone_base_hexcode", "unicode", "order")
EMOJI_TYPE = strings(*EMOJI)
