"""Queries over feature tables and rasters. The embeddings table stands in for features (its first six components) and for rasters of 8 by 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.operators import raster as ras
from sigilframe.operators import sampling, similarity, stats
from sigilframe.schema import FEATURES

SIX = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES))
VIEW = f"f AS (SELECT CAST(vec_id AS BIGINT) AS idx, 'set_' || label AS set_id, 'Set ' || label AS set_name, {SIX} FROM embeddings)"
Z = "z AS (SELECT idx, set_id, " + ", ".join(f"(f.{x} - m.a{i}) / (CASE WHEN m.s{i} = 0 THEN 1 ELSE m.s{i} END) AS z{i}" for i, x in enumerate(FEATURES)) + " FROM f, (SELECT " + ", ".join(f"avg({x}) AS a{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(FEATURES)) + " FROM f) m)"
SQUARES = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(6))
DOT = lambda x, y: " + ".join(f"{x}.z{i} * {y}.z{i}" for i in range(6))
EUCLID = f"sqrt({SQUARES})"
COSINE = f"least(2, greatest(0, 1 - ({DOT('a', 'b')}) / (sqrt({DOT('a', 'a')}) * sqrt({DOT('b', 'b')}))))"


def features(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    label = F.col("label").cast("string")
    return e.select(F.col("vec_id").cast("long").alias("idx"), F.concat(F.lit("set_"), label).alias("set_id"), F.concat(F.lit("Set "), label).alias("set_name"), *(F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def rounded_many(df: DataFrame, column: str) -> DataFrame:
    """As `rounded` does, to the bit, for many rows: `round` goes by decimal text, which is wanted only near a tie or for large numbers; elsewhere the next whole number of millionths is certain."""
    x = F.col(column)
    up = x * 1e6 + 0.5
    sure = (F.abs(x) < 1e5) & (F.abs(up - F.floor(up) - 0.5) < 0.499)
    return df.withColumn(column, F.when(sure, F.floor(up) / 1e6).otherwise(F.round(x, 6)))


def feature_summary_by_set(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(features(spark, d))


def _summary_sql() -> str:
    cols = []
    for f in FEATURES:
        cols += [f"count({f}) AS {f}_count", *(f"round_even({fn}({f}), 6) AS {f}_{n}" for n, fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))]
    return f"WITH {VIEW} SELECT set_id, set_name, {', '.join(cols)} FROM f GROUP BY set_id, set_name"


def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    z = stats.standardized(features(spark, d))
    return z.select("idx", *(F.round(f"z_{f}", 6).alias(f"z{i}") for i, f in enumerate(FEATURES)))


def _knn(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        z, cols = similarity.z_columns(features(spark, d))
        return rounded(similarity.neighbours(z, cols, "idx", 5, metric), "distance").withColumn("rank", F.col("rank").cast("long"))

    return query


def _knn_sql(distance: str) -> str:
    return f"WITH {VIEW}, {Z}, p AS (SELECT a.idx AS source, b.idx AS target, {distance} AS d FROM z a, z b WHERE a.idx <> b.idx), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d, target) AS rank FROM p) SELECT source, rank, target, round(d, 6) AS distance FROM r WHERE rank <= 5"


def described_neighbours(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    z, cols = similarity.z_columns(f)
    near = similarity.neighbours(z, cols, "idx", 5)
    out = similarity.described_pairs(near, f.withColumn("key", F.col("idx")), "idx", ("key", "set_id", "set_name"))
    return rounded(out, "distance").withColumn("rank", F.col("rank").cast("long"))


DESCRIBED = f"WITH {VIEW}, {Z}, p AS (SELECT a.idx AS s, b.idx AS t, {EUCLID} AS d FROM z a, z b WHERE a.idx <> b.idx), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, t) AS rank FROM p) SELECT rank, round(d, 6) AS distance, x.idx AS source_key, x.set_id AS source_set_id, x.set_name AS source_set_name, y.idx AS target_key, y.set_id AS target_set_id, y.set_name AS target_set_name FROM r JOIN f x ON x.idx = s JOIN f y ON y.idx = t WHERE rank <= 5"


def _closest(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        z, cols = similarity.z_columns(features(spark, d))
        return rounded(similarity.closest_pairs(z, cols, "idx", "set_id", 100, mode), "distance").withColumn("rank", F.col("rank").cast("long"))

    return query


def _closest_sql(condition: str) -> str:
    return f"WITH {VIEW}, {Z}, p AS (SELECT a.idx AS a, b.idx AS b, {EUCLID} AS d FROM z a, z b WHERE a.idx < b.idx {condition}), r AS (SELECT *, row_number() OVER (ORDER BY d, a, b) AS rank FROM p ORDER BY d, a, b LIMIT 100) SELECT rank, a, b, round(d, 6) AS distance FROM r"


def distance_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    z, cols = similarity.z_columns(features(spark, d))
    return rounded_many(similarity.distance_matrix(z, cols, "idx"), "distance")


MATRIX = f"WITH {VIEW}, {Z} SELECT a.idx AS source, b.idx AS target, round(CASE WHEN a.idx = b.idx THEN 0 ELSE {EUCLID} END, 6) AS distance FROM z a, z b"


def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.spearman(features(spark, d), "idx"), "rho")


def _spearman_sql() -> str:
    r = ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS r{i}" for i, f in enumerate(FEATURES))
    return f"WITH {VIEW}, r AS (SELECT {r} FROM f) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(r{i}, r{j}), 6) AS rho FROM r" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES))


def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.box_stats(features(spark, d)), "q1", "median", "q3", "low", "high")


def _box_sql() -> str:
    long = " UNION ALL ".join(f"SELECT set_id, '{f}' AS feature, {f} AS v FROM f" for f in FEATURES)
    return f"""WITH {VIEW}, l AS ({long}), q AS (SELECT feature, set_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
SELECT q.feature, q.set_id, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v), 6) AS low, round(max(v), 6) AS high
FROM q JOIN l ON q.feature = l.feature AND q.set_id = l.set_id AND v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY q.feature, q.set_id, q1, median, q3"""


def feature_extremes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.extremes(features(spark, d), FEATURES, "idx"), "value").withColumn("place", F.col("place").cast("long"))


def _extremes_sql() -> str:
    parts = []
    for f in FEATURES:
        for side, order in (("low", f), ("high", f"{f} DESC")):
            parts.append(f"SELECT * FROM (SELECT '{f}' AS feature, '{side}' AS side, row_number() OVER (ORDER BY {order}, idx) AS place, idx, round({f}, 6) AS value FROM f ORDER BY {order}, idx LIMIT 12)")
    return f"WITH {VIEW} " + " UNION ALL ".join(parts)


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.principal_components(features(spark, d), "idx"), "pc1", "pc2", "share1", "share2")


def raster_rows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return ras.vector_bytes(e.select(F.col("vec_id").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("v")), "idx", "v")


def _raster(extractor: str, times: int = 1, level: float = 0.0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        chosen = tuple(e for e in ras.EXTRACTORS if e.name == extractor)
        return ras.split_failures(ras.extract(raster_rows(spark, d), "idx", extractors=chosen, decode=ras.of_vector("v", 8, times, level)), "idx")[0]

    return run


def raster_foreground_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_raster("foreground_area_ratio")(spark, d), "foreground_area_ratio")


def raster_components8(spark: SparkSession, d: str) -> DataFrame:
    return _raster("connected_components")(spark, d).select("idx", F.col("connected_components").cast("long").alias("components"))


def raster_component_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = ras.boxes(raster_rows(spark, d), "idx", decode=ras.of_vector("v"))
    return b.select("idx", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2", "area")))


def raster_quadtree(spark: SparkSession, d: str) -> DataFrame:
    q = _raster("quadtree", 4, 0.15)(spark, d)
    return rounded(q.select("idx", F.col("quadtree_leaf_count").cast("long").alias("leaves"), F.col("quadtree_structural_variability").alias("variability"), F.col("quadtree_mean_leaf_size").alias("mean_size")), "variability", "mean_size")


def raster_edge_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_raster("canny_edge_density")(spark, d), "canny_edge_density")


PIXELS = "px AS (SELECT CAST(vec_id AS BIGINT) AS idx, i - 1 AS p, (i - 1) % 8 AS x, (i - 1) // 8 AS y FROM embeddings, range(1, 65) t(i) WHERE CAST(embedding[i] AS DOUBLE) > 0)"


def _labels(near: str) -> str:
    # The smallest pixel that each pixel reaches: longest ways among 64 pixels end the recursion.
    return f"""WITH RECURSIVE {PIXELS}, e AS (SELECT a.idx, a.p AS s, b.p AS t FROM px a JOIN px b ON a.idx = b.idx AND {near}),
w AS (SELECT idx, p AS s, p AS t FROM px UNION SELECT w.idx, w.s, e.t FROM w JOIN e ON e.idx = w.idx AND e.s = w.t AND e.t <> w.s),
l AS (SELECT idx, s AS p, min(t) AS root FROM w GROUP BY idx, s)"""


COMPONENTS8 = _labels("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1") + " SELECT CAST(v.vec_id AS BIGINT) AS idx, count(DISTINCT root) AS components FROM embeddings v LEFT JOIN l ON l.idx = v.vec_id GROUP BY v.vec_id"
BOXES4 = _labels("abs(a.x - b.x) + abs(a.y - b.y) <= 1") + " SELECT l.idx, CAST(min(x) AS BIGINT) AS x1, CAST(min(y) AS BIGINT) AS y1, CAST(max(x) + 1 AS BIGINT) AS x2, CAST(max(y) + 1 AS BIGINT) AS y2, count(*) AS area FROM l JOIN px ON px.idx = l.idx AND px.p = l.p GROUP BY l.idx, root"
# Squares of 32, 16 and 8 split while their variance is above the limit; squares of 4 are pixels of the vector.
QUADTREE = """WITH c AS (SELECT CAST(vec_id AS BIGINT) AS idx, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CASE WHEN CAST(embedding[i] AS DOUBLE) > 0.15 THEN 1.0 ELSE 0.0 END AS on_ FROM embeddings, range(1, 65) t(i)),
l0 AS (SELECT idx, avg(on_) * (1 - avg(on_)) > 0.02 AS s FROM c GROUP BY idx),
l1 AS (SELECT idx, x // 4 AS x, y // 4 AS y, avg(on_) * (1 - avg(on_)) > 0.02 AS s FROM c GROUP BY ALL),
l2 AS (SELECT idx, x // 2 AS x, y // 2 AS y, avg(on_) * (1 - avg(on_)) > 0.02 AS s FROM c GROUP BY ALL),
n2 AS (SELECT idx, x // 2 AS x, y // 2 AS y, sum(CASE WHEN s THEN 4 ELSE 1 END) AS n FROM l2 GROUP BY ALL),
n1 AS (SELECT l1.idx, sum(CASE WHEN s THEN n ELSE 1 END) AS n FROM l1 JOIN n2 ON l1.idx = n2.idx AND l1.x = n2.x AND l1.y = n2.y GROUP BY l1.idx)
SELECT l0.idx, CAST(CASE WHEN s THEN n ELSE 1 END AS BIGINT) AS leaves, round((CASE WHEN s THEN n ELSE 1 END) / 64.0, 6) AS variability, round(1024.0 / (CASE WHEN s THEN n ELSE 1 END), 6) AS mean_size FROM l0 JOIN n1 ON l0.idx = n1.idx"""

ON_EDGE = "n.x = least(7, greatest(0, a.x + k.dx)) AND n.y = least(7, greatest(0, a.y + k.dy))"


def _weighted(source: str, value: str, weights: list[tuple[int, int, float]]) -> str:
    return f"SELECT a.idx, a.x, a.y, sum(k.w * n.{value}) AS v FROM {source} a CROSS JOIN (VALUES {', '.join(map(str, weights))}) k(dy, dx, w) JOIN {source} n ON n.idx = a.idx AND {ON_EDGE} GROUP BY ALL"


# Blur, gradient, ridges, thresholds and growth over 8 x 8 pixels; a pixel beyond the border has no gradient.
EDGES = f"""WITH RECURSIVE g AS (SELECT CAST(vec_id AS BIGINT) AS idx, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CASE WHEN CAST(embedding[i] AS DOUBLE) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM embeddings, range(1, 65) t(i)),
h AS ({_weighted('g', 'v', [(0, d, w / 16) for d, w in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)])}), s AS ({_weighted('h', 'v', [(d, 0, w / 16) for d, w in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)])}),
gx AS ({_weighted('s', 'v', [(y, x, float(x * (2 - abs(y)))) for y in (-1, 0, 1) for x in (-1, 1)])}), gy AS ({_weighted('s', 'v', [(y, x, float(y * (2 - abs(x)))) for y in (-1, 1) for x in (-1, 0, 1)])}),
m AS (SELECT gx.idx, gx.x, gx.y, sqrt(gx.v * gx.v + gy.v * gy.v) AS size, CAST(floor((CASE WHEN degrees(atan2(gy.v, gx.v)) < 0 THEN degrees(atan2(gy.v, gx.v)) + 180 ELSE degrees(atan2(gy.v, gx.v)) END + 22.5) / 45) AS INT) % 4 AS turn FROM gx JOIN gy ON gx.idx = gy.idx AND gx.x = gy.x AND gx.y = gy.y),
r AS (SELECT m.idx, m.x, m.y, m.size FROM m LEFT JOIN m a ON a.idx = m.idx AND a.y = m.y + [0, 1, 1, 1][m.turn + 1] AND a.x = m.x + [1, 1, 0, -1][m.turn + 1] LEFT JOIN m b ON b.idx = m.idx AND b.y = m.y - [0, 1, 1, 1][m.turn + 1] AND b.x = m.x - [1, 1, 0, -1][m.turn + 1]
 WHERE m.size > 0 AND m.size >= coalesce(a.size, 0) AND m.size >= coalesce(b.size, 0)),
t AS (SELECT idx, greatest(quantile_cont(size, 0.85), 0.08) AS high FROM r GROUP BY idx), c AS (SELECT r.idx, r.x, r.y, r.size >= t.high AS strong FROM r JOIN t ON r.idx = t.idx WHERE r.size >= 0.4 * t.high),
e AS (SELECT idx, x, y FROM c WHERE strong UNION SELECT c.idx, c.x, c.y FROM e JOIN c ON c.idx = e.idx AND abs(c.x - e.x) <= 1 AND abs(c.y - e.y) <= 1),
k AS (SELECT e.idx, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.idx = e.idx AND g.v = 0 AND abs(g.x - e.x) <= 1 AND abs(g.y - e.y) <= 1) GROUP BY e.idx)
SELECT CAST(vec_id AS BIGINT) AS idx, round(coalesce(n, 0) / 64.0::DOUBLE, 6) AS canny_edge_density FROM embeddings LEFT JOIN k ON k.idx = vec_id"""

QUERIES = {
    "feature_summary_by_set": (feature_summary_by_set, _summary_sql()),
    "zscore_features": (zscore_features, f"WITH {VIEW}, {Z} SELECT idx, " + ", ".join(f"round(z{i}, 6) AS z{i}" for i in range(6)) + " FROM z"),
    "knn_euclidean": (_knn("euclidean"), _knn_sql(EUCLID)),
    "knn_cosine": (_knn("cosine"), _knn_sql(COSINE)),
    "described_neighbours": (described_neighbours, DESCRIBED),
    "closest_pairs_all": (_closest("all"), _closest_sql("")),
    "closest_pairs_cross_set": (_closest("cross"), _closest_sql("AND a.set_id <> b.set_id")),
    "closest_pairs_same_set": (_closest("same"), _closest_sql("AND a.set_id = b.set_id")),
    "distance_matrix_long": (distance_matrix_long, MATRIX),
    "spearman_matrix": (spearman_matrix, _spearman_sql()),
    "boxplot_stats": (boxplot_stats, _box_sql()),
    "feature_extremes": (feature_extremes, _extremes_sql()),
    "pca_scores": (pca_scores, None),
    "raster_foreground_ratio": (raster_foreground_ratio, "SELECT CAST(vec_id AS BIGINT) AS idx, round(list_sum(list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > 0 THEN 1.0 ELSE 0.0 END)) / 64.0, 6) AS foreground_area_ratio FROM embeddings"),
    "raster_components8": (raster_components8, COMPONENTS8),
    "raster_component_boxes": (raster_component_boxes, BOXES4),
    "raster_quadtree": (raster_quadtree, QUADTREE),
    "raster_edge_density": (raster_edge_density, EDGES),
}
