"""Queries of the analyses that build on features: clusters, bins, samples and agreement of labels, over the supplied tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilframe.operators import bins, clusters, sampling, shapes, similarity
from sigilframe.operators import raster as ras
from sigilframe.plans.feature_queries import EUCLID, PIXELS, VIEW, Z, features, raster_rows, rounded
from sigilframe.schema import FEATURES

CENTRES, ROUNDS = 8, 5


def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    z, columns = similarity.z_columns(features(spark, d))
    return rounded(clusters.dendrogram(clusters.spanning_tree(z, columns, "idx")), "height")


# The tree grows from row 0 by the least edge to a row outside; a merge's sides are what its ends reach over lower edges.
LINKAGE = f"""WITH RECURSIVE {VIEW}, {Z}, d AS MATERIALIZED (SELECT a.idx AS a, b.idx AS b, {EUCLID} AS d FROM z a, z b WHERE a.idx <> b.idx),
p AS (SELECT 0 AS step, b AS idx, d, a, row_number() OVER (ORDER BY d, least(a, b), greatest(a, b)) AS r FROM d WHERE a = (SELECT min(idx) FROM z)
 UNION ALL SELECT step, idx, e.d, e.a, row_number() OVER (ORDER BY e.d, least(e.a, idx), greatest(e.a, idx)) FROM (
 SELECT p.step + 1 AS step, p.idx, CASE WHEN (n.d, least(n.a, n.b), greatest(n.a, n.b)) < (p.d, least(p.a, p.idx), greatest(p.a, p.idx)) THEN {{'d': n.d, 'a': n.a}} ELSE {{'d': p.d, 'a': p.a}} END AS e
 FROM p, (SELECT idx AS at FROM p WHERE r = 1) t, d n WHERE p.r > 1 AND n.a = t.at AND n.b = p.idx)),
m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, least(a, idx), greatest(a, idx)) AS place, d, a AS u, idx AS v FROM p WHERE r = 1),
l AS MATERIALIZED (SELECT place, u AS s, v AS t FROM m UNION ALL SELECT place, v, u FROM m),
w AS (SELECT place, 0 AS side, u AS idx FROM m UNION SELECT place, 1, v FROM m UNION SELECT w.place, w.side, l.t FROM w JOIN l ON l.s = w.idx AND l.place < w.place),
s AS (SELECT place, side, min(idx) AS name, count(*) AS n FROM w GROUP BY ALL)
SELECT m.place, least(x.name, y.name) AS "left", greatest(x.name, y.name) AS "right", round(m.d, 6) AS height, x.n + y.n AS size FROM m JOIN s x ON x.place = m.place AND x.side = 0 JOIN s y ON y.place = m.place AND y.side = 1"""


def linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Twelve flat clusters of the tree."""
    z, columns = similarity.z_columns(features(spark, d))
    return clusters.cut_tree(clusters.spanning_tree(z, columns, "idx"), z, "idx", clusters=12)


_CUT = LINKAGE[: LINKAGE.index(",\nl AS MATERIALIZED")]
FLAT = f"""{_CUT}, k AS (SELECT u AS s, v AS t FROM m WHERE place <= (SELECT max(place) - 11 FROM m) UNION ALL SELECT v, u FROM m WHERE place <= (SELECT max(place) - 11 FROM m)),
w AS (SELECT idx AS s, idx AS t FROM z UNION SELECT w.s, k.t FROM w JOIN k ON k.s = w.t) SELECT s AS idx, min(t) AS cluster FROM w GROUP BY s"""


def k_means(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds from the first eight rows; distances to the centres that these end with."""
    f = features(spark, d)
    start = np.array([[r[c] for c in FEATURES] for r in f.orderBy("idx").limit(CENTRES).collect()])
    found = clusters.k_means(f, list(FEATURES), CENTRES, start, ROUNDS, shift=-1.0)
    return rounded(clusters.assigned(f, list(FEATURES), "idx", found.at), "distance")


def _means_sql() -> str:
    x = [f"x{i}" for i in range(6)]
    gap = " + ".join(f"(f.{a} - c.{a}) * (f.{a} - c.{a})" for a in x)
    parts = [f"v AS (SELECT CAST(vec_id AS BIGINT) AS idx, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(6))} FROM embeddings)", f"c0 AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS k, {', '.join(x)} FROM v ORDER BY idx LIMIT {CENTRES})"]
    for r in range(ROUNDS + 1):
        parts.append(f"n{r} AS (SELECT idx, {', '.join('f.' + a for a in x)}, k, {gap} AS d FROM v f, c{r} c QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d, k) = 1)")
        if r < ROUNDS:
            parts.append(f"c{r + 1} AS (SELECT c.k, {', '.join(f'coalesce(m.{a}, c.{a}) AS {a}' for a in x)} FROM c{r} c LEFT JOIN (SELECT k, {', '.join(f'CAST(sum(floor({a} * 1048576 + 0.5)) AS DOUBLE) / count(*) / 1048576 AS {a}' for a in x)} FROM n{r} GROUP BY k) m ON m.k = c.k)")
    return "WITH " + ",\n".join(parts) + f" SELECT idx, k AS cluster, round(sqrt(d), 6) AS distance FROM n{ROUNDS}"


def k_means_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters that k-means finds from its own starting centres. They are drawn by a hash that SQL lacks, so tests hold it."""
    f = features(spark, d)
    found = clusters.k_means(f, list(FEATURES), CENTRES)
    of = clusters.assigned(f, list(FEATURES), "idx", found.at)
    return rounded(of.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance")), "mean_distance")


def near_bins(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of quantile bins that differ in one channel, or two."""
    of = bins.binned(features(spark, d), "idx")
    return bins.near_classes(bins.classes(of, "idx"), len(FEATURES), most=2)


def bin_members(spark: SparkSession, d: str) -> DataFrame:
    return bins.members(bins.binned(features(spark, d), "idx"), "idx")


_LEVEL = ", ".join(f"(f.{x} > q.{x}_1)::INT + (f.{x} > q.{x}_2)::INT + (f.{x} > q.{x}_3)::INT" for x in FEATURES)
BINS = f"{VIEW}, q AS (SELECT {', '.join(f'quantile_cont({x}, {i / 4}) AS {x}_{i}' for x in FEATURES for i in (1, 2, 3))} FROM f), b AS (SELECT idx, [{_LEVEL}] AS bins FROM f, q), c AS (SELECT min(idx) AS class, bins FROM b GROUP BY bins)"
NEAR_BINS = f"WITH {BINS} SELECT x.class AS a, y.class AS b, m AS mismatches FROM (SELECT x, y, {' + '.join(f'(x.bins[{i}] <> y.bins[{i}])::INT' for i in range(1, 7))} AS m FROM c x, c y WHERE x.class < y.class) WHERE m <= 2"


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents by source, sources of few documents whole."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    return sampling.stratified(docs, "source", "doc_id", docs.count() // 2, seed=11, whole=30)


SAMPLE = """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT (SELECT count(*) // 2 FROM documents) - coalesce(sum(n) FILTER (n <= 30), 0) AS want, coalesce(sum(n) FILTER (n > 30), 0) AS rows FROM s),
u AS (SELECT least(greatest(want, 0), rows) AS share, greatest(rows, 1) AS rows FROM t), b AS (SELECT source, n, CASE WHEN n <= 30 THEN n ELSE n * share // rows END AS base, CASE WHEN n <= 30 THEN -1 ELSE n * share % rows END AS rest FROM s, u),
q AS (SELECT source, base + CASE WHEN rest >= 0 AND row_number() OVER (ORDER BY rest DESC, source NULLS FIRST) <= (SELECT share FROM u) - (SELECT coalesce(sum(base), 0) FROM b WHERE rest >= 0) THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('11:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, r.source FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source WHERE k <= quota"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The label of a vector, and the signs of its first three components as another."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    signs = sum(((F.col("embedding")[i] > 0).cast("int") * 2**i for i in range(3)), F.lit(0))
    return e.select(F.col("label").alias("x"), signs.alias("y"))


def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clusters.alignment(labelled(spark, d), "x", "y"), "rand", "mutual", "homogeneity", "completeness")


def label_contingency(spark: SparkSession, d: str) -> DataFrame:
    return clusters.contingency(labelled(spark, d), "x", "y")


TABLE = "SELECT label AS a, (embedding[1] > 0)::INT + (embedding[2] > 0)::INT * 2 + (embedding[3] > 0)::INT * 4 AS b, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL"
ALIGNED = f"""WITH c AS ({TABLE}), x AS (SELECT sum(n) AS n FROM c GROUP BY a), y AS (SELECT sum(n) AS n FROM c GROUP BY b),
t AS (SELECT sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2) AS s, -sum(n / (SELECT sum(n) FROM c) * ln(n / (SELECT sum(n) FROM c))) AS h FROM c),
u AS (SELECT sum(n * (n - 1) / 2) AS s, -sum(n / (SELECT sum(n) FROM c) * ln(n / (SELECT sum(n) FROM c))) AS h FROM x), v AS (SELECT sum(n * (n - 1) / 2) AS s, -sum(n / (SELECT sum(n) FROM c) * ln(n / (SELECT sum(n) FROM c))) AS h FROM y)
SELECT t.t::BIGINT AS n, round((t.s - u.s * v.s / (t.t * (t.t - 1) / 2)) / ((u.s + v.s) / 2 - u.s * v.s / (t.t * (t.t - 1) / 2)), 6) AS rand, round((u.h + v.h - t.h) / ((u.h + v.h) / 2), 6) AS mutual, round((u.h + v.h - t.h) / u.h, 6) AS homogeneity, round((u.h + v.h - t.h) / v.h, 6) AS completeness FROM t, u, v"""

def raster_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Contours, holes, perimeter, occupancy, symmetry and filling of the vectors' rasters."""
    chosen = tuple(e for e in shapes.EXTRACTORS if e.name != "compressed_share")
    found = ras.split_failures(ras.extract(raster_rows(spark, d), "idx", extractors=chosen, decode=ras.of_vector("v")), "idx")[0]
    whole = found.select("idx", *(F.col(c).cast("long").alias(c) for c in ("contours", "holes", "perimeter")), "box_share", "box_fill", "symmetry_x", "symmetry_y", "inside_share")
    return rounded(whole, "box_share", "box_fill", "symmetry_x", "symmetry_y", "inside_share")


# Parts meet over corners, the background over sides and around the border; a hole is a background part that doesn't reach the border.
SHAPES = f"""WITH RECURSIVE {PIXELS},
cells AS (SELECT CAST(vec_id AS BIGINT) AS idx, x, y FROM embeddings, (SELECT unnest(range(-1, 9)) AS x), (SELECT unnest(range(-1, 9)) AS y)), bg AS (SELECT * FROM cells ANTI JOIN px USING (idx, x, y)),
e8 AS (SELECT a.idx, a.x, a.y, b.x AS u, b.y AS v FROM px a JOIN px b ON a.idx = b.idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), e4 AS (SELECT a.idx, a.x, a.y, b.x AS u, b.y AS v FROM bg a JOIN bg b ON a.idx = b.idx AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
w8 AS (SELECT idx, x, y, x AS u, y AS v FROM px UNION SELECT w.idx, w.x, w.y, e.u, e.v FROM w8 w JOIN e8 e ON e.idx = w.idx AND e.x = w.u AND e.y = w.v),
w4 AS (SELECT idx, x, y, x AS u, y AS v FROM bg UNION SELECT w.idx, w.x, w.y, e.u, e.v FROM w4 w JOIN e4 e ON e.idx = w.idx AND e.x = w.u AND e.y = w.v),
parts AS (SELECT idx, count(DISTINCT r) AS n FROM (SELECT idx, x, y, min(v * 10 + u) AS r FROM w8 GROUP BY ALL) GROUP BY idx), gaps AS (SELECT idx, count(DISTINCT r) - 1 AS n FROM (SELECT idx, x, y, min((v + 1) * 10 + u + 1) AS r FROM w4 GROUP BY ALL) GROUP BY idx),
near AS (SELECT p.idx, p.x, p.y, count(q.x) AS n FROM px p LEFT JOIN px q ON q.idx = p.idx AND abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY ALL),
box AS (SELECT idx, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, count(*) AS n FROM px GROUP BY idx),
turned AS (SELECT p.idx, count(*) FILTER (EXISTS (SELECT 1 FROM px q WHERE q.idx = p.idx AND q.y = p.y AND q.x = b.x1 + b.x2 - p.x)) AS sx, count(*) FILTER (EXISTS (SELECT 1 FROM px q WHERE q.idx = p.idx AND q.x = p.x AND q.y = b.y1 + b.y2 - p.y)) AS sy FROM px p JOIN box b ON b.idx = p.idx GROUP BY p.idx),
side AS (SELECT idx, sum(4 - n) AS perimeter, count(*) FILTER (n = 4) AS core FROM near GROUP BY idx)
SELECT v.vec_id::BIGINT AS idx, (coalesce(parts.n, 0) + gaps.n)::BIGINT AS contours, gaps.n::BIGINT AS holes, coalesce(perimeter, 0)::BIGINT AS perimeter, round(coalesce((x2 - x1 + 1) * (y2 - y1 + 1) / 64.0::DOUBLE, 0), 6) AS box_share, round(coalesce(box.n::DOUBLE / ((x2 - x1 + 1) * (y2 - y1 + 1)), 0), 6) AS box_fill,
 round(coalesce(sx::DOUBLE / (2 * box.n - sx), 1), 6) AS symmetry_x, round(coalesce(sy::DOUBLE / (2 * box.n - sy), 1), 6) AS symmetry_y, round(coalesce(core::DOUBLE / box.n, 0), 6) AS inside_share
FROM embeddings v LEFT JOIN parts ON parts.idx = v.vec_id LEFT JOIN gaps ON gaps.idx = v.vec_id LEFT JOIN side ON side.idx = v.vec_id LEFT JOIN box ON box.idx = v.vec_id LEFT JOIN turned ON turned.idx = v.vec_id"""


def contour_tree(spark: SparkSession, d: str) -> DataFrame:
    """How many contours of each kind there are at each depth, and how long they are. Tests hold the tree itself."""
    c = shapes.contours(raster_rows(spark, d), "idx", decode=ras.of_vector("v"))
    return c.groupBy("depth", "is_outer").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("area").alias("area"))


def raster_hog(spark: SparkSession, d: str) -> DataFrame:
    """Orientation histograms of four cells of four pixels: a row for each number."""
    h = shapes.hog(raster_rows(spark, d), "idx", cell=4, decode=ras.of_vector("v"))
    return rounded(h.select("idx", F.posexplode("hog").alias("place", "value")), "value")


# Gradients of 8 x 8 pixels of black on white, each dealt to two of nine bins of 20 degrees, one block.
HOG = """WITH g AS (SELECT CAST(vec_id AS BIGINT) AS idx, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CASE WHEN CAST(embedding[i] AS DOUBLE) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM embeddings, range(1, 65) t(i)),
d AS (SELECT c.idx, c.x, c.y, r.v - l.v AS gx, b.v - t.v AS gy FROM g c JOIN g r ON r.idx = c.idx AND r.y = c.y AND r.x = least(7, c.x + 1) JOIN g l ON l.idx = c.idx AND l.y = c.y AND l.x = greatest(0, c.x - 1) JOIN g b ON b.idx = c.idx AND b.x = c.x AND b.y = least(7, c.y + 1) JOIN g t ON t.idx = c.idx AND t.x = c.x AND t.y = greatest(0, c.y - 1)),
p AS (SELECT idx, (y // 4) * 2 + x // 4 AS cell, sqrt(gx * gx + gy * gy) AS size, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() WHEN atan2(gy, gx) >= pi() THEN atan2(gy, gx) - pi() ELSE atan2(gy, gx) END / (pi() / 9) - 0.5 AS place FROM d),
w AS (SELECT idx, cell, (floor(place)::INT + 9) % 9 AS bin, size * (1 - (place - floor(place))) AS v FROM p UNION ALL SELECT idx, cell, (floor(place)::INT + 10) % 9, size * (place - floor(place)) FROM p),
h AS (SELECT idx, cell, bin, sum(v) AS v FROM w GROUP BY ALL), n AS (SELECT idx, sqrt(sum(v * v) + 1e-10) AS n FROM h GROUP BY idx)
SELECT CAST(e.vec_id AS BIGINT) AS idx, (c * 9 + b)::INT AS place, round(coalesce(h.v, 0) / n.n, 6) AS value FROM embeddings e, (SELECT unnest(range(4)) AS c), (SELECT unnest(range(9)) AS b) JOIN n ON n.idx = e.vec_id LEFT JOIN h ON h.idx = e.vec_id AND h.cell = c AND h.bin = b"""


def raster_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity of each raster and those of its three nearest rows by features."""
    z, columns = similarity.z_columns(features(spark, d))
    near = similarity.neighbours(z, columns, "idx", 3).select("source", "target")
    return rounded(shapes.similar(near, raster_rows(spark, d), key="idx", decode=ras.of_vector("v")).select("source", "target", "ssim"), "ssim")


SIMILAR = f"""WITH {VIEW}, {Z}, p AS (SELECT a.idx AS s, b.idx AS t, {EUCLID} AS d FROM z a, z b WHERE a.idx <> b.idx), r AS (SELECT s, t FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, t) <= 3),
g AS (SELECT CAST(vec_id AS BIGINT) AS idx, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CASE WHEN CAST(embedding[i] AS DOUBLE) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM embeddings, range(1, 65) t(i)),
w AS (SELECT s, t, wx, wy, avg(a.v) AS ma, avg(b.v) AS mb, avg(a.v * a.v) AS aa, avg(b.v * b.v) AS bb, avg(a.v * b.v) AS ab FROM r JOIN g a ON a.idx = s JOIN g b ON b.idx = t AND b.x = a.x AND b.y = a.y, (SELECT unnest([0, 1]) AS wx), (SELECT unnest([0, 1]) AS wy) WHERE a.x BETWEEN wx AND wx + 6 AND a.y BETWEEN wy AND wy + 6 GROUP BY ALL)
SELECT s AS source, t AS target, round(avg((2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (aa - ma * ma + bb - mb * mb + 0.0009))), 6) AS ssim FROM w GROUP BY s, t"""

def crop_levels(spark: SparkSession, d: str) -> DataFrame:
    """Two boxes of each vector's grey page with their contrast stretched, one over the page's edge: written as PNG, read back, a row a pixel."""
    pages = raster_rows(spark, d).withColumnRenamed("idx", "page")
    sides = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for i, b in enumerate(((1, 2, 7, 6), (5, 5, 10, 9)))))
    boxes = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("page"), F.explode(sides).alias("b")).select("page", (F.col("page") * 2 + F.col("b.i")).alias("key"), "b.x1", "b.y1", "b.x2", "b.y2", F.lit(1).alias("times"))
    cut = ras.page_crops(pages, boxes, decode=ras.grey_of_vector())
    return ras.levels(cut, "key").select("key", "width", "height", F.posexplode("levels").alias("place", "level"))


CROPS = """WITH g AS (SELECT CAST(vec_id AS BIGINT) AS page, (i - 1) % 8 AS x, (i - 1) // 8 AS y, least(255, greatest(0, floor(CAST(embedding[i] AS DOUBLE) * 255 + 128)))::BIGINT AS v FROM embeddings, range(1, 65) t(i)),
b(i, x1, y1, x2, y2) AS (VALUES (0, 1, 2, 7, 6), (1, 5, 5, 10, 9)), p AS (SELECT vec_id::BIGINT * 2 + b.i AS key, vec_id::BIGINT AS page, x2 - x1 AS width, y2 - y1 AS height, x, y, (y - y1) * (x2 - x1) + x - x1 AS place FROM embeddings, b, (SELECT unnest(range(10)) AS x), (SELECT unnest(range(10)) AS y) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2),
c AS (SELECT p.*, coalesce(g.v, 0) AS v FROM p LEFT JOIN g ON g.page = p.page AND g.x = p.x AND g.y = p.y), m AS (SELECT key, min(v) AS lo, max(v) AS hi FROM c GROUP BY key)
SELECT key, width::INT AS width, height::INT AS height, place::INT AS place, (CASE WHEN hi > lo THEN (v - lo) * 255 // (hi - lo) ELSE v END)::INT AS level FROM c JOIN m USING (key)"""

QUERIES = {
    "single_linkage": (single_linkage, LINKAGE),
    "linkage_clusters": (linkage_clusters, FLAT),
    "k_means": (k_means, _means_sql()),
    "k_means_seeded": (k_means_seeded, None),
    "near_bins": (near_bins, NEAR_BINS),
    "bin_members": (bin_members, f"WITH {BINS} SELECT b.idx, c.class FROM b JOIN c ON b.bins = c.bins"),
    "stratified_sample": (stratified_sample, SAMPLE),
    "label_alignment": (label_alignment, ALIGNED),
    "label_contingency": (label_contingency, TABLE),
    "raster_shapes": (raster_shapes, SHAPES),
    "contour_tree": (contour_tree, None),
    "crop_levels": (crop_levels, CROPS),
    "raster_hog": (raster_hog, HOG),
    "raster_similarity": (raster_similarity, SIMILAR),
}
