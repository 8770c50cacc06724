import math

import numpy as np
from pyspark.sql import functions as F

from sigilframe.llm import crosspoly
from sigilframe.llm.components import _with_least, components


def brute(rows, queries, k=20):
    out = {}
    for q, x in queries:
        s = sorted(((-float(np.dot(np.float64(x), np.float64(v))), i) for i, v in rows if i != q))[:k]
        out[q] = [i for _, i in s]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_odd_vectors(spark):
    r = np.random.default_rng(0)
    good = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(45)]  # ties
    bad = [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, [None] + [1.0] * 7), (206, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, i, "x", 1) for i, v in [*good, *bad, good[3]]], "vec_id long, embedding array<float>, block long, codes string, h1 int")
    want = brute(good, [(i, v) for i, v in good if i % 20 == 0])
    assert found(crosspoly.nearest(df, df.where("vec_id % 20 = 0"), recall=1.0)) == want  # fitted to all rows, so nothing is missed
    got = found(crosspoly.digest(df))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert crosspoly.digest(df.limit(0)).collect() == []
    assert crosspoly.digest(df.where("vec_id in (0, 1, 202)")).count() == 1


def recall_of(spark, x, every, dims="embedding array<double>"):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, " + dims)
    got = found(crosspoly.nearest(df, df.where(f"vec_id % {every} = 0")))
    assert all(len(v) == 20 for v in got.values())
    want = brute(rows, [(i, v) for i, v in rows if i % every == 0])
    return np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])


def test_recall_and_lengths(spark):
    r = np.random.default_rng(1)
    assert recall_of(spark, r.normal(size=(3000, 32)) * r.uniform(0.2, 3, (3000, 1)), 100) >= 0.9


def test_recall_of_long_and_clustered_vectors(spark):
    r = np.random.default_rng(2)
    middles = r.normal(size=(60, 200))
    x = middles[r.integers(0, 60, 6000)] + 0.3 * r.normal(size=(6000, 200))
    assert recall_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True), 150) >= 0.9
    assert crosspoly.Turner(1024).buckets_each == crosspoly.Turner(64).buckets_each


def test_recall_of_the_supplied_vectors(spark):
    x = np.stack([np.array(r.embedding, np.float64) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    assert recall_of(spark, x, 20) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x)


def test_blocks_split_hot_buckets():
    counts = np.zeros((2, 10), np.int64)
    counts[0, 1], counts[0, 3], counts[0, 4], counts[1, 2] = 10, crosspoly.BLOCK * 3 + 1, 5, 7
    first, salts, n = crosspoly.plan_blocks(counts)
    assert salts[0, 3] == 4 and n == 7 and len({first[0, 1], first[0, 3], first[0, 4], first[1, 2]}) == 4


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 104), (7, 7), (None, 3), (104, 100), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 102: 100, 104: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert math.isfinite(len(got))


def test_hot_star_is_split(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "1k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        star = spark.range(1, 40_001, numPartitions=40).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        rest = spark.range(100_000, 100_500, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        e = star.unionByName(rest).select(F.col("b").alias("u"), F.col("a").alias("v"))
        joined = _with_least(e, e.groupBy("u").agg(F.min("v").alias("m")))
        assert len(joined.collect()) == 40_250
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        got = components(star.unionByName(rest))
        roots = got.groupBy("root").count()
        assert roots.where("root = 0").first()["count"] == 40_001
        assert roots.where("root <> 0 and count = 2").count() == 250 and roots.count() == 251
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
