"""Traversals of links between names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilframe.sources.folders import new_path, shared_folder


def settled(df: DataFrame) -> DataFrame:
    """Cuts a round's lineage by a checkpoint in the shared folder."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts a round's lineage by a table in the shared folder: one job, where a checkpoint computes its rows twice."""
    path = new_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt anew by their key, for work by rows: a small file of many rows is read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all nodes that roots (node) lead to over edges (parent, child), at their least depth; cycles end by themselves.
    A round joins the last frontier only. No side of a round is broadcast, as the driver would take in every round's."""
    e = written(edges.select("parent", "child")).hint("merge")
    frontier = written(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        frontier = written(step.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def leaves(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, leaf) of every way from a root (node) down ordered edges (parent, pos, child) to a node without children; path orders the leaves. A path never
    meets a node twice. A round goes one step down all ways that still can; its rows are cut off from the rounds before, so depth has no limit. No side of a round is broadcast."""
    down = written(edges.select(F.col("parent").alias("node"), F.col("pos").cast("int").alias("pos"), "child", F.lit(True).alias("_inner"))).hint("merge")
    walking = written(roots.select(F.col("node").alias("root"), "node", F.expr("cast(array() as array<int>)").alias("path"), F.array("node").alias("seen")))
    ends = []
    while not walking.isEmpty():
        went = written(walking.join(down, "node", "left"))
        ends.append(went.where("_inner is null").select("root", "path", F.col("node").alias("leaf")))
        step = went.where("_inner").where(~F.array_contains("seen", F.col("child")))
        walking = step.select("root", F.col("child").alias("node"), F.concat("path", F.array("pos")).alias("path"), F.concat("seen", F.array("child")).alias("seen"))
    return reduce(DataFrame.unionByName, ends) if ends else roots.select(F.col("node").alias("root"), F.expr("cast(array() as array<int>)").alias("path"), F.col("node").alias("leaf")).limit(0)


def files_below(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct files of the categories that roots lead to; members: (category, kind, title), kind being category or file."""
    down = members.where("kind = 'category'").select(F.col("category").alias("parent"), F.col("title").alias("child"))
    at = reachable(down, roots)
    return members.where("kind = 'file'").join(at.hint("merge"), F.col("category") == F.col("node"), "left_semi").select("title").distinct()


def rooted(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up) whose roots are their own up: each round goes up four times as far."""
    at = written(parents.select("node", "up"))
    while True:
        on = [at.select(F.col("node").alias(a), F.col("up").alias(b)) for a, b in (("up", "top"), ("top", "peak"), ("peak", "roof"))]
        step = at.join(on[0], "up").join(on[1], "top").join(on[2], "peak")
        at = written(step.select("node", F.col("roof").alias("up"), (F.col("up") != F.col("roof")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("node", F.col("up").alias("root"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link to another; root is the smallest node of its component. Each round ties a node to its smallest neighbour, if that is
    smaller than itself, and goes on with the links between the roots of these trees, so at most half of the nodes are left. Nodes may be of any ordered type; repeated links, links with a null end and
    links to the node itself count for nothing."""
    left = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    of = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = rooted(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")))
        of = step if of is None else written(of.join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = left.join(step.select(F.col("node").alias("u"), F.col("root").alias("x")), "u").join(step.select(F.col("node").alias("v"), F.col("root").alias("y")), "v")
        left = written(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct())
    return of if of is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))
