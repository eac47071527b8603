"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.llm.common import stored
from baitwatch.plans.session import discard


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links the larger neighbours of every node (``both``), or its smaller ones and the node
    itself, to the smallest node around it."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if both:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("low"))
    least = least.withColumn("low", F.least("u", "low"))
    if both:
        linked = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("a"), "low")
    else:
        linked = pairs.join(least, "u").select(F.col("v").alias("a"), "low").unionByName(
            least.select(F.col("u").alias("a"), "low"))
    return linked.filter("a <> low").select("a", F.col("low").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)`` that isn't the smallest of its component.

    A large and a small star make a round; after a logarithmic number of them every node
    is linked to its root alone. Each round is written to the shared folder, so neither
    the lineage nor the driver grows with the number of edges, and the round before it is
    removed.
    """
    spark, edges = edges.sparkSession, edges.select("a", "b")
    folder = stored(edges.filter("a <> b").distinct(), "edges")
    links = spark.read.schema(edges.schema).parquet(folder)
    state = _state(links)
    while state[0]:
        before, old = state, folder
        folder = stored(_star(_star(links, True), False), "edges")
        discard(spark, old)
        links = spark.read.schema(edges.schema).parquet(folder)
        state = _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
