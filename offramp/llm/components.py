"""Connected components of a table of links."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offramp.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links that one union-find holds at a time; more are united in several forests.
FOREST_LINKS = 1 << 20


def _forest(links: list[tuple[int, int]]) -> dict[int, int]:
    """Union-find: node -> smallest node that the links connect it with, without the roots."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent) if find(x) != x}


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(links):
        forest = _forest(links)
        return pa.RecordBatch.from_arrays([pa.array(list(forest.keys()), pa.int64()),
                                           pa.array(list(forest.values()), pa.int64())], names=["a", "b"])

    links: list[tuple[int, int]] = []
    for batch in batches:
        links += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(links) >= FOREST_LINKS:
            yield out(links)
            links = []
    if links:
        yield out(links)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``links`` (``a, b`` BIGINT).

    Each task first unites its own links by union-find. Their forests are dealt to as many tasks as
    forests of ``FOREST_LINKS`` links are needed and united again. If these are several, they are united
    by alternating large and small stars (every node hands its neighbours the smallest node it
    knows), which needs a logarithmic number of rounds. A hub's links are only ever aggregated to a
    minimum and joined, never gathered. An empty table of links gives an empty result.
    """
    pair = "a bigint, b bigint"
    edges = stored(links.where("a <> b").mapInArrow(_united, pair), "links")
    forests = 1 + edges.count() // FOREST_LINKS
    edges = edges.repartition(forests, "a") if forests > 1 else edges.repartition(1)  # all in one, or the stars below
    edges = stored(edges.mapInArrow(_united, pair), "forests")
    if forests == 1:  # every node of the only forest stands next to its smallest
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
            edges.select("b", "b").toDF("node", "component").distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node itself, go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        edges = stored(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
