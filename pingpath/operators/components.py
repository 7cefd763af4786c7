"""Connected components of an undirected graph as DataFrame rounds.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014).  Every round is two
aggregations and two joins on node ids; each round's edge list is checkpointed
in the shared checkpoint folder so lineage stays short and a lost executor only
recomputes one round.  The loop ends when the graph is a forest of stars whose
centres are the component minima; every round before that brings the sum of the
lower ends down, so the loop always ends (in O(log^2 nodes) rounds).

A graph of at most ``LOCAL_EDGES`` edges is finished by one task instead, which saves
the rounds' scheduling; the labels are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath.session import cut_lineage


#: Edges (16 bytes each) that one task may hold.
LOCAL_EDGES = 200_000


def _normalise(df: DataFrame, a: str, b: str) -> DataFrame:
    return (df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
            .where(F.col("u") != F.col("v")).distinct())


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        e.select(F.col("v").alias("a"), F.col("u").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    m = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    out = both.where(F.col("b") > F.col("a")).join(m, "a")
    return _normalise(out, "b", "m")


def _small_star(e: DataFrame) -> DataFrame:
    lower = _both_ways(e).where(F.col("b") < F.col("a"))
    m = lower.groupBy("a").agg(F.min("b").alias("m"))
    out = lower.join(m, "a").select(F.col("b").alias("x"), "m").unionByName(
        m.select(F.col("a").alias("x"), "m"))
    return _normalise(out, "x", "m")


def _is_star_forest(e: DataFrame) -> bool:
    """No upper end is also a lower end, and none has two lower ends."""
    ends = e.select(F.col("v").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(
        e.select(F.col("u").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") > 0))).isEmpty()


def _labels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least reachable node of every node of the edges (u, v)."""
    parts = [p for p in parts if len(p)]
    if not parts:
        return
    e = pd.concat(parts)
    nodes, ends = np.unique(np.concatenate([e["u"], e["v"]]), return_inverse=True)
    a, b = ends[:len(e)], ends[len(e):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "label": nodes[label]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node that has an edge; label = component minimum.

    ``edges`` holds BIGINT node ids; direction and duplicates do not matter.
    Nodes without edges are not in the result (they are their own component).
    """
    e = cut_lineage(_normalise(edges, src, dst))
    if e.count() <= local_edges:
        return cut_lineage(e.coalesce(1).mapInPandas(_labels, "node long, label long"))
    while not _is_star_forest(e):
        e = cut_lineage(_small_star(_large_star(e)))
    return (e.select(F.col("v").alias("node"), F.col("u").alias("label"))
            .unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("label")))
            .distinct())
