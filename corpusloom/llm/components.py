"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Table


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, Table]:
    """One half step. Each node's smallest neighbour is aggregated map-side first and written, so that the join back
    is a plain equi-join whose hot nodes AQE can split."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = Table(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    met = around.join(least.df, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.df.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct(), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge to another; component is the smallest node reachable.

    Edges with a null end and self-loops say nothing; an empty edge table gives an empty result. Only whether there is
    a next round reaches the driver; each half step is written to the shared folder.
    """
    now = Table(
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        for large in (True, False):
            df, least = _star(now.df, large)
            after = Table(df)
            now.drop()
            least.drop()
            now = after
        # Done when each node has one edge, and that leads to a root: then it is the smallest of its component.
        inner = now.df.select("b").distinct().join(now.df.select(F.col("a").alias("b")), "b", "left_semi")
        forked = now.df.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        if inner.union(forked).isEmpty():
            break
    found = now.df
    nodes = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(found.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("component").alias("component"))


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of local links: (node, smallest node)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after
