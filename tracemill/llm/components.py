"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n items by the links a-b (numpy hooking and pointer jumping)."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        hook = root.copy()
        np.minimum.at(hook, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = hook[hook]
            if (jump == hook).all():
                break
            hook = jump
        root = hook[root]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` has long columns a and b, root is one of the class's nodes.

    Every round maps each node to the neighbour (or itself) of least pseudo-random priority and contracts
    the links, so the links left shrink by a constant factor however long the chains are. All steps are joins
    and combinable aggregations on single nodes; each round is written to the shared folder.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping = None
    for turn in count():
        if links.isEmpty():
            break
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        prio = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("n"))
        best = both.groupBy("a").agg(F.min(prio("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), prio("a"))["n"].alias("root"))
        best = materialize(best, "roots")
        left = links.join(best, F.col("a") == F.col("node")).select(F.col("root").alias("x"), "b")
        left = left.join(best, F.col("b") == F.col("node")).select("x", F.col("root").alias("y"))
        before, links = links, materialize(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop_scratch(before)
        if mapping is None:
            mapping = best
        else:
            nxt = best.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            old, mapping = mapping, materialize(mapping.join(nxt, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")), "mapping")
            drop_scratch(old, best)
    return mapping if mapping is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
