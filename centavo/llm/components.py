"""Connected components of links between ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.session import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links held by one task: every id that is not the smallest of its component, and that smallest id."""
    if not len(a):
        return a, b
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        low = np.minimum(p, q)
        np.minimum.at(label, np.maximum(p, q), low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every id in a link, label being the smallest id it reaches. links: columns a, b (bigint).

    Alternating stars: each round hangs the larger neighbours of an id, then its smaller ones, on the
    smallest id it sees, until every id hangs on the smallest of its component. A round shuffles
    each remaining link a few times; rounds grow with the logarithm of the longest path.
    """
    edges = written(_ordered(links), "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        edges = written(_ordered(small), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    )


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger id to the smaller."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
