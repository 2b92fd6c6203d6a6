"""Connected components of links between keys, within a scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.session import written

MOST_ROUNDS = 60


def components(links: DataFrame, scope: Sequence[str], rounds: list | None = None) -> DataFrame:
    """scope, key, canonical: every key named in a link (scope, a, b) with the smallest key it reaches.

    Large and small stars in turn: a round hangs the larger neighbours of a key on the smallest key among it and its
    neighbours, then its smaller ones. Paths shrink to stars in a number of rounds that grows with the
    logarithm of the longest path. The links left are written after each round; the driver sees two numbers. `rounds`
    receives the number of links left after each.
    """
    scope = list(scope)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(*scope, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = written(ordered(links), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select(*scope, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(*scope, F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy(*scope, "u").agg(F.min("v").alias("m")).select(*scope, "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, [*scope, "u"]).select(*scope, F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(*scope, "a").agg(F.min("b").alias("m"))
        hung = large.join(low, [*scope, "a"])
        small = hung.select(*scope, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select(*scope, "a", F.col("m").alias("b")))
        edges = written(ordered(small), "links")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*scope, "a", "b"))).first())
        if rounds is not None:
            rounds.append(state[0])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(*scope, F.col("a").alias("key"), F.col("b").alias("canonical"))
    return named.unionByName(edges.select(*scope, F.col("b").alias("key"), F.col("b").alias("canonical")).distinct())
