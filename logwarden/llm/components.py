"""Connected components of a link table, without a driver-side or single-task step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def components(links: DataFrame) -> DataFrame | None:
    """(node, root) for every node of ``links`` (a, b); None if there are no links.

    Contraction: each round every node points at the neighbour (or itself) that
    comes first in a random order of that round, and the links are redrawn between
    the nodes pointed at. A fixed share of the nodes disappears per round, also in
    long chains, so the number of rounds grows with the logarithm of the longest
    chain. The tables of pointers shrink the same way; they are joined in the end.
    Every round's tables are checkpointed, so a lost executor costs one round's tasks.
    """
    rounds = []
    links = links.select("a", "b").where("a <> b").checkpoint()
    while not links.isEmpty():
        order = F.xxhash64(F.col("b"), F.lit(len(rounds)))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order.alias("h"), F.col("b"))).alias("best"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(len(rounds))).alias("h"), F.col("a").alias("b"))
        point = first.select(F.col("a").alias("node"), F.least(own, F.col("best"))["b"].alias("root"))
        # a node pointed at may itself point on: follow once more
        far = point.select(F.col("node").alias("root"), F.col("root").alias("far"))
        point = point.join(far, "root").select("node", F.col("far").alias("root")).checkpoint()
        rounds.append(point)
        at = lambda side: point.select(F.col("node").alias(side), F.col("root").alias(side + "2"))
        links = (
            links.join(at("a"), "a").join(at("b"), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .where("a <> b").distinct().checkpoint()
        )
    if not rounds:
        return None
    found = rounds[-1]
    for point in reversed(rounds[:-1]):
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = point.join(onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
