"""Connected components of an edge table, by alternating stars; nothing passes the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corridor.llm.shared import workspace, written


class Forest:
    """A spanning forest of the links seen, between nodes or between groups of nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, a: int, b: int, link: tuple[int, int] | None = None) -> None:
        """Join the trees of a and b, by ``link`` if that names other ends; nothing if they are one."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append(link or (a, b))


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): the smallest node reachable, for every node with an edge.

    Large stars and small stars in turn (Kiveris et al. 2014): each node's
    neighbours are linked to the smallest node of its neighbourhood until no
    edge changes. Every round is two aggregates and two joins; minima are
    pre-aggregated and hot nodes are split by the joins. Each round is written
    to the shared folder, so lineage stays short. Rows with nulls and loops
    are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    base = workspace(spark, what)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, f"{base}/0")
    seen, n = None, 0
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen, n = tuple(state), n + 1
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.*").where("u <> v").distinct(), f"{base}/{n}")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
