"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import materialize_counted, shuffle_width


def _written(edges: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, tuple]:
    """The edge set written, with its size and a digest that tells whether it changed."""
    rows, seen = materialize_counted(
        edges.filter("node <> hub").distinct(), name, n=F.count(F.lit(1)), digest=F.bit_xor(F.xxhash64(*keys, "node", "hub"))
    )
    return rows, (seen["n"], seen["digest"])


def _with_least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``least``, the least ``hub`` of each row's node.

    A node's rows are dealt by a salt of their hub: minima are combined per salt, then per node, and come back to the rows by
    (node, salt). So the rows of a hub with very many neighbours are read by as many tasks as there are salts.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("hub"), F.lit(shuffle_width(rows.sparkSession))))
    per_salt = salted.groupBy(*keys, "node", "_salt").agg(F.min("hub").alias("_low"))
    least = per_salt.groupBy(*keys, "node").agg(F.min("_low").alias("least"))
    known = per_salt.drop("_low").join(least, [*keys, "node"])
    return salted.join(known, [*keys, "node", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select(*keys, "node", "hub").union(edges.select(*keys, F.col("hub").alias("node"), F.col("node").alias("hub")))
    near = _with_least(both, keys).filter("hub > node")
    return near.select(*keys, F.col("hub").alias("node"), F.least("node", "least").alias("hub"))


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    down = _with_least(edges.select(*keys, F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")), keys)
    return down.select(*keys, F.explode(F.array("hub", "node")).alias("node"), F.col("least").alias("hub"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, node, label): the least node of each component, for every node that has an edge. Nodes of different ``keys`` are different
    nodes, whatever their ids.

    Alternates large-star and small-star steps (Kiveris et al., 2014): O(log n) rounds, neighbour
    minima by partial aggregation, no neighbour lists. Each round is written to the shared
    folder. The rounds end when a pass leaves the edge set unchanged: every node then
    hangs on its component's least node.
    """
    keys = list(keys)
    current, seen = _written(
        edges.select(*keys, F.greatest(src, dst).alias("node"), F.least(src, dst).alias("hub")), keys, "components-edges"
    )
    while seen[0]:
        current, now = _written(_small_star(_large_star(current, keys), keys), keys, "components-round")
        if now == seen:
            break
        seen = now
    labels = current.select(*keys, "node", F.col("hub").alias("label"))
    return labels.union(current.select(*keys, F.col("hub").alias("node"), F.col("hub").alias("label")).distinct())
