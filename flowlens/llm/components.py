"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial aggregation, so a node with a third of all links
costs one partial row per task) and an equi-join that adaptive execution may split.  Each
round's links are written to the shared folder: no lineage grows, nothing is collected but
one row of totals per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
    return (both.filter("dst > src").join(least, "src")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them; links run
    from the larger to the smaller node."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have a link.

    Loops, repeated links and either direction are allowed; null ends are dropped; no links
    give no rows.
    """
    edges = (links.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
             .filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND src <> dst").distinct()
             if {a, b} == {"src", "dst"} else
             links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).filter("src <> dst").distinct())
    edges, last = written(edges, "links"), None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        last = state
    raise RuntimeError("components did not settle")
