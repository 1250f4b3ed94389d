"""Connected components of a link table, by alternating star contraction.

Links are never gathered in one place: every round is two grouped minima and two joins, written to
the shared folder. A hub with very many links is handled by map-side minima and by Spark's splitting
of skewed joins. Rounds end when the link table no longer changes; their number grows with the
logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stage_table


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a, b) but the smallest of its component, a kept table.

    Nulls and loops are ignored, repeated and reversed links count once. The component is the smallest
    node that can be reached. An empty link table gives an empty result.
    """
    spark = links.sparkSession
    first = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    with scratch(spark):
        state, mark = stage_table(first, name), None
        while True:
            now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
            if now[0] == 0 or tuple(now) == mark:
                return stage_table(state.select(F.col("u").alias("node"), F.col("v").alias("component")), name, keep=True)
            mark = tuple(now)
            state = stage_table(_small_star(_large_star(state)), name)
