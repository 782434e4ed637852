"""Connected components by alternating stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import discard, materialize, skew_join

#: Stars after which the search is given up (it halves long paths).
MAX_STARS = 60


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, least) and the table to discard: least is the smallest of u and its neighbours; edges are (u, v), distinct."""
    least = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("degree")), "least")
    return skew_join(edges, least, ["u"], "degree", "v"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the smallest node of each component; without loops.

    Large stars link a node's larger neighbours to the smallest one, small stars the others; the edges end as stars
    around the smallest nodes. The number of edges never grows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = materialize(pairs, "edges"), None
    for _ in range(MAX_STARS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, one = _with_least(both)
        large = materialize(joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct(), "large")
        down, two = _with_least(large)
        small = down.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        stars = materialize(small.filter("u <> v").distinct(), "stars")
        discard(pairs, one, large, two)
        pairs = stars
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return members.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError("the components didn't settle")
