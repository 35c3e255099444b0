"""Connected components of a table of links, as joins and aggregations over durable intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being the smallest node it is connected with.

    Alternating large and small stars: every round hangs larger neighbours on the smallest one, so that rounds grow with the
    logarithm of the longest path. A node's minimum is aggregated on the map side first and met by an equal join, which
    Spark splits where one hub has very many links. Self links and repeated links do no harm.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, state = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
