"""Connected components of a link table by alternating stars, nothing on the driver."""

from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    `links` has long columns a and b, none null. A star has every node linked straight to
    its least one; rounds go on until nothing changes, which takes about the logarithm of
    the longest chain. Only a count and a checksum of each round reach the driver.
    """
    links = stored(links.where("a != b").select("a", "b"), "links")
    mark = None
    while True:
        links = stored(_small_star(_large_star(links)), "stars")
        found = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
