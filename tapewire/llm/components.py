"""Connected components of a graph of long-valued nodes, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.session import Stored, store


def _towards_smallest(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a < b").distinct()


def _below_smallest(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("root"))
    others = edges.join(least, "b").select("root", F.col("a").alias("b"))
    own = least.select("root", "b")
    return others.union(own).where("root < b").select(F.col("root").alias("a"), "b").distinct()


def _mark(stored: Stored) -> tuple:
    row = stored.rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> Stored:
    """The smallest node of each node's component, for all nodes with a link, as stored rows (b, a = smallest).

    ``edges`` has long columns a and b, in any order, self-links and repeats allowed. Each round is
    an aggregation with map-side minima and a join, which Spark can split where one node has very
    many links; rounds grow with the logarithm of the longest chain. Each round is written to the
    shared folder, and the round before it is removed. The smallest nodes themselves are not listed.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = store(ordered)
    mark = _mark(now)
    while True:
        wide = store(_towards_smallest(now.rows))
        new = store(_below_smallest(wide.rows))
        wide.drop()
        now.drop()
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            return now
