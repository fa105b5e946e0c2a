"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Every round is a handful of equi-joins and map-side combined minima; lineage is cut by a checkpoint per
round, and only a few numbers per round reach the driver. Rounds end when every component is a star, so a graph
of stars (a leader and its members) takes none. The neighbourhood of a hub is not gathered: in the one join of a
round, nodes with many neighbours are broadcast (``skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import join_frequent

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Edges that a partition holds at least between rounds (16 bytes each).
EDGES = 200_000


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that ``spark.checkpoint.dir`` names; there must be one."""
    session = df.sparkSession
    if not session.sparkContext.getCheckpointDir():
        folder = session.conf.get(CHECKPOINT_KEY, None)
        if not folder:
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set: name a folder that the driver and all executors share")
        session.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Of each node's neighbours, the larger ones are tied to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"), F.count(F.lit(1)).alias("n"))
    # a node's larger neighbours have it as their smaller end, so each edge is looked at from there
    tied = join_frequent(edges.select(F.col("dst").alias("src"), F.col("src").alias("far")), low, "src", "n", 2 * total)
    return tied.select(F.col("far").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of each node's smaller neighbours, all and the node itself are tied to the smallest."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    # ties of a node to several smaller ones are few after a large star, where each has one
    tied = edges.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return tied.unionByName(low.select("src", F.col("low").alias("dst"))).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars: those below two others, or below one and above another."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    row = nodes.agg(F.sum("below"), F.count(F.when((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)), 1))).first()
    return row[0] or 0, row[1]


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = the smallest node that is connected.

    ``edges`` has (src, dst) of one orderable type; loops, repeats and rows with a null end don't matter.
    ``nodes`` (node) adds nodes without edges. Without ``nodes`` only the ends of edges are returned.
    """
    kind = edges.schema["src"].dataType
    current = materialize(
        edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    for _ in range(max_rounds):
        total, rest = _state(current)
        if not rest:
            break
        # rounds never add edges: a small graph is held in few files, however many partitions its shuffles have
        current = materialize(_small_star(_large_star(current, total)).coalesce(max(1, total // EDGES)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
    if nodes is None:
        return found
    every = nodes.select(F.col("node").cast(kind).alias("node")).where("node is not null").distinct()
    return every.join(found, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
