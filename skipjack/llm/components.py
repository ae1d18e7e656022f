"""Connected components of links between long ids, in DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import HEAVY_ROWS, forget, join_unique, stored


def _least(edges: DataFrame) -> DataFrame:
    """Per u its least v and its number of edges, stored."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def _large(edges: DataFrame, heavy: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    joined = join_unique(both, least.select("u", F.least("u", "m").alias("m"), "n"), ["u"], heavy=heavy)
    out = stored(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
    forget(least)
    return out


def _small(edges: DataFrame, heavy: int) -> DataFrame:
    least = _least(edges)
    joined = join_unique(edges, least, ["u"], heavy=heavy)
    rest = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    out = stored(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    forget(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Every u has one edge and no v is a u: the list is stars around their least ids, which no round changes."""
    rows, ids = edges.agg(F.count("*"), F.countDistinct("u")).first()
    if rows != ids:
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60, heavy: int = HEAVY_ROWS) -> DataFrame:
    """edges(u, v) -> (u, root): the least id reachable, for every id that has a link and is not its own root.

    The edge list never grows. A hub's edges are summed before they are joined back, and the join splits a hub of more
    than `heavy` edges over all tasks. Each round is written to the shared folder, which cuts the lineage, and
    replaces the one before.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select("u", F.col("v").alias("root"))
        starred = _large(now, heavy)
        after = _small(starred, heavy)
        forget(now, starred)
        now = after
    raise RuntimeError("components did not settle")
