"""Operators on the typed connection graph: edges (id, from_type, from_id, to_type, to_id, connection_type, ...)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polispark.operators.skew import skew_join
from polispark.session import durable

#: Nodes that a lookup lists in its filter; beyond it, the edges are joined with them.
LISTED = 5_000
#: Neighbours with so many edges are shown collapsed and are not expanded.
HUB = 50


def ends(edges: DataFrame) -> DataFrame:
    """One row per edge and end: node, nbr, and the edge's id. A loop counts twice."""
    both = F.array(F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("nbr")), F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("nbr")))
    return edges.select("id", F.inline(both))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree, donations, votes: edges at each node, partially aggregated before the shuffle."""
    both = F.array(F.col("from_id"), F.col("to_id"))
    kind = F.col("connection_type")
    return edges.select(F.explode(both).alias("node"), (kind == "donation").cast("int").alias("d"), kind.startswith("vote").cast("int").alias("v")).groupBy("node").agg(F.count("*").alias("degree"), F.max("d").alias("has_donations"), F.max("v").alias("has_votes"))


def at_any(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Edges with an end among few ids: one scan, whose filter reaches the files."""
    return edges.where(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in nodes (node), each once. Up to LISTED nodes are looked up by a filter, more of them are joined."""
    ids = nodes.select("node").where("node IS NOT NULL").distinct()
    few = ids.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return at_any(edges, [r.node for r in few])
    ids = durable(ids, "ids")
    a = skew_join(edges, ids.withColumnRenamed("node", "from_id"), ["from_id"], "left_semi")
    b = skew_join(edges, ids.withColumnRenamed("node", "to_id"), ["to_id"], "left_semi")
    return a.unionByName(b).dropDuplicates(["id"])


def ego_one(edges: DataFrame, node: str, latest_votes: int = 50) -> DataFrame:
    """All edges at a node, but of its votes only the latest (dated before undated, then by id)."""
    own = edges.where((F.col("from_id") == node) | (F.col("to_id") == node))
    vote = F.col("connection_type").startswith("vote")
    return own.where(~vote).unionByName(own.where(vote).orderBy(F.col("occurred_at").desc_nulls_last(), "id").limit(latest_votes))


def ego_two(edges: DataFrame, node: str, latest_votes: int = 50, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Edges up to two hops, and the neighbours (node, degree, collapsed): hubs are collapsed, not expanded."""
    first = durable(ego_one(edges, node, latest_votes), "ego")
    nbrs = ends(first).where((F.col("node") == node) & (F.col("nbr") != node)).select(F.col("nbr").alias("node")).distinct()
    near = touching(edges, nbrs)
    deg = degree(near.select("id", "from_id", "to_id", "connection_type")).join(nbrs, "node", "left_semi").select("node", "degree", (F.col("degree") >= hub).alias("collapsed"))
    open_ = durable(deg, "neighbours")
    second = touching(edges, open_.where("not collapsed").select("node"))
    return first.unionByName(second).dropDuplicates(["id"]), open_


def top_connected(edges: DataFrame, n: int = 10, only: Column | None = None) -> DataFrame:
    """The n nodes with most edges; ties by id. They are computed once and listed: n is small."""
    deg = degree(edges)
    top = (deg.where(only) if only is not None else deg).orderBy(F.desc("degree"), "node").limit(n)
    return edges.sparkSession.createDataFrame(top.collect(), top.schema)


class _Level:
    """Nodes of one hop: listed while they are few, else a written table."""

    def __init__(self, nodes: DataFrame, ids: list[str] | None = None):
        if ids is None:
            few = nodes.limit(LISTED + 1).collect()
            ids = [r.node for r in few] if len(few) <= LISTED else None
        self.ids = ids
        self.df = nodes.sparkSession.createDataFrame([(x,) for x in ids], "node string") if ids is not None else durable(nodes, "level")
        self.size = len(ids) if ids is not None else self.df.count()

    def touching(self, edges: DataFrame) -> DataFrame:
        return at_any(edges, self.ids) if self.ids is not None else touching(edges, self.df)

    def within(self, nodes: DataFrame) -> _Level:
        """Those of its nodes that are in nodes, too."""
        return _Level(self.df.join(nodes.select("node").distinct(), "node", "left_semi"))


def shortest_path(edges: DataFrame, start: str, goal: str, max_hops: int = 6) -> DataFrame:
    """hop, node, edge_id of the shortest path, empty if there is none within max_hops.

    Both ends are searched in turn, the smaller frontier first, until they meet; every frontier is looked up (touching), none
    is paired with all edges, and a round that is not listed is written. Of several paths it is the one whose first nodes are smallest, of
    several edges the smallest id. edge_id leads to the node; it is null at the start. A start that is the goal is a path of one.
    """
    spark = edges.sparkSession
    schema = "hop int, node string, edge_id string"
    if start == goal:
        return spark.createDataFrame([(0, start, None)], schema)
    edges = edges.select("id", "from_id", "to_id")
    none = spark.createDataFrame([], "node string")
    beside = lambda level: ends(level.touching(edges)).select(F.col("nbr").alias("node")).where("node IS NOT NULL").distinct()
    sides = [[_Level(none, [x])] for x in (start, goal)]
    for _ in range(max_hops):
        side = 0 if sides[0][-1].size <= sides[1][-1].size else 1
        own, other = sides[side], sides[1 - side][-1]
        seen = functools.reduce(DataFrame.unionByName, [x.df for x in own])
        own.append(_Level(beside(own[-1]).join(seen, "node", "left_anti")))
        if not own[-1].size:
            return spark.createDataFrame([], schema)
        both = (own[-1].ids, other.ids)
        meet = _Level(none, sorted(set(both[0]) & set(both[1]))) if None not in both else own[-1].within(other.df)
        if meet.size:
            break
    else:
        return spark.createDataFrame([], schema)
    levels = [meet]  # nodes on shortest paths, by hop: back to the start, then on to the goal
    for level in reversed(sides[0][1:-1]):
        levels.insert(0, level.within(beside(levels[0])))
    out, at = [(0, start, None)], start
    for level in [*levels, *reversed(sides[1][:-1])]:
        step = ends(at_any(edges, [at])).where(F.col("node") == at)
        row = step.join(level.df.select(F.col("node").alias("nbr")), "nbr", "left_semi").agg(F.min(F.struct("nbr", "id")).alias("by")).first().by
        out.append((out[-1][0] + 1, row.nbr, row.id))
        at = row.nbr
    return spark.createDataFrame(out, schema)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group in the given order, which must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with from_label and to_label of nodes (type, id, label; unique); 'Unknown <type>' where there is none.

    Heavy ends are sought in the edges as they are scanned, so the first join is not computed for the second.
    """
    out = edges
    for end in ("from", "to"):
        names = nodes.select(F.col("type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
        out = skew_join(out, names, [f"{end}_type", f"{end}_id"], "left", sketch=edges)
        out = out.withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.concat(F.lit("Unknown "), F.col(f"{end}_type"))))
    return out


def merge(graphs: list[DataFrame]) -> DataFrame:
    """Edges of several graphs, each triple (from, to, type) once: the one with the smallest id."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    keep = out.groupBy("from_id", "to_id", "connection_type").agg(F.min_by(F.struct(*out.columns), "id").alias("e"))
    return keep.select("e.*")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges none of whose ends is in removed (node). Up to LISTED nodes are a filter, more of them are joined."""
    ids = removed.select("node").where("node IS NOT NULL").distinct()
    few = ids.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        gone = [r.node for r in few]
        return edges.where(F.coalesce(~F.col("from_id").isin(gone), F.lit(True)) & F.coalesce(~F.col("to_id").isin(gone), F.lit(True)))
    ids = durable(ids, "ids")
    a = skew_join(edges, ids.select(F.col("node").alias("from_id")), ["from_id"], "left_anti", sketch=edges)
    return skew_join(a, ids.select(F.col("node").alias("to_id")), ["to_id"], "left_anti", sketch=edges)
