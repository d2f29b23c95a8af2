"""Parent-child links to full hierarchies.

The forest is cut into fragments of bounded size. Within a fragment every node follows its parents to the fragment's
*exit* (the first ancestor that lies in another fragment), to a root, or around a loop. Only the nodes that serve as an
exit for others remain: they form the quotient forest, which is smaller and is solved the same way, until it fits one
fragment. On the way back each node takes the path of its exit and appends its own fragment's part.

From the second level on, one child of every parent may be placed beside it: a node whose coin shows tails joins a parent
whose coin shows heads. So even a single chain loses a fixed fraction of its nodes at every level, and no fragment
gathers the children of a hub.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.functions.keys import clean_key
from polispark.operators.skew import skew_join
from polispark.session import durable

#: Rows that a fragment holds on average.
FRAGMENT_ROWS = 20_000

_OUT = "id string, parent string, exit_id string, root_id string, looped boolean, on_loop boolean, hops int, seg_min string, seg array<string>"


def _fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, seg_of = pdf["id"].tolist(), dict(zip(pdf["id"], (list(x) for x in pdf["seg"])))
    parent = {i: (p if isinstance(p, str) else None) for i, p in zip(ids, pdf["parent"])}
    low, size = dict(zip(ids, pdf["seg_min"])), dict(zip(ids, pdf["hops"]))
    term = {i: (r, bool(c)) for i, r, c in zip(ids, pdf["root_id"], pdf["looped"]) if isinstance(r, str)}
    done: dict[str, tuple] = {}  # exit, root, looped, on_loop, hops, seg
    for start in ids:
        chain, at, x = [], {}, start
        while x is not None and x in parent and x not in done and x not in at:
            at[x] = len(chain)
            chain.append(x)
            x = parent[x]
        if x is not None and x in at:
            loop = chain[at[x]:]
            least = min(low[m] for m in loop)
            for m in loop:
                done[m] = (None, least, True, True, int(size[m]), seg_of[m])
            chain = chain[: at[x]]
        elif chain and x is None:
            last = chain.pop()
            root, looped = term[last]
            done[last] = (None, root, looped, False, int(size[last]), seg_of[last])
        elif chain and x not in parent:
            last = chain.pop()
            done[last] = (x, None, False, False, int(size[last]), seg_of[last])
        for c in reversed(chain):
            up = done[parent[c]]
            done[c] = (up[0], up[1], up[2], False, up[4] + int(size[c]), [*up[5], *seg_of[c]] if seg_of[c] else [])
    # seg_min is needed of the part from the node up to the fragment's top
    lows: dict[str, str] = {}
    for start in ids:
        stack, x = [], start
        while x is not None and x in parent and x not in lows and not done[x][3]:
            stack.append(x)
            x = parent[x]
        best = lows.get(x) if x is not None and x in parent and not (x in done and done[x][3]) else None
        for c in reversed(stack):
            best = low[c] if best is None else min(best, low[c])
            lows[c] = best
    rows = [(i, parent[i], *done[i][:5], lows.get(i, low[i]), done[i][5]) for i in ids]
    return pd.DataFrame(rows, columns=["id", "parent", "exit_id", "root_id", "looped", "on_loop", "hops", "seg_min", "seg"])


def _placed(nodes: DataFrame, k: int, level: int) -> DataFrame:
    own = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(k))
    if level == 0 or k == 1:
        return nodes.withColumn("frag", own)
    chosen = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_chosen"))
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(level + 1000)), F.lit(2)) == 0
    beside = F.col("_chosen") & heads("parent") & ~heads("id")
    return nodes.join(chosen, "id", "left").withColumn("frag", F.when(beside, F.pmod(F.xxhash64("parent", F.lit(level)), F.lit(k))).otherwise(own)).drop("_chosen")


def _solve(nodes: DataFrame, rows: int, level: int, loops: list[DataFrame]) -> DataFrame:
    """nodes: id, parent (null at a terminal), root_id and looped (of terminals), hops, seg_min, seg; all solved."""
    n = nodes.count()
    k = max(1, math.ceil(n / rows))
    local = durable(_placed(nodes, k, level).groupBy("frag").applyInPandas(_fragment, _OUT), f"fragments{level}")
    loops.append(local.where("on_loop").select(F.explode("seg").alias("id"), F.col("root_id").alias("loop_id")))
    if k == 1:
        return local
    waiting = local.where(F.col("exit_id").isNotNull())
    exits = waiting.select(F.col("exit_id").alias("id")).distinct()
    quotient = local.join(exits, "id", "left_semi").select("id", F.col("exit_id").alias("parent"), "root_id", "looped", "hops", "seg_min", "seg")
    above = _solve(durable(quotient, f"quotient{level}"), rows, level + 1, loops)
    up = above.select(F.col("id").alias("exit_id"), F.col("root_id").alias("up_root"), F.col("looped").alias("up_looped"), F.col("hops").alias("up_hops"), F.col("seg").alias("up_seg"))
    below = skew_join(waiting, up, ["exit_id"], "inner")
    below = below.select("id", "parent", "exit_id", F.col("up_root").alias("root_id"), F.col("up_looped").alias("looped"), "on_loop", (F.col("hops") + F.col("up_hops")).alias("hops"), "seg_min", F.concat("up_seg", "seg").alias("seg"))
    return local.where(F.col("exit_id").isNull()).select(below.columns).unionByName(below)


def _nodes(edges: DataFrame, paths: bool) -> DataFrame:
    """Nodes with their parents; a parent that is no node counts as none."""
    edges = durable(edges, "edges")
    known = edges.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    nodes = skew_join(edges, known, ["parent"], "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"))
    return nodes.select("id", "parent", F.when(F.col("parent").isNull(), F.col("id")).alias("root_id"), F.lit(False).alias("looped"), F.lit(1).alias("hops"), F.col("id").alias("seg_min"), (F.array("id") if paths else F.array().cast("array<string>")).alias("seg"))


def resolve_roots(edges: DataFrame, rows: int = FRAGMENT_ROWS) -> DataFrame:
    """edges (id, parent; one row per id) -> id, root_id, in_loop.

    root_id is the last node reached by following parents: one with a null parent or one whose parent is no node. Where
    the chain never ends, it is the smallest id on the loop that it runs into, and in_loop is true. A node that is its own
    parent is a loop of one. An empty table gives an empty result. Ids are strings and not null.
    """
    solved = _solve(durable(_nodes(edges.select("id", "parent"), False), "nodes"), rows, 0, [])
    return solved.select("id", "root_id", F.col("looped").alias("in_loop"))


def resolve_hierarchy(edges: DataFrame, rows: int = FRAGMENT_ROWS) -> DataFrame:
    """edges (id, parent; one row per id) -> id, parent, root_id, depth, path, in_loop, on_loop.

    path runs from the root to the node, depth is 0 at a root. In a component with a loop, the members of the loop have
    depth 0 and a path of themselves; a node that hangs on the loop has the path from the member that it reaches first.
    root_id and the empty table are as in resolve_roots.
    """
    loops: list[DataFrame] = []
    nodes = durable(_nodes(edges.select("id", "parent"), True), "nodes")
    solved = durable(_solve(nodes, rows, 0, loops), "solved")
    members = loops[0]
    for x in loops[1:]:
        members = members.unionByName(x)
    members = durable(members, "loops")
    plain = solved.where(~F.col("looped")).select("id", "parent", "root_id", "hops", "seg", F.lit(False).alias("in_loop"), F.lit(False).alias("on_loop"))
    if members.limit(1).count():
        hung = solved.where("looped").select("id", "parent", "root_id").join(members, "id", "left")
        cut = hung.select("id", F.when(F.col("loop_id").isNull(), F.col("parent")).alias("parent"), F.col("loop_id").alias("root_id"), F.lit(True).alias("looped"), F.lit(1).alias("hops"), F.col("id").alias("seg_min"), F.array("id").alias("seg"))
        again = _solve(durable(cut, "cut"), rows, 0, [])
        true_parent = solved.select("id", F.col("parent").alias("true_parent"))
        again = again.join(true_parent, "id").join(members.select("id", F.lit(True).alias("_member")), "id", "left")
        plain = plain.unionByName(again.select("id", F.col("true_parent").alias("parent"), "root_id", "hops", "seg", F.lit(True).alias("in_loop"), F.coalesce("_member", F.lit(False)).alias("on_loop")))
    return plain.select("id", "parent", "root_id", (F.col("hops") - 1).alias("depth"), F.col("seg").alias("path"), "in_loop", "on_loop")


def descendants(resolved: DataFrame) -> DataFrame:
    """resolve_hierarchy's result -> ancestor_id, id, distance: every node below every other.

    A loop stands under its smallest id: that id has all other nodes of the component below it, at the distance to the
    loop (0 for the loop's members). Inside a tree the distance is the number of links.
    """
    up = resolved.select("id", "root_id", "in_loop", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    tree = up.where(F.col("ancestor_id") != F.col("id")).where(~F.col("in_loop") | (F.col("ancestor_id") != F.col("root_id")))
    tree = tree.select("ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))
    loop = resolved.where(F.col("in_loop") & (F.col("id") != F.col("root_id"))).select(F.col("root_id").alias("ancestor_id"), "id", F.col("depth").alias("distance"))
    return tree.unionByName(loop)


def current_agencies(agencies: DataFrame) -> DataFrame:
    """agencies -> id, parent, created_at of the current row of each id (latest updated_at; ties: greatest parent key).

    Rows without an id are left out; the parent key is cleaned.
    """
    rows = agencies.select(clean_key("id").alias("id"), clean_key("parent_agency_id").alias("parent"), "created_at", "updated_at").where(F.col("id").isNotNull())
    order = F.struct(F.col("updated_at"), F.coalesce("parent", F.lit("")), F.col("created_at"))
    return rows.groupBy("id").agg(F.max_by(F.struct("parent", "created_at"), order).alias("x")).select("id", "x.parent", "x.created_at")
