import random

import pytest

from polispark.operators import hierarchy as H


def brute(edges):
    """id -> (root, depth, path, in_loop, on_loop) by walking."""
    parent = {i: (p if p in edges else None) for i, p in edges.items()}
    out = {}
    for i in parent:
        path, seen, x = [i], {i}, i
        while parent[x] is not None and parent[x] not in seen:
            x = parent[x]
            seen.add(x)
            path.append(x)
        if parent[x] is None:
            out[i] = (x, len(path) - 1, path[::-1], False, False)
        else:
            entry = path.index(parent[x])
            root = min(path[entry:])
            hang = path[: entry + 1]
            out[i] = (root, len(hang) - 1, hang[::-1], True, entry == 0)
    return out


def forest(seed, n, chain=0.5):
    rng = random.Random(seed)
    ids = [f"n{i:04d}" for i in range(n)]
    edges = {}
    for k, i in enumerate(ids):
        r = rng.random()
        edges[i] = None if r < 0.05 or not k else "ghost" if r < 0.08 else ids[k - 1] if r < chain else ids[rng.randrange(k)] if r < 0.97 else rng.choice(ids)
    return edges


@pytest.mark.parametrize("seed,n,rows", [(1, 150, 20), (2, 150, 7), (3, 60, 1000), (4, 40, 5)])
def test_equals_walk(spark, seed, n, rows):
    edges = forest(seed, n)
    df = spark.createDataFrame(list(edges.items()), "id string, parent string")
    want = brute(edges)
    got = {r.id: (r.root_id, r.depth, list(r.path), r.in_loop, r.on_loop) for r in H.resolve_hierarchy(df, rows).collect()}
    assert got == want
    assert {r.id: (r.root_id, r.in_loop) for r in H.resolve_roots(df, rows).collect()} == {i: (w[0], w[3]) for i, w in want.items()}


def test_long_chain_and_star(spark):
    edges = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(120)} | {f"s{i:03d}": "c000" for i in range(80)}
    df = spark.createDataFrame(list(edges.items()), "id string, parent string")
    got = {r.id: r.depth for r in H.resolve_hierarchy(df, 25).collect()}
    assert got["c119"] == 119 and got["s000"] == 1 and len(got) == 200


def test_descendants(spark):
    edges = {"a": None, "b": "a", "c": "b", "x": "y", "y": "z", "z": "x", "w": "y", "v": "w", "self": "self"}
    df = spark.createDataFrame(list(edges.items()), "id string, parent string")
    rows = {tuple(r) for r in H.descendants(H.resolve_hierarchy(df, 2)).collect()}
    assert {r for r in rows if r[0] in "abc"} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {r for r in rows if r[0] == "x"} == {("x", "y", 0), ("x", "z", 0), ("x", "w", 1), ("x", "v", 2)}
    assert ("w", "v", 1) in rows and not [r for r in rows if r[0] == "self"]


def test_empty_and_dirty(spark):
    none = spark.createDataFrame([], "id string, parent string")
    assert H.resolve_hierarchy(none).count() == 0 and H.resolve_roots(none).count() == 0
    rows = [
        ("A1", " B2 ", "2020-01-01", "2020-01-01"), ("a1 ", None, "2020-01-01", "2019-01-01"), ("b2", "", "2020-01-01", "2020-01-01"),
        ("b2", "", "2020-01-01", "2020-01-01"), (None, "a1", "2020-01-01", "2020-01-01"),
    ]
    df = spark.createDataFrame(rows, "id string, parent_agency_id string, created_at string, updated_at string").selectExpr("id", "parent_agency_id", "timestamp(created_at) created_at", "timestamp(updated_at) updated_at", "'x' AS parent", "1 AS frag")
    got = {r.id: r.parent for r in H.current_agencies(df).collect()}
    assert got == {"a1": "b2", "b2": ""}
    assert {r.id: r.root_id for r in H.resolve_roots(H.current_agencies(df)).collect()} == {"a1": "b2", "b2": "b2"}
