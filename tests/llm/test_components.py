import random

from tidemark.llm.components import components


def brute(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for e in edges for x in e}


def test_matches_brute_force(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, k) for k in range(5001, 5100)]
    for edges in ([(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + chain + star, [(3, 1)], [(1, 2), (2, 1)]):
        edges = [(a, b) for a, b in edges if a != b]
        got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (7, 7)] if len(edges) > 9 else edges, "a long, b long")).collect()}
        assert got == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
