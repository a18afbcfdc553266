import random

from tesseraql.llm.components import components


def test_components(spark):
    rng = random.Random(8)
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7), (5, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loose = {a for a, b in edges if a == b}
    assert got == {n: find(n) for n in parent if n not in loose or n in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
