"""Connected components against a union-find."""
import random

from carelens.llm.graphs import connected_components


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_chain_star_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)]
    links += [(1000, 1000 + i) for i in range(1, 50)]
    links += [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(70)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = {k: v for k, v in union_find([x for x in links if x[0] != x[1]]).items()}
    assert got == want


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
