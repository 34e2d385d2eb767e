"""Connected components, and their joining by later links, against a plain union-find."""

import random

from plumbline.llm.common import Scratch
from plumbline.llm.components import connected_components
from plumbline.llm.near_copies import _joined

EDGES = "u bigint, v bigint"


def plain(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {i: find(i) for u, v in edges if u != v for i in (u, v)}


def got(df):
    rows = [tuple(r) for r in df.select("node", "root").collect()]
    assert len(rows) == len({n for n, _ in rows})
    return dict(rows)


def some_edges():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    rng.shuffle(chain)
    star = [(5000, 5000 + i) for i in range(1, 30)] + [(6000 + i, 6500) for i in range(30)]
    loose = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(120)]
    return chain + star + loose + loose[:10] + [(7, 7), (9999, 9999)]


def test_components_of_chains_stars_loops_and_repeats(spark):
    edges = some_edges()
    assert got(connected_components(spark.createDataFrame(edges, EDGES), Scratch(spark, "cc"))) == plain(edges)
    assert got(connected_components(spark.createDataFrame([], EDGES), Scratch(spark, "cc"))) == {}


def test_later_links_join_components(spark):
    edges, links = some_edges(), [(1003, 6020), (6500, 5001), (20000, 20001), (20001, 6010), (1040, 30000), (1003, 6020), (41, 40000)]
    scratch = Scratch(spark, "cc")
    root = scratch.keep(connected_components(spark.createDataFrame(edges, EDGES), scratch), "roots")
    assert got(_joined(root, spark.createDataFrame(links, EDGES), scratch)) == plain(edges + links)
    none = scratch.keep(spark.createDataFrame([], "node bigint, root bigint"), "none")
    assert got(_joined(none, spark.createDataFrame(links, EDGES), scratch)) == plain(links)
