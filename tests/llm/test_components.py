"""Components against a plain union of sets."""

import random

from textward.llm.components import components, contracted


def roots(edges):
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above}


def graphs():
    rng = random.Random(7)
    chain = list(range(-30, 31))
    rng.shuffle(chain)
    star = [(500, 501 + i) for i in range(40)]
    scattered = [(rng.randrange(1000, 1120), rng.randrange(1000, 1120)) for _ in range(60)]
    return list(zip(chain, chain[1:], strict=False)) + star + star[:5] + scattered


def test_components_equal_a_plain_union_of_sets(spark):
    edges = [e for e in graphs() if e[0] != e[1]]
    random.Random(3).shuffle(edges)
    for parts in (1, 6):
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
        assert len(found) == len({r["v"] for r in found})
        assert {r["v"]: r["root"] for r in found} == roots(edges)


def test_a_contraction_in_small_portions_connects_the_same_vertices(spark):
    edges = [(max(e), min(e)) for e in graphs() if e[0] != e[1]]
    for most in (4, 50, 1 << 20):
        kept = [tuple(r) for r in contracted(spark.createDataFrame(edges, "u long, v long").coalesce(2), most).collect()]
        assert all(u > v for u, v in kept) and len(kept) <= len(edges)
        assert roots(kept) == roots(edges)


def test_a_table_without_edges_has_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_are_settled_without_rounds_and_many_by_them(spark, monkeypatch):
    from textward.llm import components as module

    edges = [e for e in graphs() if e[0] != e[1]]
    saved, save = [], module.save
    monkeypatch.setattr(module, "save", lambda df: saved.append(1) or save(df))
    for few, least, most in ((1 << 20, 1, 2), (10, 3, 99)):
        saved.clear()
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(6), few).collect()
        assert {r["v"]: r["root"] for r in found} == roots(edges) and len(found) == len(roots(edges))
        assert least <= len(saved) <= most
