"""Components of chains and joined stars in many orders against union-find."""

import random

import pytest

from rollbook.llm.components import components


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def chain(order):
    return list(zip(order, order[1:]))


def joined_stars(names, first, second):
    """Two stars whose centres are names[0] and names[1], with one leaf in common."""
    return [(names[0], x) for x in names[2 : 2 + first]] + [(names[1], x) for x in names[1 + first : 1 + first + second]]


def cases():
    # a-u1-w-u2-b with a < b < w < u1 < u2: w is left with two lesser neighbours after a round
    yield chain([0, 3, 2, 4, 1])
    rng = random.Random(7)
    for n in (5, 6, 7, 7, 8, 8):
        yield chain(rng.sample(range(n), n))
    for n in (4, 5):
        yield joined_stars(rng.sample(range(2 * n + 1), 2 * n + 1), n, n)


@pytest.mark.parametrize("links", list(cases()))
def test_one_root_for_each_node(spark, links):
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == union_find(links)


def test_many_orders_together(spark):
    rng, links = random.Random(8), []
    for start in range(0, 20_000, 20):
        n = rng.randint(2, 12)
        links += chain([start + x for x in rng.sample(range(n), n)])
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == union_find(links)
