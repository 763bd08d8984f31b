import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reprise.llm import components as C


def roots(spark, edges):
    return {r["id"]: r["root_id"] for r in C.connected_components(spark.createDataFrame([(a, b, 0, "x") for a, b in edges], "a bigint, b bigint, root_id int, v string")).collect()}


def union(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def test_shapes(spark):
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(100, k) for k in range(101, 160)]
    edges = [*chain, *star, (5, 5), (7, None), (None, 8), (1, 2), (2, 1), (300, 200)]
    assert roots(spark, edges) == union(edges)
    assert roots(spark, []) == {}
    assert roots(spark, [(4, 4), (None, None)]) == {}


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (200, 150), (60, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert roots(spark, edges) == union(edges)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_order_does_not_matter(spark, edges):
    assert roots(spark, edges) == roots(spark, edges[::-1]) == union(edges)


def test_links_are_stars(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (1, None), (None, 9), (2, 4)], "g bigint, i bigint")
    assert sorted(map(tuple, C.group_links(rows, "g", "i").collect())) == [(3, 5)]


@pytest.mark.parametrize("name", list(C.ORACLES))
def test_sql(spark, agree, small, name):
    agree(spark, C.QUERIES[name], C.ORACLES[name], small)


def test_a_hot_vertex_is_split(spark, split_plans):
    """Half of all links at one vertex: adaptive execution splits its cluster in the join."""
    hot = spark.range(1, 40_000).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    links = hot.unionByName(spark.range(40_000, 120_000, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert split_plans(lambda: C.connected_components(links).count()) > 0
