"""Joins with hot keys, connected components and words."""

import random

import pytest

from rolloom.functions.words import words
from rolloom.operators import skew
from rolloom.operators.components import components


def test_lookup_and_blocks_with_a_hot_key(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(6000)], "i int, k int")
    table = rows.groupBy("k").count().withColumnRenamed("count", "_n").selectExpr("k", "_n", "k * 2 as v")
    got = skew.lookup(rows, "k", table, "_n").collect()
    assert len(got) == 6000 and all(r.v == 2 * r.k for r in got)
    some = rows.unionByName(spark.createDataFrame([(-1, None), (-2, 7_000_000)], "i int, k int"))
    kept = skew.lookup(some, "k", table, "_n", "left").collect()
    assert len(kept) == 6002 and sorted(r.i for r in kept if r.v is None) == [-2, -1]
    assert skew.lookup(some, "k", table, "_n").count() == 6000 and skew.lookup(rows.where("false"), "k", table, "_n").count() == 0
    left, right = rows.selectExpr("k", "i as a"), rows.where("i < 300").selectExpr("k", "i as b")
    assert skew.pairs_in_blocks(left, right, "k", per=100).count() == left.join(right, "k").count()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)] + [(7, 7), (5000, 5000)] + [(2000, 2001 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in {y for link in links for y in link}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


@pytest.mark.parametrize("text,count", [("", 0), (None, 0), ("½ Ａb_c", 4)])
def test_words(text, count):
    assert len(words(text)) == count
