"""Values carried over buckets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import running as rn


def rows(seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), i * 3, r.choice([None, *range(9)]), r.randint(0, 4)) for i in r.sample(range(200), 120)]


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_running_against_loop(spark, width):
    data = rows(width)
    df = spark.createDataFrame(data, "k string, o long, v long, w long").withColumn("_x", F.lit("clash"))
    got = {x.o: (x.m, x.s, x.l, x.n) for x in rn.running(df, ["k"], "o", {"m": ("max", F.col("v")), "s": ("sum", F.col("w")), "l": ("last", F.col("v")), "n": ("sum", F.lit(1))}, width=width).collect()}
    want = {}
    for k, o, _, _ in data:
        before = sorted((x for x in data if x[0] == k and x[1] < o), key=lambda x: x[1])
        known = [x[2] for x in before if x[2] is not None]
        want[o] = (max(known, default=None), sum(x[3] for x in before), known[-1] if known else None, len(before))
    assert got == want


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_following_and_numbers_with_ties(spark, width):
    r = random.Random(width)
    data = [(r.choice("ab"), r.randint(0, 40), i) for i in range(90)]
    df = spark.createDataFrame(data, "k string, o long, id long")
    order = {k: sorted(x[1:] for x in data if x[0] == k) for k in "ab"}
    got = {x.id: x.nxt for x in rn.following(df, ["k"], "o", F.col("id"), "nxt", ["id"], width).collect()}
    assert got == {a[1]: b[1] if b else None for v in order.values() for a, b in zip(v, [*v[1:], None])}
    got = {x.id: x.n for x in rn.numbered(df, ["k"], "o", "n", ["id"], width).collect()}
    assert got == {x[1]: i for v in order.values() for i, x in enumerate(v)}
    assert rn.numbered(df.limit(0), ["k"], "o", "n").collect() == []


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_by_key(spark, block):
    """Every pair of every key once, with the columns of both rows; hot keys, keys of one row, null keys and ids."""
    from seqloom.operators.pairs import pairs_by_key

    r = random.Random(block)
    data = [(i, k, f"{i}/{k}") for k in range(6) for i in r.sample(range(80), [1, 2, 5, 30, 40, 60][k])] + [(1, None, "x"), (2, None, "x"), (None, 3, "x")]
    df = spark.createDataFrame(data, "id long, key long, v string")
    got = [tuple(x) for x in pairs_by_key(df, ["key"], "id", ["v"], block).select("key", "a", "b", "v_a", "v_b").collect()]
    want = {(k, a, b, u, v) for a, k, u in data for b, q, v in data if None not in (a, b, k) and k == q and a < b}
    assert len(got) == len(set(got)) and set(got) == want
