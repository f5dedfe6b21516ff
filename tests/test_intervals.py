import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import chains, consensus, greedy
from seqloom.operators import intervals as iv


def spans(rows, touch):
    """Loop model: (key, kind, start, end)."""
    out = []
    for k in sorted({r[0] for r in rows if None not in r}):
        cur = None
        for s, e in sorted((min(a, b), max(a, b)) for x, a, b in rows if x == k and a is not None and b is not None):
            if cur and s <= cur[1] + touch:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                out.append((k, "period", *cur))
                if s - 1 >= cur[1] + 1:
                    out.append((k, "gap", cur[1] + 1, s - 1))
            cur = [s, e]
        if cur:
            out.append((k, "period", *cur))
    return sorted(out)


@pytest.mark.parametrize("touch", [0, 1, 11])
@pytest.mark.parametrize("width", [7, 1 << 16])
def test_periods_against_loop(spark, touch, width):
    r = random.Random(touch * 100 + width)
    rows = [(r.choice("ab"), r.randint(1, 300), r.randint(1, 300)) for _ in range(20)]
    rows += [("c", s, s + r.randint(0, 9)) for s in r.sample(range(1, 3000), 150)] + [("d", 5, 5), ("d", 6, 6), ("d", 8, 8)]
    rows += rows[:5] + [(None, 1, 2), ("a", None, 3), ("a", 4, None)]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("kind", F.lit("clash")).withColumn("pos", F.lit(1))
    got = iv.periods_and_gaps(df, ["k"], "s", "e", touch, width).select("k", "kind", "span_start", "span_end")
    assert sorted(map(tuple, got.collect())) == spans(rows, touch)


def test_periods_empty_and_negative(spark):
    df = spark.createDataFrame([], "k string, s long, e long")
    assert iv.periods_and_gaps(df, ["k"], "s", "e").collect() == []
    df = spark.createDataFrame([("x", -10, -5), ("x", -4, 3)], "k string, s long, e long")
    assert [tuple(r) for r in iv.merged(df, ["k"], "s", "e").collect()] == [("x", -10, 3)]


def test_hot_entity_is_spread(spark):
    n = 4000
    df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 1).alias("e"))
    got = iv.periods_and_gaps(df, ["k"], "s", "e", 1, 100)
    assert got.filter("kind = 'period'").count() == n and got.filter("kind = 'gap'").count() == n - 1


def test_overlap_join_against_all_pairs(spark):
    r = random.Random(5)
    make = lambda: [(r.choice("ab"), i, (s := r.randint(0, 400)), s + r.randint(0, 90)) for i in range(60)]
    a, b = make(), make()
    left = spark.createDataFrame(a, "k string, i long, s long, e long")
    right = spark.createDataFrame(b, "k string, j long, s2 long, e2 long")
    got = iv.overlap_join(left, right, ["k"], "s", "e", "s2", "e2", width=32).select("i", "j").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    semi = iv.overlap_join(left, right, ["k"], "s", "e", "s2", "e2", width=32, how="left_semi").select("i").collect()
    anti = iv.overlap_join(left, right, ["k"], "s", "e", "s2", "e2", width=32, how="left_anti").select("i").collect()
    assert {x[0] for x in semi} == {i for i, _ in want} and {x[0] for x in anti} == {x[1] for x in a} - {i for i, _ in want}


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_cover_against_sets(spark, width):
    r = random.Random(width)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.choice([None, *range(1, 90)]), r.choice([None, *range(1, 90)])) for _ in range(120)] + [("hot", "x", 5, 60)] * 40
    df = spark.createDataFrame(rows, "name string, seq string, s long, e long").withColumn("_bkt", F.lit("clash"))
    want = {}
    for n, q, s, e in rows:
        c = want.setdefault(n, [0, set()])
        c[0] += 1
        if None not in (q, s, e):
            c[1] |= {(q, p) for p in range(min(s, e), max(s, e) + 1)}
    got = {x["name"]: (x.n, x.covered) for x in iv.covered_bases(df, ["name", "seq"], "s", "e", ["name"], "n", width).collect()}
    assert got == {k: (n, len(c)) for k, (n, c) in want.items()}
    alone = {(x["name"], x.seq): x.covered for x in iv.covered_bases(df, ["name", "seq"], "s", "e", width=width).collect()}
    assert alone == {(k, q): len({p for z, p in c if z == q}) for k, (_, c) in want.items() for q in {z for z, _ in c}}
    assert iv.covered_bases(df.limit(0), ["name", "seq"], "s", "e").collect() == []


@pytest.mark.parametrize("width", [8, 1 << 16])
def test_confusion_counts_bases(spark, width):
    r = random.Random(9)
    a = [("x", s, s + r.randint(0, 20)) for s in r.sample(range(200), 15)]
    b = [("x", s, s + r.randint(0, 20)) for s in r.sample(range(200), 15)]
    on = lambda t: {p for _, s, e in t for p in range(s, e + 1)}
    got = iv.confusion_bases(spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, s long, e long"), ["k"], "s", "e", width).collect()[0]
    assert (got.tp, got.fn, got.fp) == (len(on(a) & on(b)), len(on(a) - on(b)), len(on(b) - on(a)))


def test_greedy_keeps_first(spark):
    r = random.Random(3)
    rows = [("c", i, (s := r.randint(0, 500)), s + r.randint(1, 60)) for i in range(120)]
    kept = []
    for x in sorted(rows, key=lambda x: (x[2], x[3], x[1])):
        if not any(greedy.reciprocal(x[2:], y[2:], 0.6) for y in kept):
            kept.append(x)
    df = spark.createDataFrame(rows, "k string, id long, s long, e long")
    got = greedy.keep_first_overlapping(df, ["k"], "id", "s", "e", 0.6).collect()
    assert sorted(x.id for x in got) == sorted(x[1] for x in kept)


def test_chain_rules():
    hits = [(1, 100, 1, 100), (110, 200, 120, 210), (500, 600, 900, 1000), (210, 240, 230, 260)]
    assert sorted(chains.extend(hits, 50, True)) == [[1, 240, 1, 260, 3], [500, 600, 900, 1000, 1]]
    back = [(1, 100, 1000, 900), (110, 200, 890, 800)]
    assert chains.extend(back, 50, False) == [[1, 200, 1000, 800, 2]]


def test_chains_are_the_same_in_one_piece(spark):
    r = random.Random(4)
    rows = [("q", "s", (a := r.randint(1, 900)), a + r.randint(5, 90), (b := r.randint(1, 20000)), b + r.randint(5, 90)) for _ in range(150)]
    df = spark.createDataFrame(rows, "query string, subject string, q_start long, q_end long, s_start long, s_end long").withColumn("gap", F.lit(120).cast("long"))
    got = sorted(tuple(x)[3:] for x in chains.chain_hits(df, "gap").collect())
    assert got == sorted(map(tuple, chains.extend([x[2:] for x in rows], 120, True)))


def test_majority_prefers_first_seen(spark):
    df = spark.createDataFrame([("f", 1, "AC-T"), ("f", 2, "AG-T"), ("f", 3, "AG-A"), ("f", 4, "-C-A"), ("f", 5, None)], "family string, row long, seq string")
    assert consensus.majority(df).collect()[0].consensus == "A"
    assert consensus.boundary_consensus(df).collect()[0].consensus == "ACT"
    assert [x.seq for x in consensus.drop_sparse(df).orderBy("row").collect()] == ["ACT", "AGT", "AGA", "-CA"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 10), (10, 11), (20, 20)], "a long, b long")
    assert {tuple(r) for r in consensus.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (10, 7), (11, 7), (20, 20)}
