import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import search
from seqloom.functions import sequence as sq
from seqloom.functions import stats

DNA = st.text("ACGT", max_size=30)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=4, max_size=8), DNA)
def test_fuzzy_spans_are_near(p, t):
    got = search.fuzzy_spans(p, t, 1)
    assert all(edits(p, t[a:b]) == d <= 1 for a, b, d in got)
    near = any(edits(p, t[a:b]) <= 1 for a in range(len(t) + 1) for b in range(a, len(t) + 1))
    assert bool(got) == near


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_alignment_scores(a, b):
    def slow(local):
        best, t = 0, {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                o = [0] if i == j == 0 or local else []
                if i and j:
                    o.append(t[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1))
                if i:
                    o.append(t[i - 1, j] - 1)
                if j:
                    o.append(t[i, j - 1] - 1)
                t[i, j] = max(o)
                best = max(best, t[i, j])
        return best if local else t[len(a), len(b)]

    assert search.align(a, b) == slow(False) and search.align(a, b, local=True) == slow(True)
    subs = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1)]
    assert search.common_length(a, b, True) == max([len(s) for s in subs if s in b], default=0)


def test_sequence_functions_on_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("A",), ("acgtn",), ("ACGTACGTAAAAAA",)], "s string")
    got = df.select(sq.reverse_complement("s").alias("r"), F.size(sq.words("s", 4)).alias("n"), sq.near_poly_tail("s").alias("p"), sq.tail_run_end("s", "A").alias("e"), F.size(sq.one_hot("s", 3)).alias("h")).collect()
    assert [x.r for x in got] == [None, "", "T", "NACGT", "TTTTTTACGTACGT"]
    assert [x.n for x in got][1:] == [0, 0, 2, 11] and [x.p for x in got] == [False, False, False, False, True]
    assert got[4].e == 14 and got[3].e == -1 and got[2].h == 12
    x = spark.createDataFrame([("ACGTTTTTACGT", 5, 8)], "s string, a int, b int").select(sq.aligned_site("s", "a", "b").alias("site")).collect()[0]
    assert x.site is None or len(x.site) >= 2


def test_student_and_adjustment(spark):
    p = stats.t_two_sided(np.array([2.0, 0.0, 12.706, np.nan]), np.array([10.0, 5.0, 1.0, 3.0]))
    assert p[0] == pytest.approx(0.07338803, abs=1e-7) and p[1] == pytest.approx(1.0) and p[2] == pytest.approx(0.05, abs=1e-5) and np.isnan(p[3])
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.04)], "i long, p double").withColumn("g", F.lit("x"))
    got = {r.i: r.p_adjusted for r in stats.benjamini_hochberg(df, ["g"], "p").collect()}
    assert got[1] == pytest.approx(0.04) and got[2] == got[5] == pytest.approx(0.04) and got[3] == pytest.approx(0.04) and got[4] is None


def test_fits():
    x = np.arange(1, 20)
    assert stats.fit_power(x, 3 * x**0.5) == pytest.approx((3, 0.5))
    a, b, c = stats.fit_decay(x, 50 * np.exp(-0.3 * x) + 7)
    assert (a, b, c) == pytest.approx((50, 0.3, 7), rel=1e-3)


def test_longest_tail_repeat():
    r = random.Random(1)
    assert search.longest_tail_repeat("GG" + "ACG" * 4) == ("ACG", 14)
    assert search.longest_tail_repeat("A") == (None, -1)
    for _ in range(50):
        s = "".join(r.choice("AC") for _ in range(30))
        unit, end = search.longest_tail_repeat(s)
        assert unit is None or s[:end].endswith(unit * 2)
