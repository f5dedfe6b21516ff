"""Whole jobs where less was done before."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations, islice
from statistics import mean, stdev

import numpy as np
import pandas as pd
import pytest

from seqloom.functions import search, stats
from seqloom.operators import consensus, rowwise, seeds
from seqloom.queries import all_queries, families
from seqloom.streaming import chunks


def test_ingest_keeps_late_and_undated_rows(spark):
    """Twelve files, three batches: arrival times fall from file to file, every seventh is null, each id comes twice."""
    at = lambda i: None if i % 7 == 0 else datetime(2025, 1, 1) - timedelta(days=i)
    rows = [(i % 600, "g", at(i)) for i in range(1200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "copy_id long, genome string, loaded_at timestamp")
    got = [r[0] for r in chunks.ingest_once(df, "copy_id").select("copy_id").collect()]
    assert sorted(got) == list(range(600))


def _genomes(spark, path, n):
    """``n`` genomes; family ``i`` is in every genome from number ``i`` on, so that later genomes have more."""
    names = [f"g{i:02d}" for i in range(n)]
    spark.createDataFrame([(g,) for g in names], "genome string").write.parquet(f"{path}/genomes.parquet")
    rows = [(f"f{i}", names[j]) for i in range(n) for j in range(i, n)]
    spark.createDataFrame(rows, "te_name string, genome string").write.parquet(f"{path}/te_copies.parquet")
    return str(path)


@pytest.mark.parametrize("n", [24, 100])
def test_pan_curve_and_fits_take_a_thousand_subsets(spark, tmp_path, n):
    d = _genomes(spark, tmp_path, n)
    want = {}
    for k in range(1, n + 1):
        subs = list(islice(combinations(range(n), k), 1000))
        pan, core = [s[-1] + 1 for s in subs], [s[0] + 1 for s in subs]
        want[k] = tuple(round(f(x), 2) if f is mean or len(x) > 1 else None for x in (pan, core) for f in (mean, stdev))
    got = {r[0]: tuple(r)[1:] for r in all_queries()["pan_a13_curve"](spark, d).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=0.011), k
    kinds = {r.family: (r.n_genomes, r.category) for r in all_queries()["pan_a15_categories"](spark, d).collect()}
    for i in range(n):
        c = n - i
        assert kinds[f"f{i}"] == (c, "core" if c == n else "softcore" if c >= 0.8 * n else "dispensable" if c >= 2 else "private")
    if n == 24:
        fit = all_queries()["pan_a14_fits"](spark, d).first()
        x = sorted(got)
        power, decay = stats.fit_power(x, [got[k][0] for k in x]), stats.fit_decay(x, [got[k][2] for k in x])
        assert tuple(fit) == pytest.approx([round(v, 4) for v in (*power, *decay)])


def _alignment(spark, path):
    """Rows of very different lengths, some with gaps and one empty, written as sequences; returned padded."""
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        base = "".join(rng.choice("ACGT") for _ in range(150))
        for n in (150, 130, 130, 90, 0, 70, 149):
            rows.append((len(rows), g, "".join(c if rng.random() < 0.8 else rng.choice("ACGTN") for c in base[:n])))
    t = spark.createDataFrame([(i, f"c{i}", g, q) for i, g, q in rows], "seq_id long, chrname string, genome string, chrseq string")
    t.write.parquet(f"{path}/sequences.parquet")
    return {g: {i: q.replace("N", "-").ljust(150, "-") for i, x, q in rows if x == g} for g in ("a", "b")}


def test_alignments_of_whole_rows(spark, tmp_path):
    families, d = _alignment(spark, tmp_path), str(tmp_path)
    run = lambda name: all_queries()[name](spark, d).collect()
    comp, majority, boundary, sparse, pixels = {}, {}, {}, {}, {}
    for g, rows in families.items():
        total, major, bound, keep = len(rows), "", "", []
        for c in range(150):
            n = Counter(s[c] for s in rows.values())
            first = {b: min(i for i, s in rows.items() if s[c] == b) for b in n}
            comp |= {(g, c, b): (n[b], first[b]) for b in n}
            order = sorted(n, key=lambda b: (-n[b], first[b]))
            letter = next((b for b in order if b != "-"), "")
            major += letter if letter and n[letter] > total // 2 else ""
            bound += order[0].replace("-", "") if n[order[0]] >= total // 2 else letter
            if n["-"] <= total / 2:
                keep.append(c)
            letters = sum(k for b, k in n.items() if b != "-")
            for i, s in rows.items():
                b = s[c]
                if b != "-":
                    pixels[g, i, c] = (100, 100 * n[b] // letters, {"G": 100, "C": 75, "A": 50, "T": 25}[b])
        majority[g], boundary[g] = major, bound
        sparse |= {(g, i): "".join(s[c] for c in keep) for i, s in rows.items()}
    assert len(majority["a"]) > 60
    assert {(r.family, r.col, r.base): (r.n, r.first_row) for r in run("agg_a18_composition")} == comp
    assert {r.family: r.consensus for r in run("agg_a19_majority")} == majority
    assert {r.family: r.consensus for r in run("agg_a20_boundary_consensus")} == boundary
    assert {(r.family, r.row): r.seq for r in run("re_r6_sparse_columns")} == sparse
    assert {(r.family, r.row, r.col): (r.block, r.support, r.code) for r in run("fn_f43_pixels") if r.block} == pixels


def test_homology_boundary_beyond_forty_columns(spark, tmp_path):
    """Two near copies that agree from column 60 on only."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    same = word(300)
    other = word(60).translate(str.maketrans("ACGT", "CGTA"))
    rows = [(1, other + same), (2, other.translate(str.maketrans("ACGT", "CGTA")) + same + word(20))]
    t = spark.createDataFrame([(i, f"c{i}", "g", q) for i, q in rows], "seq_id long, chrname string, genome string, chrseq string")
    t.write.parquet(f"{tmp_path}/sequences.parquet")
    assert [r.boundary for r in all_queries()["win_w7_homology_boundary"](spark, str(tmp_path)).collect()] == [60]


def test_alignment_scores_reach_the_middle(spark, tmp_path):
    """A repeat of 90 letters around the middle, far from both ends, and texts of one to three letters."""
    same = "".join(random.Random(7).choice("ACGT") for _ in range(90))
    rows = ["A" * 100 + same + same + "C" * 100, "A", "AC", "CAC"]
    t = spark.createDataFrame([(i, f"c{i}", "g", q) for i, q in enumerate(rows)], "seq_id long, chrname string, genome string, chrseq string")
    t.write.parquet(f"{tmp_path}/sequences.parquet")
    got = {r.seq_id: tuple(r)[1:] for r in all_queries()["v17_alignment_scores"](spark, str(tmp_path)).collect()}
    assert got[0][1] == got[0][3] == 90
    assert {i: got[i] for i in (1, 2, 3)} == {1: (-1, 0, 0, 0), 2: (-1, 0, 0, 0), 3: (0, 1, 1, 1)}


def test_alignment_scores_of_many_and_of_long_pairs():
    """Pairs of all lengths at once give the scores of the row by row form, far faster."""
    rng = random.Random(8)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.randrange(70), x), word(rng.randrange(70), x)) for x in ("A", "ACGT", "ACGTN-*", "".join(map(chr, range(60, 140)))) for _ in range(40)]
    same = word(1800)
    pairs += [(same, same), (same[:1500], word(1500)), (word(900), same), ("", "A"), ("AC", "GT")]  # scores over 255
    assert search.both_scores(pairs) == [(search.align(a, b), search.align(a, b, local=True)) for a, b in pairs]
    assert [search.common_length(a, b) for a, b in pairs] == [search.align(a, b, 1, 0, 0) if a and b else 0 for a, b in pairs]
    for a, b in pairs[:160]:
        assert search.common_length(a, b, True) == max((k for k in range(71) if {a[i : i + k] for i in range(len(a) - k + 1)} & {b[i : i + k] for i in range(len(b) - k + 1)}), default=0)
    assert search.common_length(same + "A" * 50, "C" + same, True) == 1800
    pairs = [(word(600), word(600)) for _ in range(150)]
    began = time.process_time()
    got = search._pair_scores(*(pd.Series(x) for x in zip(*pairs)))
    spent = time.process_time() - began
    began = time.process_time()
    assert [(search.align(a, b), search.align(a, b, local=True)) for a, b in pairs[:30]] == list(zip(got.global_score[:30], got.local_score[:30]))
    assert spent < 2.5 * (time.process_time() - began)  # all four of five times the pairs


def test_shared_words_of_wanted_sequences_only(spark, tmp_path, monkeypatch):
    """Copies, a word of 40 letters in all sequences, and letters that are no bases: pairs of a subject that can have enough words are counted, no others."""
    rng = random.Random(9)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    common, whole, other = word(40), word(400), word(300, "ACGT*-é")
    rows = [word(100) + common + word(rng.randrange(300)) for _ in range(40)] + [whole, whole[:250], whole[100:] + "N" + common, common + word(30), other, other[50:200], "A" * 90, "A" * 100, "ACGT" * 3]
    need = lambda q: max(10, (len(q) + 1) // 2 - 15)
    words = [{q[p : p + 16] for p in range(len(q) - 15) if "N" not in q[p : p + 16]} for q in rows]
    want = {(5 * i, 5 * j): n for i, x in enumerate(words) for j, y in enumerate(words) if i != j and (n := len(x & y)) >= need(rows[i])}
    t = spark.createDataFrame([(5 * i, q, need(q)) for i, q in enumerate(rows)], "seq_id long, q string, need int")
    assert {(r.subject, r.query): r.seeds for r in seeds.subject_pairs(t).collect()} == want and len({i for i, _ in want}) < 10
    monkeypatch.setattr(seeds, "PAIRS", 3)
    size, ids = np.array([3, 2, 4], np.int32), np.array([5, 7, 9, 7, 9, 1, 5, 7, 9])
    got = Counter()
    for a, b, n in seeds._met(size, ids, np.array([7, 8])):
        got.update({(int(x), int(y)): int(z) for x, y, z in zip(a, b, n)})
    assert got == {(7, 5): 2, (7, 9): 3, (7, 1): 1}


def test_more_letters_than_words_as_numbers_have(spark):
    q = "".join(map(chr, range(0x100, 0x170)))
    t = spark.createDataFrame([(1, q), (2, q[10:]), (3, "ACGT" * 30)], "seq_id long, q string")
    assert {(r.name, r.cluster) for r in families.identity_clusters(t).collect()} == {("1", "1"), ("2", "1"), ("3", "3")}


def test_columns_by_rows(spark):
    """Random alignments of one to 40 rows give what the counted columns give; letters are never rows of a table."""
    rng = random.Random(10)
    rows = []
    for f in range(30):
        base = "".join(rng.choice("ACGT-") for _ in range(rng.randrange(1, 120)))
        for _ in range(rng.choice((1, 2, 3, 7, 12, 40))):
            rows.append((f, len(rows) * 7 % 1009, "".join(c if rng.random() < 0.9 else rng.choice("ACGT-*é") for c in base[: rng.randrange(len(base) + 1) or None])))
    rows += [(30, 1, None), (31, 2, "")]
    t = spark.createDataFrame(rows, "family int, row long, seq string").repartition(3)
    new = rowwise.majority(t)
    assert "Generate" not in new._jdf.queryExecution().toString()
    assert sorted(new.collect()) == sorted(consensus.majority(t, ragged=True).collect())
    for width in (3, 5):
        got = sorted(rowwise.homology_boundary(t, width).collect())
        assert got == sorted(consensus.homology_boundary(t, width, ragged=True).collect()) and len(got) > 5


def test_homology_boundary_makes_no_row_for_each_letter(spark, data):
    t = all_queries()["win_w7_homology_boundary"](spark, data)
    assert "Generate" not in t._jdf.queryExecution().toString()
    assert t.count() > 10
