from pyspark.sql import functions as F

from seqloom.operators import rejects, skew
from seqloom.sources import lines as ln

GOOD_TE = ["c1\t1\t20\t+\tn\tf\tc\t5", "c.1\t0\t9\tC\tn x\t\t\t.", 'c\t1\t2\t-\t"a\tb ""q"""\tf\tc\t7', "c\t1\t2\t-\tn\tf\tc\t7\r", f"c\t{'9' * 30}\t1{'0' * 30}\t+\tn\tf\tc\t1"]
BAD_TE = ["c 1\t1\t20\t+\tn\tf\tc\t5", "c\t20\t20\t+\tn\tf\tc\t5", "c\t1\t2\t.\tn\tf\tc\t5", "c\t1\t2\t+\t\tf\tc\t5", "c\t1\t2\t+\tn\tf\tc", "c\t1\t2\t+\tn\tf\tc\t5\t", 'c\t1\t2\t+\tn"x\tf\tc\t5', 'c\t1\t2\t+\t"n\tf\tc\t5', "c\t+1\t2\t+\tn\tf\tc\t5", "c\t1\t2\t+\tn\tf\tc\t5\r\r", "c\t1\t٢\t+\tn\tf\tc\t5"]
HEAD = "10 1.5 0 100 s1 5 9 (3) "
GOOD_OUT = [HEAD + "+ e c 1 5 (2) 7", "  " + HEAD + "C e c (2) 5 1 7 *", HEAD.replace(" ", "   ") + "+ e c 1 5 (2) 7\r"]
BAD_OUT = [HEAD + "- e c (2) 5 1 7", HEAD + "+ e c (2) 5 1 7", HEAD + "C e c 1 5 (2) 7", HEAD + "+ e c 1 5 (2) 7 x", HEAD + "+ e c 1 5 (2)", HEAD.replace("1.5", "100.5") + "+ e c 1 5 (2) 7", HEAD.replace("5 9", "9 5") + "+ e c 1 5 (2) 7", HEAD.replace("s1", "s\t1") + "+ e c 1 5 (2) 7", HEAD.replace("(3)", "3") + "+ e c 1 5 (2) 7"]
NEITHER = [("te", None), ("te", ""), ("out", " \t \r"), ("te", "# x"), ("out", "   SW perc"), ("out", "score div."), ("out", "#")]


def table(spark):
    rows = [("te", x) for x in GOOD_TE + BAD_TE] + [("out", x) for x in GOOD_OUT + BAD_OUT] + NEITHER + [(None, "x"), ("csv", "x")]
    return rows, spark.createDataFrame([(i, f, x, "clash") for i, (f, x) in enumerate(rows)], "record_id long, fmt string, line_text string, fields string")


def test_rejects(spark):
    rows, df = table(spark)
    p = rejects.parse_lines(df)
    bad = {r.record_id: r.reasons for r in rejects.rejects(p).collect()}
    want = {i for i, (f, x) in enumerate(rows) if x in BAD_TE + BAD_OUT or f in (None, "csv")}
    assert set(bad) == want and all(bad.values())
    why = {x: bad[i] for i, (_, x) in enumerate(rows) if i in bad}
    assert why["c\t20\t20\t+\tn\tf\tc\t5"] == ["start is not before end"]
    assert why["c\t+1\t2\t+\tn\tf\tc\t5"] == ["coordinate is not a number"]  # what cannot be compared is not out of order
    assert why[HEAD + "- e c (2) 5 1 7"] == ["strand is not + or C"] and why[HEAD + "+ e c (2) 5 1 7"] == ["repeat positions do not fit the strand"]
    te = rejects.typed_te(p, rejects.rejects(p)).orderBy("record_id").collect()
    assert [r.te_name for r in te] == ["n", "n x", 'a\tb "q"', "n", "n"]
    assert te[4].te_start is None and te[0].te_start == 1  # too large for a long, yet valid
    assert te[4].too_large == f"te_start={'9' * 30};te_end=1{'0' * 30}" and te[0].too_large is None and te[1].score is None and te[1].too_large is None
    out = rejects.typed_out(p, rejects.rejects(p)).orderBy("record_id").collect()
    assert [(r.rep_begin, r.rep_end, r.rep_left, r.overlapped) for r in out] == [(1, 5, 2, False), (1, 5, 2, True), (1, 5, 2, False)]


def test_rejects_of_repeated_and_null_ids(spark):
    """A repeated line, one id with a good and a bad line, and two null ids."""
    good, bad = GOOD_TE[0], BAD_TE[1]
    rows = [(1, good), (1, good), (2, good), (2, bad), (None, good), (None, bad)]
    p = rejects.parse_lines(spark.createDataFrame([(i, "te", x) for i, x in rows], "record_id long, fmt string, line_text string"))
    r = rejects.rejects(p)
    assert sorted((x.record_id is None, x.record_id or 0) for x in r.collect()) == [(False, 2), (True, 0)]
    te = rejects.typed_te(p, r).collect()
    assert sorted((x.record_id is None, x.record_id or 0, x.te_start) for x in te) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 1)]


def test_rejects_long_and_empty(spark):
    df = spark.createDataFrame([(1, "te", 'c\t1\t2\t+\t"' + 'x""' * 50_000 + '"\tf\tc\t5'), (2, "te", "a\t" * 100_000)], "record_id long, fmt string, line_text string")
    assert [r.record_id for r in rejects.rejects(rejects.parse_lines(df)).collect()] == [2]
    assert rejects.rejects(rejects.parse_lines(df.limit(0))).collect() == []


def test_states_equal_the_join(spark):
    a = spark.createDataFrame([("x", 2), ("x", 3), ("y", 5), (None, 7)] + [("hot", 1)] * 50, "k string, v long")
    b = spark.createDataFrame([("x", 10), ("z", 1), (None, 4)] + [("hot", 2)] * 40, "k string, w long")
    sa = skew.compact_state(a, {"k": F.col("k")}, {"v": F.col("v")}, "n_a")
    sb = skew.compact_state(b, {"k": F.col("k")}, {"w": F.col("w")}, "n_b")
    got = {r.k: (r.n_pairs, r.v, r.w) for r in skew.eager_join_totals(sa, sb, "k", "n_a", "n_b", ["v"], ["w"]).collect()}
    want = {r.k: (r.n, r.v, r.w) for r in a.join(b, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
    assert got == want
    full = {r.k: (r.n_a, r.n_b) for r in skew.join_states(sa, sb, ["k"]).collect()}
    assert full == {"x": (2, 1), "y": (1, None), "z": (None, 1), None: (1, 1), "hot": (50, 40)}
    both = sa.select(F.lit("a").alias("side"), "k", F.col("n_a").alias("n")).union(sb.select(F.lit("b"), "k", "n_b"))
    assert {tuple(r) for r in skew.key_share_at_least(both, "side", "k", "n", 5).collect()} == {("a", "hot"), ("b", "hot")}
    assert {tuple(r) for r in skew.key_share_at_least(both, "side", "k", "n", 2).collect()} == {("a", "hot"), ("b", "hot"), ("a", "x"), ("b", "x"), ("b", "z")}


def test_deliver_once_takes_the_first(spark):
    df = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (None, 1, "x"), (2, 9, None)], "id long, ordinal long, v string")
    assert {(r.id, r.v) for r in skew.deliver_once(df, "id", ["ordinal"]).collect()} == {(1, "first"), (2, None)}


def test_fasta_variants(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 one\r\nAC\r\nGT\r\n>s2\tx\nnn\n>empty\n>s1 two\nTT>T\n")
    got = {r.name: r.seq for r in ln.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": "TT>T", "s2": "NN"}
    assert {r.name for r in ln.read_fasta(spark, str(tmp_path / "a.fa"), True).collect()} == {"s1 one", "s2\tx", "s1 two"}


def test_line_order_over_many_files(spark, tmp_path):
    text = "\n".join(str(i) for i in range(5000))
    (tmp_path / "x.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = ln.read_lines(spark, str(tmp_path / "x.txt")).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.value) for r in rows] == list(range(5000)) and len({r.ordinal for r in rows}) == 5000


def test_order_over_several_files(spark, tmp_path):
    """Three files of 100 lines, cut into small blocks: 300 ordinals in order of file and line; the last record of a name is that of the last file."""
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("\n".join(f"{k} {i:03d}" for i in range(100)))
        (tmp_path / f"{k}.fa").write_text(f">same\nAC{'ACG'[k]}\n>own{k}\nTT\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        rows = ln.read_lines(spark, str(tmp_path / "*.txt")).orderBy("ordinal").collect()
        fasta = {r.name: r.seq for r in ln.read_fasta(spark, str(tmp_path / "*.fa")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == [f"{k} {i:03d}" for k in range(3) for i in range(100)]
    assert len({r.ordinal for r in rows}) == 300
    assert fasta == {"same": "ACG", "own0": "TT", "own1": "TT", "own2": "TT"}


def test_first_per_key_over_batches(spark):
    """Twelve files in three batches, orders falling from file to file, ties and a null key."""
    from seqloom.streaming import chunks

    rows = [(None if i % 50 == 7 else f"k{i % 7}", 1000 - i // 2, i) for i in range(600)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "k string, o long, id long")
    got = {(r.k, r.o, r.id) for r in chunks.first_per_key(df, "k", "o", 3, ["id"]).collect()}
    want = {x for k in {r[0] for r in rows if r[0]} for x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[:3]}
    assert got == want
    assert chunks.first_per_key(df.limit(0), "k", "o", 3, ["id"]).collect() == []


def test_windows_of_an_empty_stream(spark):
    from seqloom.streaming import chunks

    df = spark.createDataFrame([], "ts timestamp, kind string")
    assert chunks.windowed_counts(df, "ts", ["kind"], "1 day").collect() == []
