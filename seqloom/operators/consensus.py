"""Column-wise work on multiple alignments: ``family, row, seq`` with gapped rows of one length, or of any if ``ragged``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ordered import ordered_groups


def columns(msa: DataFrame, ragged: bool = False) -> DataFrame:
    """Composition: ``family, col, base, n, first_row``; columns count from 0.

    Counts are aggregated before the shuffle; a family of any number of rows ends up with at most a
    few rows per column. Null rows are left out. ``ragged``: rows may end early; they have gaps up to the
    end of the family's longest row, which are counted from the lengths and never written out.
    """
    x = msa.filter("seq is not null and seq <> ''").select("family", "row", F.posexplode(F.split("seq", "")).alias("col", "base")).filter("base <> ''")
    comp = x.groupBy("family", "col", "base").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    if not ragged:
        return comp
    return comp.unionByName(_ended(msa)).groupBy("family", "col", "base").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def _ended(msa: DataFrame) -> DataFrame:
    """Gaps of the rows that end before a column: ``family, col, base, n, first_row``. One task holds a family's columns, not its rows."""
    ends = msa.filter("seq is not null and seq <> ''").groupBy("family", F.length("seq").alias("col")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    width = ends.groupBy("family").agg(F.max("col").alias("width"))
    cols = width.select("family", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    w = W.partitionBy("family").orderBy("col")
    x = cols.join(ends, ["family", "col"], "left").withColumns({"n": F.sum("n").over(w), "first_row": F.min("first_row").over(w)})
    return x.filter("n > 0").select("family", "col", F.lit("-").alias("base"), "n", "first_row")


def _per_column(comp: DataFrame) -> DataFrame:
    """Best base with and without gaps (most rows, then first seen), gaps and rows per column."""
    rank = lambda c: F.max_by(F.struct("base", "n"), F.when(c, F.struct("n", -F.col("first_row"))))
    letter = F.col("base") != "-"
    return comp.groupBy("family", "col").agg(
        rank(F.lit(True)).alias("top"),
        rank(letter).alias("letter"),
        F.coalesce(F.sum(F.when(~letter, F.col("n"))), F.lit(0)).alias("gaps"),
        F.sum("n").alias("rows"),
    )


def _join_columns(x: DataFrame, base: str, name: str) -> DataFrame:
    return x.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", base))), lambda s: s[base]), "").alias(name))


def majority(msa: DataFrame, ragged: bool = False) -> DataFrame:
    """Consensus: the most frequent letter of each column if it is in more than half of the rows; other columns vanish."""
    x = _per_column(columns(msa, ragged))
    n = msa.filter("seq is not null and seq <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    x = x.join(n, "family").withColumn("out", F.when(F.col("letter.n") > F.floor(F.col("total") / 2), F.col("letter.base")).otherwise(""))
    return _join_columns(x, "out", "consensus")


def boundary_consensus(msa: DataFrame, ragged: bool = False) -> DataFrame:
    """Consensus that keeps weak columns: the top symbol if it is in half of the rows (a gap vanishes), else the best letter."""
    x = _per_column(columns(msa, ragged))
    n = msa.filter("seq is not null and seq <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    strong = F.col("top.n") >= F.floor(F.col("total") / 2)
    out = F.when(strong & (F.col("top.base") != "-"), F.col("top.base")).when(strong, "").otherwise(F.coalesce("letter.base", F.lit("")))
    return _join_columns(x.join(n, "family").withColumn("out", out), "out", "consensus")


def drop_sparse(msa: DataFrame, ragged: bool = False) -> DataFrame:
    """Rows without the columns in which over half of the rows have gaps: ``family, row, seq``."""
    x = _per_column(columns(msa, ragged))
    n = msa.filter("seq is not null and seq <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    keep = x.join(n, "family").filter(F.col("gaps") <= F.col("total") / 2)
    run = F.col("col") - F.row_number().over(W.partitionBy("family").orderBy("col"))
    keep = keep.select("family", "col", run.alias("run")).groupBy("family", "run").agg((F.min("col") + 1).cast("int").alias("a"), F.count(F.lit(1)).cast("int").alias("k"))
    keep = keep.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("a", "k"))).alias("keep"))
    j = msa.filter("seq is not null and seq <> ''").join(keep, "family", "left")
    part = lambda r: F.rpad(F.col("seq").substr(r["a"], r["k"]), r["k"], "-")
    return j.select("family", "row", F.coalesce(F.array_join(F.transform("keep", part), ""), F.lit("")).alias("seq"))


def homology_boundary(msa: DataFrame, width: int = 10, ragged: bool = False) -> DataFrame:
    """First column at which rows agree, by windows of ``width`` dense columns: ``family, boundary``.

    A column is dense if at most half of its rows are gaps; its homology is the share of the best
    letter among all rows. In the first window whose mean reaches the threshold (0.95 up to 5 rows,
    0.9 up to 10, else 0.85), the boundary is the first column that comes within 0.1 of it.
    """
    n = msa.filter("seq is not null and seq <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    x = _per_column(columns(msa, ragged)).join(n, "family").filter(F.col("gaps") <= F.floor(F.col("total") / 2))
    x = x.withColumns({"h": F.coalesce("letter.n", F.lit(0)) / F.col("total"), "need": F.when(F.col("total") <= 5, 0.95).when(F.col("total") <= 10, 0.9).otherwise(0.85)})
    w = W.partitionBy("family").orderBy("col")
    ahead = w.rowsBetween(0, width - 1)
    x = x.withColumns({"mean": F.avg("h").over(ahead), "size": F.count("h").over(ahead), "near": F.min(F.when(F.col("h") >= F.col("need") - 0.1, F.col("col"))).over(ahead)})
    hit = x.filter((F.col("size") == width) & (F.round("mean", 9) >= F.col("need")))
    return hit.groupBy("family").agg(F.min_by("near", "col").alias("boundary"))


def pixels(msa: DataFrame) -> DataFrame:
    """Pixel values of an alignment: ``family, row, col, block, support, code``.

    block: 0 for a gap, else 100; support: whole percent of the column's letters that are this one;
    code: G 100, C 75, A 50, T 25, gap 0. Cells after the end of a shorter row are 0 in all three and not listed.
    """
    comp = columns(msa)
    letters = comp.filter(F.col("base").isin("A", "C", "G", "T")).groupBy("family", "col").agg(F.sum("n").alias("letters"))
    c = comp.join(letters, ["family", "col"], "left")
    gap = F.col("base") == "-"
    c = c.select("family", "col", "base", F.when(gap, 0).otherwise(100).alias("block"), F.when(gap, 0).when(F.col("letters") > 0, F.floor(100 * F.col("n") / F.col("letters"))).otherwise(0).cast("int").alias("support"), F.when(F.col("base") == "G", 100).when(F.col("base") == "C", 75).when(F.col("base") == "A", 50).when(F.col("base") == "T", 25).otherwise(0).alias("code"))
    x = msa.filter("seq is not null and seq <> ''").select("family", "row", F.posexplode(F.split("seq", "")).alias("col", "base")).filter("base <> ''")
    return x.join(c, ["family", "col", "base"]).drop("base")


def first_come_clusters(lengths: DataFrame, spans: DataFrame, coverage: float) -> DataFrame:
    """Greedy clusters: a query that no earlier query took gathers the subjects that it covers: ``name, cluster``.

    ``lengths``: ``name, len, ordinal``; ``spans``: ``query, subject, q_len, s_len`` of their longest
    chains. A subject joins if the chain covers ``coverage`` of either length. Only connected names can
    take each other, so each component (found by joins) is worked on in order on its own.
    """
    q = lengths.select(F.col("name").alias("query"), F.col("len").alias("ql"), F.col("ordinal").alias("qo"))
    s = lengths.select(F.col("name").alias("subject"), F.col("len").alias("sl"), F.col("ordinal").alias("so"))
    fit = (F.col("q_len") >= coverage * F.col("ql")) | (F.col("s_len") >= coverage * F.col("sl"))
    e = spans.join(q, "query").join(s, "subject").filter(fit & (F.col("query") != F.col("subject"))).select("query", "qo", "subject", "so").distinct()
    comp = components(e.select(F.col("query").alias("a"), F.col("subject").alias("b")))
    work = e.join(comp, F.col("query") == F.col("node")).select("component", "qo", "query", "so", "subject")

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        taken: dict[str, str] = {}
        for _, _, query, _, subject in rows:
            if taken.get(query, query) != query:
                continue
            taken[query] = query
            if subject not in taken:
                taken[subject] = query
        return sorted(taken.items())

    got = ordered_groups(work, ["component"], ["qo", "query", "so", "subject"], step, "name string, cluster string")
    rest = lengths.select("name").join(got.select("name"), "name", "left_anti").select("name", F.col("name").alias("cluster"))
    return got.unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component``: the smallest node reachable over undirected edges ``a, b``. Every round is written as a table."""
    from seqloom.session import materialize

    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null and b is not null").distinct(), "edges")
    label = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(max_rounds):
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(seen, label["node"] == seen["a"]).select("node", F.least("label", "m").alias("l2"), "label")
        jump = label.select(F.col("node").alias("l2"), F.col("label").alias("l3"))
        new = materialize(new.join(jump, "l2").select("node", F.least("l2", "l3").alias("label"), F.col("label").alias("old")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError("labels still change: raise max_rounds")
