"""Interval algebra: periods and gaps, coverage, binned overlap joins.

Coordinates are closed (``start`` and ``end`` both belong to the interval)
unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.operators.running import running

#: Positions per bucket of the distributed ranking. A bucket of an entity holds at most
#: this many distinct positions, which bounds the rows that one window sorts.
BUCKET_WIDTH = 1 << 16
#: Buckets that one interval may be cut into; with the usual width, 69 billion positions.
MOST_BUCKETS = 1 << 20


def _clean(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Keys renamed to _k0.., ends put in order, rows with a null key or coordinate dropped."""
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    out = df.select(*cols, F.least(s, e).alias("_s"), F.greatest(s, e).alias("_e"), s.isNotNull().alias("_a"), e.isNotNull().alias("_b"))
    ok = F.col("_a") & F.col("_b")
    for i in range(len(keys)):
        ok = ok & F.col(f"_k{i}").isNotNull()
    return out.filter(ok).drop("_a", "_b")


def periods_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    touch: int = 1,
    bucket_width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Continuous periods covered by the intervals of each entity, and the gaps between them.

    Returns ``keys, kind ('period' or 'gap'), span_start, span_end``.

    Method: starts and ends are ranked independently of each other within an entity. With
    ``r`` starts before a start position ``p``, a new period opens at ``p`` exactly if the
    ``r``-th ranked end lies before ``p - touch``, that is, if as many ends as starts were
    passed; the ``r``-th end closes the period before. No interval is ever compared with
    another one, so overlap depth does not matter.

    Distribution: equal positions are counted before the shuffle. Ranks are prefix sums: of
    buckets of ``bucket_width`` positions per entity (few rows) and of positions within a
    bucket. An entity that holds a third of all rows is spread over its buckets.

    Defined cases: ``start > end`` is exchanged; rows with a null key, start or end are
    ignored; repeated rows change nothing; an empty table gives an empty result; other
    columns are ignored. ``touch=1``: intervals that are adjacent join (closed integer
    coordinates). ``touch=0``: they must share a position; no empty gap is reported.
    ``touch=n+1``: gaps of up to ``n`` positions are bridged and not reported.
    """
    if touch < 0:
        raise ValueError("touch must be 0 or more")
    ks = [f"_k{i}" for i in range(len(keys))]
    iv = _clean(df, keys, start, end)
    marks = iv.select(
        *ks,
        F.explode(
            F.array(
                F.struct(F.col("_s").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct((F.col("_e") + touch).alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("m"),
    ).select(*ks, "m.*")
    counted = marks.groupBy(*ks, "pos").agg(F.sum("s").alias("n_s"), F.sum("e").alias("n_e"))
    placed = counted.withColumn("bkt", F.floor(F.col("pos") / bucket_width).cast("long")).repartition(*ks, "bkt")

    over_key = W.partitionBy(*ks).orderBy("bkt")
    before = over_key.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*ks)
    per_bucket = placed.groupBy(*ks, "bkt").agg(
        F.sum("n_s").alias("b_s"), F.sum("n_e").alias("b_e"), F.max(F.when(F.col("n_e") > 0, F.col("pos"))).alias("b_last")
    )
    offsets = per_bucket.select(
        *ks,
        "bkt",
        F.coalesce(F.sum("b_s").over(before), F.lit(0)).alias("o_s"),
        F.coalesce(F.sum("b_e").over(before), F.lit(0)).alias("o_e"),
        F.max("b_last").over(before).alias("o_last"),
        F.max("b_last").over(whole).alias("k_last"),
    )
    in_bucket = W.partitionBy(*ks, "bkt").orderBy("pos")
    below = in_bucket.rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumns(
        {
            "r_s": F.coalesce(F.sum("n_s").over(below), F.lit(0)),
            "r_e": F.coalesce(F.sum("n_e").over(below), F.lit(0)),
            "r_last": F.max(F.when(F.col("n_e") > 0, F.col("pos"))).over(below),
        }
    ).join(offsets, [*ks, "bkt"])
    opens = ranked.filter((F.col("n_s") > 0) & (F.col("r_s") + F.col("o_s") == F.col("r_e") + F.col("o_e"))).select(
        *ks, "bkt", "pos", (F.coalesce("r_last", "o_last") - touch).alias("prev_end"), (F.col("k_last") - touch).alias("k_last")
    )
    # each opening is paired with the end that closes its period: the end before the next opening
    firsts = opens.groupBy(*ks, "bkt").agg(F.min_by("prev_end", "pos").alias("f_end"))
    nexts = firsts.select(*ks, "bkt", F.lead("f_end").over(over_key).alias("n_end"))
    paired = opens.withColumn("l_end", F.lead("prev_end").over(in_bucket)).join(nexts, [*ks, "bkt"])
    spans = paired.select(
        *ks,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("pos").alias("span_start"), F.coalesce("l_end", "n_end", "k_last").alias("span_end")),
                F.struct(F.lit("gap").alias("kind"), (F.col("prev_end") + 1).alias("span_start"), (F.col("pos") - 1).alias("span_end")),
            )
        ).alias("x"),
    ).select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], "x.*")
    return spans.filter("span_start is not null and span_start <= span_end")


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str, touch: int = 1, **kw) -> DataFrame:
    """Maximal periods only: ``keys, span_start, span_end``."""
    return periods_and_gaps(df, keys, start, end, touch, **kw).filter("kind = 'period'").drop("kind")


def _per_bucket(df: DataFrame, keep: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Intervals cut at the borders of buckets of ``width`` positions: ``keep, _bkt, _s, _e``; one row with nulls if a coordinate is null."""
    s, e = F.col(start), F.col(end)
    many = F.floor(e / width) - F.floor(s / width) >= MOST_BUCKETS
    first = F.when(many, F.raise_error(F.lit(f"an interval touches over {MOST_BUCKETS} buckets: choose a larger width")).cast("long")).otherwise(F.floor(s / width))
    bkt = F.explode_outer(F.sequence(first, F.floor(e / width)))
    x = df.select(*keep, s.alias("_s0"), e.alias("_e0"), bkt.alias("_bkt"))
    return x.select(*keep, "_bkt", F.greatest("_s0", F.col("_bkt") * width).alias("_s"), F.least("_e0", F.col("_bkt") * width + (width - 1)).alias("_e"), (F.col("_bkt") == F.floor(F.col("_s0") / width)).alias("_first"))


def covered_bases(df: DataFrame, keys: Sequence[str], start: str, end: str, by: Sequence[str] | None = None, count: str | None = None, width: int = BUCKET_WIDTH) -> DataFrame:
    """Distinct positions covered, summed over ``by`` (default: per entity): ``by, covered``, and the rows as ``count`` if named.

    Cover adds up over stretches of the axis, so intervals are cut at the borders of buckets and each bucket of
    an entity is worked on alone: no prefix over buckets is needed. Of the intervals that begin at one position
    only the longest is shuffled; a bucket holds ``width`` rows at most, however many intervals there are.

    Defined cases: ``start > end`` is exchanged; rows with a null key or coordinate cover nothing but count
    under their ``by``, null included (without ``count`` they give no row); repeated rows cover once.
    """
    by = list(keys if by is None else by)
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    known = s.isNotNull() & e.isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    keep = list(dict.fromkeys([*keys, *by]))
    names = {k: f"_k{i}" for i, k in enumerate(keep)}
    t = df.select(*[F.col(k).alias(n) for k, n in names.items()], F.when(known, F.least(s, e)).alias("_a"), F.when(known, F.greatest(s, e)).alias("_b"))
    if count is None:
        t = t.filter("_a is not null")
    ks = list(names.values())
    cut = _per_bucket(t, ks, "_a", "_b", width)
    longest = cut.groupBy(*ks, "_bkt", "_s").agg(F.max("_e").alias("_e"), F.sum(F.coalesce(F.col("_first"), F.lit(True)).cast("long")).alias("_n"))
    before = W.partitionBy(*ks, "_bkt").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    adds = F.greatest(F.lit(0).cast("long"), F.col("_e") - F.greatest(F.coalesce(F.max("_e").over(before), F.col("_s") - 1), F.col("_s") - 1))
    x = longest.select(*[F.col(names[k]).alias(f"_b{i}") for i, k in enumerate(by)], "_n", F.when(F.col("_s").isNotNull(), adds).alias("_c"))
    g = x.groupBy(*[f"_b{i}" for i in range(len(by))]).agg(F.sum("_c").alias("covered"), F.sum("_n").alias("_n"))
    return g.select(*[F.col(f"_b{i}").alias(k) for i, k in enumerate(by)], F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), *([F.col("_n").alias(count)] if count else []))


def overlap_len(s1, e1, s2, e2) -> Column:
    """``max(0, min(ends) - max(starts))``: length shared by two half-open intervals."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0), F.least(c(e1), c(e2)) - F.greatest(c(s1), c(s2)))


def nearest_bin(start, end, width: int) -> Column:
    """The one bin of an interval that holds most of it; of a longer one, its first or its last bin."""
    a, b = F.floor(start / width), F.floor(end / width)
    return F.when(a == b, a).when(F.abs(b * width - start) < F.abs(end - b * width), b).otherwise(a).cast("long")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l_start: str,
    l_end: str,
    r_start: str,
    r_end: str,
    width: int = 1 << 14,
    min_overlap: int = 0,
    how: str = "inner",
) -> DataFrame:
    """Pairs of closed intervals of one entity that touch, and share ``min_overlap`` or more of ``end - start``.

    A theta join would be a Cartesian product; each interval is written into every bin that it
    touches instead, the bins are joined by equality and a pair is kept only in the first bin
    that both touch, so no distinct is needed. ``how``: inner, left_semi or left_anti. Column
    names other than ``keys`` must differ. Rows with a null key or coordinate match nothing.
    """
    lb, rb = "_bin_l", "_bin_r"
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    r = right.filter(F.col(r_start) <= F.col(r_end)).select("*", bins(r_start, r_end).alias(rb))
    first_bin = F.greatest(F.floor(F.col(l_start) / width), F.floor(F.col(r_start) / width))
    hit = (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
    if min_overlap:
        hit = hit & (overlap_len(l_start, l_end, r_start, r_end) >= min_overlap)
    if how == "inner":
        ll = left.filter(F.col(l_start) <= F.col(l_end)).select("*", bins(l_start, l_end).alias(lb))
        cond = F.col(lb) == F.col(rb)
        ren = {k: f"_r_{k}" for k in keys}
        for k, v in ren.items():
            r = r.withColumnRenamed(k, v)
            cond = cond & (F.col(k) == F.col(v))
        return ll.join(r, cond & hit & (F.col(lb) == first_bin)).drop(lb, rb, *ren.values())
    # semi and anti: rows are told apart by a key of their coordinates, which is all that decides
    r_side = right.select(*keys, r_start, r_end).distinct()
    places = left.select(*keys, l_start, l_end).distinct()
    hits = overlap_join(places, r_side, keys, l_start, l_end, r_start, r_end, width, min_overlap).select(*keys, l_start, l_end).distinct()
    return left.join(hits, [*keys, l_start, l_end], how).select(*left.columns)


def running_masked(df: DataFrame, keys: Sequence[str], order: str, start: str, end: str, name: str = "bp") -> DataFrame:
    """Bases that each row adds to those before it in the given order (closed ends, starts from 1).

    ``end - start + 1``, less what lies at or before the largest end so far; 0 for a contained row.
    The largest end so far comes from buckets of the order, so no task sorts all rows of an entity.
    """
    out = running(df, keys, order, {"_prev": ("max", F.col(end))}).withColumn("_prev", F.coalesce("_prev", F.lit(0)))
    bp = F.when(F.col(start) > F.col("_prev"), F.col(end) - F.col(start) + 1).when(F.col(end) <= F.col("_prev"), F.lit(0)).otherwise(F.col(end) - F.col("_prev"))
    return out.withColumn(name, bp.cast("long")).drop("_prev")


def confusion_bases(truth: DataFrame, test: DataFrame, keys: Sequence[str], start: str, end: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Bases in both, in ``truth`` only and in ``test`` only, per entity: ``keys, tp, fn, fp``.

    Each side gives depth changes of +1 and -1; the stretch up to the next change is counted under the
    state that holds in it. Intervals are cut at bucket borders first, as these counts add up over stretches of
    the axis, and changes at one position are added up before the shuffle.
    """
    ks = [f"_k{i}" for i in range(len(keys))]

    def changes(df: DataFrame, a: int, b: int) -> DataFrame:
        cut = _per_bucket(_clean(df, keys, start, end), ks, "_s", "_e", width)
        ev = lambda p, sign: F.struct(p.alias("pos"), F.lit(a * sign).alias("a"), F.lit(b * sign).alias("b"))
        return cut.select(*ks, "_bkt", F.explode(F.array(ev(F.col("_s"), 1), ev(F.col("_e") + 1, -1))).alias("x")).select(*ks, "_bkt", "x.*")

    ev = changes(truth, 1, 0).unionByName(changes(test, 0, 1)).groupBy(*ks, "_bkt", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy(*ks, "_bkt").orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    st = ev.select(*ks, F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"), (F.lead("pos").over(w) - F.col("pos")).alias("n"))
    z = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    g = st.groupBy(*ks).agg(
        z((F.col("a") > 0) & (F.col("b") > 0))("tp"), z((F.col("a") > 0) & (F.col("b") == 0))("fn"), z((F.col("a") == 0) & (F.col("b") > 0))("fp")
    )
    return g.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], "tp", "fn", "fp")


def distance(a_start, a_end, b_start, b_end) -> Column:
    """0 for intervals that share a base, else the smaller of the two distances between facing ends."""
    a0, a1, b0, b1 = (F.col(x) if isinstance(x, str) else x for x in (a_start, a_end, b_start, b_end))
    return F.when((a0 <= b1) & (b0 <= a1), F.lit(0)).otherwise(F.least(F.abs(a1 - b0), F.abs(a0 - b1)))


def side(a_start, a_end, g_start, g_end, strand) -> Column:
    """Where ``a`` lies seen from ``g`` on its own strand: Inside, Upstream or Downstream."""
    a0, a1, g0, g1, s = (F.col(x) if isinstance(x, str) else x for x in (a_start, a_end, g_start, g_end, strand))
    return F.when((a0 <= g1) & (g0 <= a1), "Inside").when((a1 < g0) == (s != "-"), "Upstream").otherwise("Downstream")


def subtract_from_text(df: DataFrame, id_col: str, text: str, cuts: DataFrame, start: str, end: str, fill: str | None = None) -> DataFrame:
    """Texts without the stretches given for their id, or with these filled by one letter.

    Stretches are 1-based, closed, may overlap and are cut at the ends of the text. Texts without
    any come out as they are; ids must be unique.
    """
    m = merged(cuts.select(F.col(id_col), F.greatest(F.col(start), F.lit(1)).alias("_a"), F.col(end).alias("_b")).filter("_b >= _a"), [id_col], "_a", "_b")
    lists = m.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("_cuts"))
    j = df.join(lists, id_col, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<struct<span_start:bigint,span_end:bigint>>")))
    n = F.length(text)
    # pieces between the stretches: from the end of one to the start of the next
    froms = F.concat(F.array(F.lit(0).cast("long")), F.col("_cuts.span_end"))
    tos = F.concat(F.col("_cuts.span_start"), F.array((n + 1).cast("long")))
    piece = F.zip_with(
        froms,
        tos,
        lambda a, b: F.concat(
            F.substring(F.col(text), (a + 1).cast("int"), F.greatest(F.lit(0).cast("long"), b - a - 1).cast("int")),
            F.repeat(F.lit(fill or ""), F.lit(0)),
        ),
    )
    if fill is None:
        return j.withColumn(text, F.array_join(piece, "")).drop("_cuts")
    fills = F.transform("_cuts", lambda c: F.repeat(F.lit(fill), F.greatest(F.lit(0), F.least(c["span_end"], n) - F.least(c["span_start"], n + 1) + 1).cast("int")))
    both = F.zip_with(piece, F.concat(fills, F.array(F.lit(""))), lambda p, f: F.concat(p, f))
    return j.withColumn(text, F.array_join(both, "")).drop("_cuts")
