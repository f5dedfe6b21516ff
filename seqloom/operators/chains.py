"""Gap-bridging chains of hits: order-dependent, so grouped and run on the hits of one pair in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.ordered import ordered_groups

_OUT = "query string, subject string, forward boolean, q_start long, q_end long, s_start long, s_end long, n_hits long"


def extend(hits: list[tuple[int, int, int, int]], gap: float, forward: bool, all_compatible: bool = True, q_gap: float | None = None) -> list[list[int]]:
    """Chains ``[q_start, q_end, s_start, s_end, n]`` of the hits of one query, subject and strand.

    Hits are taken along the subject (backwards on the reverse strand). The chains made so far are
    tried from the newest to the oldest, until one lies ``gap`` or more behind on the subject; a
    chain grows if the hit starts less than the gap behind its end on the query and ends further on
    both. Every chain that fits grows, or only the newest (``all_compatible=False``); a hit that fits
    none begins a chain. On the reverse strand a chain keeps the query start of its first hit.
    """
    q_gap = gap if q_gap is None else q_gap
    # the reverse strand is the forward one with mirrored subject positions
    turn = 1 if forward else -1
    todo = sorted((turn * ss, turn * se, qs, qe) for qs, qe, ss, se in hits)
    made: list[list[int]] = []  # query start and end, subject start and end, hits
    for ss, se, qs, qe in todo:
        fitting = []
        for c in made[::-1]:
            if ss - c[3] >= gap:
                break
            if c[1] < qe and c[3] < se and qs - c[1] < q_gap:
                fitting.append(c)
                if not all_compatible:
                    break
        for c in fitting:
            c[:] = [min(c[0], qs) if forward else c[0], qe, min(c[2], ss), se, c[4] + 1]
        if not fitting:
            made.append([qs, qe, ss, se, 1])
    return [[a, b, turn * c, turn * d, n] for a, b, c, d, n in made]


def chain_hits(hits: DataFrame, gap: str, all_compatible: bool = True, q_share: float = 1.0) -> DataFrame:
    """Chains of the hits ``query, subject, q_start, q_end, s_start, s_end`` and a gap column.

    The reverse strand has ``s_start > s_end``. Only hits of the same query, subject and strand
    can be chained, and none whose starts lie a gap apart with nothing between; the hits of one pair
    are therefore cut where the next start lies at least the gap beyond every end before, and
    each such stretch is a group of its own. The size of a group is bounded by the hits within
    one unbroken stretch, not by those of a pair. Repeated hits count once each; rows with a null
    key or coordinate must be left out before.
    """
    t = hits.withColumn("forward", F.col("s_start") <= F.col("s_end"))
    low = F.when(F.col("forward"), F.col("s_start")).otherwise(-F.col("s_start"))
    high = F.when(F.col("forward"), F.col("s_end")).otherwise(-F.col("s_end"))
    t = t.withColumns({"_a": low, "_b": high})
    w = W.partitionBy("query", "subject", "forward").orderBy("_a", "_b", "q_start", "q_end")
    far = F.col("_a") - F.max("_b").over(w.rowsBetween(W.unboundedPreceding, -1))
    t = t.withColumn("_far", far)
    t = t.withColumn("_cut", F.sum(F.when(F.col("_far") >= F.col(gap), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        g = rows[0][8]
        return [(*key[:3], *c) for c in extend([r[4:8] for r in rows], g, key[2], all_compatible, g * q_share)]

    cols = ["query", "subject", "forward", "_cut", "q_start", "q_end", "s_start", "s_end", gap]
    return ordered_groups(t.select(*cols), cols[:4], cols[4:8], step, _OUT)
