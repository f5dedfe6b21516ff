"""Splitting of oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAN = "struct<cuts:array<bigint>,natural:array<boolean>,kept:array<bigint>>"


def natural_boundaries(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """``(offset after the run, length of the run)`` for runs with text on both sides."""
    return [(m.end(), m.end() - m.start()) for m in pattern.finditer(text) if m.start() > 0 and m.end() < len(text)]


def bisect_cuts(n: int, bounds: list[tuple[int, int]], limit: int, overlap: int) -> tuple[list[tuple[int, bool]], list[int]]:
    """Where a text of ``n`` characters is cut, in order, with whether each cut is natural; and the boundaries left whole inside the pieces.

    A stretch longer than ``limit - overlap`` is cut at its strongest boundary (longest run; of
    equal ones the nearest to the midpoint, then the first) in its middle half; without one
    there, at the strongest boundary that leaves more than ``overlap`` characters on each side;
    without any, at the midpoint. Both parts are then treated likewise.
    """
    room = limit - overlap
    at = [b[0] for b in bounds]
    cuts, kept, todo = [], [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            kept += at[bisect_right(at, lo) : bisect_left(at, hi)]
            continue
        mid, best = (lo + hi) // 2, None
        quarter = (hi - lo) // 4
        for a, b in ((max(lo + quarter, lo + overlap + 1), hi - quarter), (lo + overlap + 1, hi - overlap - 1)):
            near = bounds[bisect_left(at, a) : bisect_right(at, b)]
            if near:
                best = min(near, key=lambda x: (-x[1], abs(x[0] - mid), x[0]))[0]
                break
        cut = mid if best is None else best
        i = bisect_left(at, cut)
        cuts.append((cut, i < len(at) and at[i] == cut))
        todo += [(lo, cut), (cut, hi)]
    return sorted(cuts), sorted(kept)


def _planner(limit: int, overlap: int, boundary: str):
    def plan(texts: pd.Series) -> pd.DataFrame:
        pattern = re.compile(boundary)
        rows = []
        for text in texts:
            cuts, kept = bisect_cuts(len(text), natural_boundaries(text, pattern), limit, overlap)
            rows.append(([c for c, _ in cuts], [x for _, x in cuts], kept))
        return pd.DataFrame(rows, columns=["cuts", "natural", "kept"])

    return plan


def split_plan(df: DataFrame, text_col: str, limit: int = 8000, overlap: int = 200, boundary: str = "N{10,}") -> DataFrame:
    """The rows of oversized texts (over ``limit`` characters) with a column ``split_plan``: where they are cut.

    ``cuts`` and whether each is ``natural``, and the natural boundaries that are ``kept`` inside pieces;
    offsets count from 0. Only oversized texts leave the JVM, and only offsets come back; a row's text
    is read once and never shuffled. Null and empty texts, and those within the limit, give no row; an
    empty table gives an empty result; other columns stay, but for one of that name.
    """
    if overlap < 0 or limit < 2 * overlap + 2:
        raise ValueError("limit must exceed twice the overlap")
    plan = F.pandas_udf(_planner(limit, overlap, boundary), _PLAN)
    return df.filter(F.length(text_col) > limit).withColumn("split_plan", plan(F.col(text_col)))


def found_boundaries(plan: DataFrame, id_col: str) -> DataFrame:
    """``id, boundary_pos``: 1-based position after each natural boundary, 0 for a text without any.

    The boundaries are those that the bisection cut at and those that it left inside pieces.
    """
    x = F.col("split_plan")
    natural = F.transform(F.filter(F.arrays_zip(x["cuts"].alias("at"), x["natural"].alias("natural")), lambda c: c["natural"]), lambda c: c["at"])
    found = F.concat(natural, x["kept"])
    after = F.when(F.size(found) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(found, lambda v: v + 1))
    return plan.select(F.col(id_col).alias("id"), F.explode(after).alias("boundary_pos"))


def pieces(plan: DataFrame, id_col: str, text_col: str, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the oversized texts: ``id, piece_no, piece_start, piece_end, starts_at_boundary, piece`` and the columns ``keep``.

    Positions are 1-based and closed. Each piece but the first begins ``overlap`` characters
    before its cut, so that consecutive pieces share exactly these; no piece exceeds the limit. Of a
    repeated id each row gives its own pieces.
    """
    x, text = F.col("split_plan"), F.col(text_col)
    cut_row = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("natural"))
    rows = F.concat(F.array(cut_row), F.arrays_zip(x["cuts"].alias("at"), x["natural"].alias("natural")))
    p = plan.select(F.col(id_col).alias("_id"), text.alias("_text"), x["cuts"].alias("_cuts"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.posexplode(rows).alias("piece_no", "_row"))
    end = F.coalesce(F.get("_cuts", F.col("piece_no")), F.length("_text").cast("long"))
    start = F.when(F.col("piece_no") == 0, F.lit(1)).otherwise(F.col("_row.at") - overlap + 1).cast("long")
    cut = F.col("_text").substr(F.col("piece_start").cast("int"), (F.col("piece_end") - F.col("piece_start") + 1).cast("int"))
    p = p.withColumns({"piece_start": start, "piece_end": end})
    return p.select(F.col("_id").alias("id"), "piece_no", "piece_start", "piece_end", F.col("_row.natural").alias("starts_at_boundary"), cut.alias("piece"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
