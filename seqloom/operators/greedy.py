"""First-come de-duplication: the result depends on the order, so it is run in order per group.

Groups are stretches of intervals that are connected by overlap (islands), found by window
functions first; an interval can only compete with others of its island, so an entity of any
size is spread over its islands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.intervals import merged
from seqloom.operators.ordered import ordered_groups, schema_of


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Each interval with the start of the period that holds it, found by a binned join."""
    from seqloom.operators.intervals import overlap_join

    m = merged(df, keys, start, end, 0).select(*keys, F.col("span_start").alias("_island"), F.col("span_end").alias("_island_end"))
    return overlap_join(df, m, keys, start, end, "_island", "_island_end").drop("_island_end")


def reciprocal(a: tuple[int, int], b: tuple[int, int], share: float) -> bool:
    """Do both intervals share ``share`` or more of either's ``end - start``? Never true for an empty one."""
    n = min(a[1], b[1]) - max(a[0], b[0])
    la, lb = a[1] - a[0], b[1] - b[0]
    return la > 0 and lb > 0 and n >= share * la and n >= share * lb


def _per_island(df: DataFrame, keys, start, end, order, pick, extra: str = "") -> DataFrame:
    t = _islands(df, keys, start, end).select(*df.columns, "_island")
    n, i, j = len(df.columns), df.columns.index(start), df.columns.index(end)
    return ordered_groups(t, [*keys, "_island"], order, lambda key, rows: pick([r[:n] for r in rows], i, j), schema_of(df) + extra)


class Kept:
    """Kept intervals, found by place: each lies in the cells of about its own length that it touches."""

    def __init__(self):
        self.cells: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, a: int, b: int) -> None:
        level = max(0, (b - a).bit_length())
        for cell in range(a >> level, (b >> level) + 1):  # two or three
            self.cells.setdefault((level, cell), []).append((a, b))

    def at(self, point: int, levels: range) -> list[tuple[int, int]]:
        """Kept intervals of the levels whose cell holds the point, among them all that hold it."""
        return [k for level in levels for k in self.cells.get((level, point >> level), ())]


def keep_first_overlapping(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, share: float) -> DataFrame:
    """Intervals by (start, end, id), without those that overlap a kept one by ``share`` (half or more) both ways.

    A kept one that does so has nearly the same length and holds the midpoint: only the cells of that place are
    looked at, so that a deep pile of intervals costs no more than a flat one.
    """
    if share <= 0.5:
        raise ValueError("share must exceed 0.5")

    def pick(rows: list[tuple], i: int, j: int) -> list[tuple]:
        kept, out = Kept(), []
        for r in rows:
            a, b = r[i], r[j]
            level = max(0, (b - a).bit_length())
            if not any(reciprocal((a, b), k, share) for k in kept.at((a + b) // 2, range(max(0, level - 1), level + 2))):
                kept.add(a, b)
                out.append(r)
        return out

    return _per_island(df, keys, start, end, [start, end, id_col], pick)


def run_heads(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, share: float) -> DataFrame:
    """Head of the run of each interval: an interval joins the run whose head it overlaps by ``share`` both ways, else it heads a new one."""
    at = df.columns.index(id_col)

    def pick(rows: list[tuple], i: int, j: int) -> list[tuple]:
        head, out = None, []
        for r in rows:
            if head is None or not reciprocal((r[i], r[j]), (head[i], head[j]), share):
                head = r
            out.append((*r, head[at]))
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return _per_island(df, keys, start, end, [start, end, id_col], pick, f", head_id {kind}")


def drop_overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str, share: float) -> DataFrame:
    """Longest intervals first, without those of which a kept one covers more than ``share`` (half or more); of equal length by the other columns.

    A kept interval that does so holds the midpoint and is no shorter: only such are looked at.
    """
    if share < 0.5:
        raise ValueError("share must be 0.5 or more")

    def pick(rows: list[tuple], i: int, j: int) -> list[tuple]:
        kept, out = Kept(), []
        for r in sorted(rows, key=lambda r: r[i] - r[j]):
            a, b = r[i], r[j]
            near = [k for m in {(a + b) // 2, (a + b + 1) // 2} for k in kept.at(m, range(max(0, (b - a).bit_length() - 1), 64))]
            if not any(min(b, k[1]) - max(a, k[0]) + 1 > share * (b - a + 1) for k in near):
                kept.add(a, b)
                out.append(r)
        return out

    return _per_island(df, keys, start, end, [start, end, *[c for c in df.columns if c not in (start, end)]], pick)
