"""Searches on strings that need dynamic programming or backtracking: Arrow-batched functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _start_of(pattern: str, text: str, end: int, edits: int) -> int:
    """Latest start of a stretch that ends at ``end`` and is ``edits`` edits from ``pattern``."""
    back, part = pattern[::-1], text[max(0, end - len(pattern) - edits) : end][::-1]
    row = list(range(len(back) + 1))
    if row[-1] == edits:
        return end
    for j, c in enumerate(part, 1):
        new = [j]
        for i, p in enumerate(back, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        if row[-1] == edits:
            return end - j
    return end - len(part)


def fuzzy_spans(pattern: str, text: str, most: int = 2) -> list[tuple[int, int, int]]:
    """Non-overlapping stretches ``(start, end, edits)`` of ``text`` within ``most`` edits of ``pattern``.

    Column-wise edit distance with a free start. Of overlapping stretches the one with the fewest edits,
    then the first, is kept.
    """
    if not pattern or not text:
        return []
    m = len(pattern)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cost, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(pattern, 1):  # a row of the table at once; insertions run along it
        new = np.empty_like(cost)
        new[0] = i
        new[1:] = np.minimum(cost[:-1] + (chars != ord(c)), cost[1:] + 1)
        cost = np.minimum.accumulate(new - at) + at
    ends = [(int(cost[j]), _start_of(pattern, text, int(j), int(cost[j])), int(j)) for j in np.flatnonzero(cost <= most)]
    out: list[tuple[int, int, int]] = []
    for d, a, b in sorted(ends):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, d))
    return sorted(out)


def _fuzzy_ends(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Start of the first and end of the last fuzzy match (0-based, half-open); -1 without one."""
    rows = []
    for p, t in zip(pattern, text):
        got = fuzzy_spans(p, t) if p and t else []
        rows.append((got[0][0], got[-1][1], len(got)) if got else (-1, -1, 0))
    return pd.DataFrame(rows, columns=["first_start", "last_end", "n"])


def _blurred(word: str) -> list[str]:
    """A word of eight letters or more with each of its letters left open in turn; a shorter one has none."""
    return [f"{word[:j]}.{word[j + 1 :]}" for j in range(len(word))] if len(word) >= 8 else []


def confident_site(seq: str, start: int, end: int, reach: int = 20) -> tuple[str | None, int]:
    """Duplicated site outside the 1-based closed element ``start..end``, and its distance to it.

    Words of 2 to 15 letters of both flanks are matched by length; from eight letters on, one letter of the
    right one may be another base. The pair with the least distance to the element wins, then the longest,
    then the one whose left copy lies nearest. Words with N, and repeats of a word further off, do not count.
    """
    left, right = seq[max(0, start - 1 - reach) : start - 1], seq[end : end + reach]
    pairs = []
    for k in range(2, 16):
        first: dict[str, int] = {}  # where a word, or a word with one letter open, comes first on the right
        for p in range(len(right) - k, -1, -1):
            word = right[p : p + k]
            first[word] = p
            first.update((x, p) for x, c in zip(_blurred(word), word) if c in "ACGT")
        for i in range(len(left) - k + 1):
            word = left[i : i + k]
            hits = [first[x] for x in (word, *_blurred(word)) if x in first]
            if hits and "N" not in word:
                away = len(left) - i - k
                pairs.append((away + min(hits), -k, away, word))
    if not pairs:
        return None, -1
    far, _, _, word = min(pairs)
    return word, far


def _confident_sites(seq: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    rows = [confident_site(s, int(a), int(b)) if s and not (pd.isna(a) or pd.isna(b)) else (None, -1) for s, a, b in zip(seq, start, end)]
    return pd.DataFrame(rows, columns=["tsd", "distance"])


def longest_tail_repeat(seq: str, width: int = 20, times: int = 2, low: int = 2, high: int = 6) -> tuple[str | None, int]:
    """Longest tandem repeat in the last ``width`` letters: its unit and its 0-based end.

    Of repeats of one length the shorter unit counts, then the one that ends last.
    """
    tail = seq[-width:]
    best: tuple[int, int, int] = (0, 0, 0)  # length, unit (negative), end
    for unit in range(low, high + 1):
        same = 0  # letters in a row, going back, that equal the one a unit later
        for i in range(len(tail) - unit - 1, -1, -1):
            same = same + 1 if tail[i] == tail[i + unit] else 0
            n = 1 + same // unit
            if n >= times:
                best = max(best, (n * unit, -unit, i + n * unit))
    n, unit, end = best
    return (tail[end - n : end - n - unit], len(seq) - len(tail) + end) if n else (None, -1)


def _longest_tail_repeats(seq: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_tail_repeat(s) if s else (None, -1) for s in seq], columns=["unit", "unit_end"])


def nearest_poly_a(seq: str, reach: int = 30, least: int = 6) -> str | None:
    """Longest run of A of at least ``least`` in the first or last ``reach`` letters; at the end on equal length."""
    runs = [max((m.group() for m in re.finditer(f"A{{{least},}}", x)), key=len, default="") for x in (seq[:reach], seq[-reach:])]
    best = runs[0] if len(runs[0]) > len(runs[1]) else runs[1]
    return best or None


def _nearest_poly_as(seq: pd.Series) -> pd.Series:
    return pd.Series([nearest_poly_a(s) if s else None for s in seq], dtype=object)


def align(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1, local: bool = False) -> int:
    """Score of the best global (or local) alignment with linear gap costs."""
    row = np.zeros(len(b) + 1, np.int64) if local else np.arange(len(b) + 1, dtype=np.int64) * gap
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(b) + 1, dtype=np.int64) * gap
    best = 0
    for i, c in enumerate(a, 1):
        diag = row[:-1] + np.where(y == ord(c), match, mismatch)
        new = np.empty_like(row)
        new[0] = 0 if local else i * gap
        new[1:] = np.maximum(diag, row[1:] + gap)
        if local:
            new = np.maximum(new, 0)
        row = np.maximum.accumulate(new - steps) + steps  # gaps along the row, all at once
        best = max(best, int(row.max()))
    return best if local else int(row[-1])


def common_length(a: str, b: str, contiguous: bool = False) -> int:
    """Length of the longest common subsequence, or of the longest common substring."""
    return _substring(a, b) if contiguous else _subsequence(a, b)


def _subsequence(a: str, b: str) -> int:
    """A row of the table is one number, of a bit for each letter of ``b``; zeros are steps of the length."""
    y, full = np.frombuffer(b.encode("utf-32-le"), np.uint32), (1 << len(b)) - 1
    at = {c: int.from_bytes(np.packbits(y == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    row = full
    for i in range(0, len(a), 64):
        for c in a[i : i + 64]:
            x = row & at[c]
            row = (row + x) | (row - x)
        row &= full  # carries
    return len(b) - row.bit_count()


def _substring(a: str, b: str) -> int:
    """Words of a length are numbers made of those of half the length; one that both texts have is found by sorting."""
    text = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)

    def numbered(x: np.ndarray, y: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, int]:
        if kinds < 1 << 31:
            return x, y, kinds
        names, x_y = np.unique(np.r_[x, y], return_inverse=True)
        return x_y[: len(x)], x_y[len(x) :], len(names)

    def joined(p: tuple, q: tuple, shift: int) -> tuple | None:
        """Words of ``p`` followed by those of ``q``, which start ``shift`` letters later; None if the texts have none in common."""
        n, m = (len(y) - shift for y in q[:2])
        if n <= 0 or m <= 0:
            return None
        x, y = (u[:k] * q[2] + v[shift:] for u, v, k in zip(p, q, (n, m)))
        return numbered(x, y, p[2] * q[2]) if _in_both(x, y) else None

    letters, x = np.unique(text, return_inverse=True)
    x = x.astype(np.int64)
    level = (x[: len(a)], x[len(a) :], len(letters))
    if not a or not b or not _in_both(*level[:2]):
        return 0
    levels = [level]  # words of 1, 2, 4, ... letters
    while (level := joined(levels[-1], levels[-1], 1 << len(levels) - 1)) is not None:
        levels.append(level)
    best, n = levels[-1], 1 << len(levels) - 1
    for k in range(len(levels) - 2, -1, -1):
        if (longer := joined(best, levels[k], n)) is not None:
            best, n = longer, n + (1 << k)
    return n


def _in_both(x: np.ndarray, y: np.ndarray) -> bool:
    z = np.sort(np.r_[x * 2, y * 2 + 1])
    return bool(((z[1:] ^ z[:-1]) == 1).any())


#: Cells of the longest antidiagonals that are worked on at once: many short pairs, or a few long ones.
WIDTH = 131_072


def _antidiagonals(codes: list[tuple[np.ndarray, np.ndarray]], kind: type, pad: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice, slice, slice]]]:
    """Codes of the first texts, those of the second ones backwards, and the cells of each antidiagonal that has some inside the table.

    Cells with the same number of letters of the first text lie side by side, one for each pair. Each antidiagonal is its number, the
    cells, those one letter of the first text before, and the letters of the second text.
    """
    k, n, m = len(codes), max(len(x) for x, _ in codes), max(len(y) for _, y in codes)
    a, b = np.full((n + 1, k), pad, kind), np.full((m, k), pad, kind)
    for i, (x, y) in enumerate(codes):
        a[1 : len(x) + 1, i] = x
        b[m - len(y) :, i] = y[::-1]
    lines = []
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        lines.append((d, slice(lo * k, hi * k), slice((lo - 1) * k, (hi - 1) * k), slice((m - d + lo) * k, (m - d + hi) * k)))
    return a.ravel(), b.ravel(), lines


def _global_scores(codes: list[tuple[np.ndarray, np.ndarray]], kind: type) -> list[int]:
    """Match 1, mismatch and gap -1. Kept are differences of neighbouring cells, 0 to 3 if a gap is added, which small numbers hold at any length."""
    a, b, lines = _antidiagonals([(x | 1, y | 1) for x, y in codes], kind, 1)
    k = len(codes)
    three = np.full_like(a, 3)
    down, right, other, z = (np.zeros_like(a) for _ in range(4))
    ends = np.array([len(x) * k + i for i, (x, _) in enumerate(codes)])
    seen = np.zeros((len(lines) + 2, k), kind)  # differences along the last row of each table
    for d, here, before, back in lines:
        s, x, y = z[here], down[here], right[before]
        np.bitwise_and(a[here], b[back], s)
        np.minimum(s, three[here], s)
        np.maximum(s, x, s)
        np.maximum(s, y, s)
        np.subtract(s, x, other[here])
        np.subtract(s, y, x)
        right, other = other, right
        np.take(right, ends, out=seen[d], mode="clip")
    return [int(seen[len(x) + 1 : len(x) + len(y) + 1, i].sum(dtype=np.int64)) - len(y) - len(x) for i, (x, y) in enumerate(codes)]


def _local_scores(codes: list[tuple[np.ndarray, np.ndarray]], kind: type) -> np.ndarray:
    a, b, lines = _antidiagonals(codes, kind, 0)
    one, two = np.full_like(a, 1), np.full_like(a, 2)
    last, older, new, best, z = (np.zeros_like(a) for _ in range(5))
    for _, here, before, back in lines:
        s, x, top, least = z[here], new[here], best[here], one[here]
        np.bitwise_and(a[here], b[back], s)
        np.minimum(s, two[here], s)
        np.add(s, older[before], s)
        np.maximum(s, last[before], s)
        np.maximum(s, last[here], s)
        np.maximum(s, least, s)
        np.subtract(s, least, x)
        np.maximum(top, x, top)
        last, older, new = new, last, older
    return best.reshape(-1, len(codes)).max(0)


def both_scores(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Scores of the best global and the best local alignment of each pair, as ``align`` gives them, by antidiagonals of many pairs at once."""
    out: list[tuple[int, int]] = [(-len(a) - len(b), 0) for a, b in pairs]
    order = sorted((i for i, (a, b) in enumerate(pairs) if a and b), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    while order:
        longest = len(pairs[order[-1]][0])
        part = [i for i in order[-max(1, WIDTH // longest) :] if len(pairs[i][0]) >= 0.8 * longest]
        del order[-len(part) :]
        letters = sorted(set().union(*(set(pairs[i][0]) & set(pairs[i][1]) for i in part)))
        if len(letters) > 62:
            for i in part:
                out[i] = (align(*pairs[i]), align(*pairs[i], local=True))
            continue
        # a bit for each letter from the second on; letters that no two texts share have none
        bits = np.zeros(max(map(ord, letters), default=0) + 2, np.uint64)
        bits[[ord(c) for c in letters]] = np.uint64(2) << np.arange(len(letters), dtype=np.uint64)
        kinds = [t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(letters) < np.iinfo(t).bits]
        bits = bits.astype(kinds[0])
        code = lambda x: bits[np.minimum(np.frombuffer(x.encode("utf-32-le"), np.uint32), len(bits) - 1)]
        codes = [(code(pairs[i][0]), code(pairs[i][1])) for i in part]
        most = max(min(len(a), len(b)) for a, b in codes)
        # scores rise by one from cell to cell: what doesn't fit is seen at the limit, before a number overflows
        fits = next(j for j, t in enumerate(kinds) if t != np.uint8 and np.iinfo(t).max > most + 8 or t == np.uint8 and most < 1600)
        local = _local_scores(codes, kinds[fits])
        if kinds[fits] == np.uint8 and local.max() >= 250:
            local = _local_scores(codes, np.uint16)
        for i, x, y in zip(part, _global_scores(codes, kinds[0]), local.tolist()):
            out[i] = (x, y)
    return out


def _pair_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = list(zip(a, b))
    known = [i for i, (x, y) in enumerate(pairs) if x is not None and y is not None]
    rows: list[tuple] = [(None,) * 4] * len(pairs)
    for i, s in zip(known, both_scores([pairs[i] for i in known])):
        rows[i] = (*s, _subsequence(*pairs[i]), _substring(*pairs[i]))
    return pd.DataFrame(rows, columns=["global_score", "local_score", "subsequence", "substring"])


def _stem_before(seq: str, at: int, stem: tuple[int, int], loop: tuple[int, int], reach: int) -> int:
    """Start of the longest hairpin that ends within ``reach`` letters before ``at``; of equal ones the nearest, -1 without one.

    A hairpin is a word whose reverse complement comes back after a loop.
    """
    turn = str.maketrans("ACGT", "TGCA")
    best = (0, -1)
    for end in range(at, max(-1, at - reach - 1), -1):
        for k in range(stem[1], max(stem[0], best[0] + 1) - 1, -1):
            for gap in range(loop[0], loop[1] + 1):
                a = end - 2 * k - gap
                if a >= 0 and seq[a : a + k] == seq[end - k : end].translate(turn)[::-1]:
                    best = max(best, (k, a))
                    break
            if best[0] >= k:
                break
    return best[1]


def helitron_ends(seq: str, tail: str = "CTAGT", head: str = "TCTCTACTA", stem: tuple[int, int] = (5, 8), loop: tuple[int, int] = (1, 9), reach: int = 12, far: int = 3000) -> list[tuple[int, int, int, int]]:
    """Hairpins followed within ``reach`` letters by ``tail``: start of the stem, end of the tail, level, start of the head (0-based).

    Level 0 is the exact tail, level 1 one with one other base. The head is the nearest place upstream, within
    ``far`` letters, that has at most two other bases than ``head`` and begins with TC; -1 without one.
    """
    if len(seq) < len(tail):
        return []
    x = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)

    def wrong(pattern: str) -> np.ndarray:
        n = len(x) - len(pattern) + 1
        return sum((x[i : i + max(0, n)] != ord(c)).astype(np.int8) for i, c in enumerate(pattern)) if n > 0 else np.zeros(0, np.int8)

    heads = np.flatnonzero((wrong(head) <= 2) & (wrong("TC")[: max(0, len(x) - len(head) + 1)] == 0))
    out = []
    for at in np.flatnonzero(wrong(tail) <= 1).tolist():
        a = _stem_before(seq, at, stem, loop, reach)
        if a >= 0:
            i = int(np.searchsorted(heads, a, "right")) - 1
            h = int(heads[i]) if i >= 0 and a - heads[i] <= far else -1
            out.append((a, at + len(tail), int(seq[at : at + len(tail)] != tail), h))
    return out


def _helitrons(seq: pd.Series) -> pd.Series:
    names = ("stem_start", "tail_end", "level", "head")
    return pd.Series([[dict(zip(names, r)) for r in helitron_ends(s)] if s else [] for s in seq], dtype=object)


def _as_column(f, kind: str):
    """A column function; the UDF is made when it is called, as workers import this module without a session."""

    def call(*cols):
        return F.pandas_udf(f, kind)(*cols)

    call.__doc__ = f.__doc__
    return call


fuzzy_ends = _as_column(_fuzzy_ends, "struct<first_start:int,last_end:int,n:int>")
confident_sites = _as_column(_confident_sites, "struct<tsd:string,distance:int>")
longest_tail_repeats = _as_column(_longest_tail_repeats, "struct<unit:string,unit_end:int>")
nearest_poly_as = _as_column(_nearest_poly_as, "string")
pair_scores = _as_column(_pair_scores, "struct<global_score:int,local_score:int,subsequence:int,substring:int>")
helitrons = _as_column(_helitrons, "array<struct<stem_start:int,tail_end:int,level:int,head:int>>")
