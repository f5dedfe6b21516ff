"""Scalar functions on nucleotide strings, built from JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How unclear bases are read: fixed values.
UNCLEAR, READ_AS = "MYHRSKVDBW", "CCCGGGGGGT"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cleaned(seq) -> Column:
    """Without white space, in upper case, unclear bases read as one base each."""
    # letters without a counterpart are removed
    return F.translate(F.upper(_c(seq)), UNCLEAR + " \t\n\x0b\f\r", READ_AS)


def reverse_complement(seq) -> Column:
    """Reverse complement in upper case; letters other than A, C, G, T become N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N"), "ACGT", "TGCA"))


def only_bases(seq) -> Column:
    """Letters A, C, G, T only."""
    return F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "")


def slice_closed(seq, start, end) -> Column:
    """Letters from ``start`` to ``end``, 1-based and closed; empty if they lie apart."""
    return F.substring(_c(seq), _c(start).cast("int"), F.greatest(F.lit(0), _c(end) - _c(start) + 1).cast("int"))


def flanked(seq, start, end, strand, flank: int, min_len: int = 100) -> Column:
    """Interval with ``flank`` letters on both sides, on its own strand.

    Null if the flanks pass the ends of the sequence, or if the result is shorter than ``min_len``.
    """
    s, e = _c(start) - flank, _c(end) + flank
    part = slice_closed(seq, s, e)
    ok = (s >= 1) & (e <= F.length(_c(seq))) & (F.length(part) >= min_len)
    return F.when(ok, F.when(_c(strand) == "-", reverse_complement(part)).otherwise(part))


def ends(seq, k: int) -> Column:
    return F.concat(F.left(_c(seq), F.lit(k)), F.right(_c(seq), F.lit(k)))


def words(seq, k: int) -> Column:
    """All words of ``k`` letters in order; no word for a shorter text.

    Overlapping matches of a look-ahead: the text is evaluated once, and the work grows with its length.
    """
    return F.regexp_extract_all(_c(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def one_hot(seq, width: int, alphabet: str = "ATCG") -> Column:
    """``width`` positions times four flags, one after another; positions beyond the text are 0."""
    s = _c(seq)
    at = lambda i: s.substr(i, F.lit(1))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.array(*[F.coalesce((at(i) == b).cast("int"), F.lit(0)) for b in alphabet])))


def one_hot_site(site, width: int = 15) -> Column:
    """Length and one-hot code of a duplication site; an unknown one, or one with N, has length ``width + 1`` and only ones."""
    s = _c(site)
    known = s.isNotNull() & ~F.contains(s, F.lit("N")) & (F.length(s) > 0)
    return F.when(known, F.concat(F.array(F.length(s)), one_hot(s, width))).otherwise(F.concat(F.array(F.lit(width + 1)), F.array_repeat(F.lit(1), width * 4)))


def multi_hot(labels, vocabulary: list[str]) -> Column:
    a = _c(labels)
    return F.array(*[F.coalesce(F.array_contains(a, v).cast("int"), F.lit(0)) for v in vocabulary])


def mismatches(a, b) -> Column:
    """Positions that differ between texts of one length; of the longer one the rest is ignored."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)


def edit_free_distance(a, b) -> Column:
    """Mismatches of the common length plus the difference in length."""
    return mismatches(a, b) + F.abs(F.length(_c(a)) - F.length(_c(b)))


def motif_pattern(motif: str) -> str:
    """Regular expression of a motif; one of eight letters or more may have one substitution."""
    if len(motif) < 8:
        return motif
    return "|".join(f"{motif[:i]}[ACGT]{motif[i + 1:]}" for i in range(len(motif)))


def motif_position(seq, motif: str) -> Column:
    """0-based position of the first match of a motif; -1 without one."""
    return F.regexp_instr(_c(seq), F.lit(f"({motif_pattern(motif)})")) - 1


def shared_site(left, right, lengths=(6, 5, 4)) -> Column:
    """First word of six, then five, then four letters (or of other lengths) of ``right`` that also occurs in ``left``; null without one."""
    pick = lambda k: F.get(F.filter(words(right, k), lambda w: ~F.contains(w, F.lit("N")) & F.array_contains(words(left, k), w)), F.lit(0))
    return F.coalesce(*[pick(k) for k in lengths])


def tail_run_end(seq, base: str, n: int = 6) -> Column:
    """0-based end of the last run of ``n`` equal bases; -1 without one."""
    s = _c(seq)
    r = F.locate(base * n, F.reverse(s))
    return F.when(r > 0, F.length(s) - r + 1).otherwise(-1)


def near_poly_tail(seq, n: int = 6, wrong: int = 1, reach: int = 5) -> Column:
    """Do ``n`` A or ``n`` T, with up to ``wrong`` others among them, end within ``reach`` of the end?"""
    s = F.right(_c(seq), F.lit(n + reach))
    other = lambda w, b: F.lit(n) - F.length(F.regexp_replace(w, f"[^{b}]", ""))
    return F.coalesce(F.exists(words(s, n), lambda w: (other(w, "A") <= wrong) | (other(w, "T") <= wrong)), F.lit(False))


def repeat_near_tail(seq, unit: int = 2, times: int = 3, reach: int = 5) -> Column:
    """Does a unit of ``unit`` letters or more, ``times`` times in a row, end within ``reach`` of the end?"""
    return _c(seq).rlike(f"(.{{{unit},}})\\1{{{times - 1}}}.{{0,{reach}}}$")


def tail_like_sine(seq, width: int = 20) -> Column:
    tail = F.right(_c(seq), F.lit(width))
    return near_poly_tail(tail) | repeat_near_tail(tail)


def at_share(seq) -> Column:
    s = _c(seq)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^AT]", "")) / F.length(s))


def jukes_cantor_time(identity, rate: float = 1.3e-8) -> Column:
    """Age in generations from the identity (0-1) of two copies; null where they are saturated."""
    d = 1 - _c(identity)
    return F.when(d < 0.75, -0.75 * F.log(1 - 4 * d / 3) / (2 * rate) + 0.0)


def jukes_cantor_identity(time, rate: float = 1.3e-8) -> Column:
    """Identity (0-1) that belongs to an age."""
    return 1 - 0.75 * (1 - F.exp(-8 * F.lit(rate) * _c(time) / 3))


def ungapped_left(row, col, n: int) -> Column:
    """Last ``n`` letters of an aligned row up to the 1-based column, gaps left out."""
    return F.right(F.replace(F.left(_c(row), _c(col)), F.lit("-"), F.lit("")), F.lit(n))


def ungapped_right(row, col, n: int) -> Column:
    """First ``n`` letters of an aligned row from the 1-based column on, gaps left out."""
    s = _c(row)
    return F.left(F.replace(s.substr(_c(col), F.length(s)), F.lit("-"), F.lit("")), F.lit(n))


def aligned_site(row, start, end, lengths=range(11, 1, -1)) -> Column:
    """Shortest duplicated site (11 to 2 letters) around the columns ``start`` to ``end`` of an aligned row.

    Sites of eight letters or more may differ in one position; the left copy comes out, null without one.
    """
    found = []
    for n in sorted(lengths):
        a, b = ungapped_left(row, _c(start) - 1, n), ungapped_right(row, _c(end) + 1, n)
        same = (a == b) if n < 8 else (mismatches(a, b) <= 1)
        found.append(F.when((F.length(a) == n) & (F.length(b) == n) & same, a))
    return F.coalesce(*found)


def terminal_split(header, seq, most: int = 60) -> tuple[Column, Column]:
    """Terminal and internal part by the positions in a header: ``LTR:a-b,c-d`` or ``TIR:a-b,d-c``.

    The terminal part is the left one; of an inverted repeat ``most`` letters of it. The internal part lies
    between both. Without positions the terminal part is empty and the internal one is all.
    """
    at = lambda kind, i: F.regexp_extract(_c(header), rf"{kind}:(\d+)-(\d+),(\d+)-(\d+)", i).try_cast("int")
    a, b, c, d = (F.coalesce(at("LTR", i), at("TIR", i)) for i in (1, 2, 3, 4))
    left = slice_closed(seq, a, b)
    terminal = F.when(at("LTR", 1).isNotNull(), left).when(a.isNotNull(), F.left(left, F.lit(most))).otherwise("")
    return terminal, F.when(a.isNotNull(), slice_closed(seq, b + 1, F.least(c, d) - 1)).otherwise(_c(seq))


def tandem_share(seq, unit: int = 6, times: int = 5) -> Column:
    """Share of the letters in runs of a unit of up to ``unit`` letters, ``times`` times or more; null for an empty text."""
    s = _c(seq)
    rest = F.regexp_replace(s, f"([ACGT]{{1,{unit}}}?)\\1{{{times - 1},}}", "")
    return F.when(F.length(s) > 0, 1 - F.length(rest) / F.length(s))
