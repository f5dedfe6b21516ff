"""Loading of line records: rows that fail to parse come out with the reason, the rest typed.

Two formats: ``te`` (8 tab-separated fields, optional double quotes) and ``out`` (15 or 16
fields between runs of spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

TE_FIELDS = ("chrom", "te_start", "te_end", "strand", "te_name", "te_fam", "te_class", "score")
OUT_FIELDS = ("sw_score", "pct_div", "pct_del", "pct_ins", "seq_name", "seq_begin", "seq_end", "left_bp", "strand", "ele", "ele_class", "c1", "c2", "c3", "hit_id")

#: Patterns of whole values; ``\\z``, as ``$`` would accept a line end after them.
NUMBER, NAME, DECIMAL, PAREN = r"\A[0-9]+\z", r"\A[A-Za-z0-9_.\-]+\z", r"\A[0-9]+(\.[0-9]+)?\z", r"\A\([0-9]+\)\z"
#: A field in double quotes as a whole, or one without any; possessive, so that long fields cannot overflow the stack.
_FIELD = r'(?:^|\t)("[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)'


def number_le(a: Column, b: Column, strict: bool = False) -> Column:
    """Compare strings of ASCII digits of any length as numbers."""
    x, y = F.ltrim(a, F.lit("0")), F.ltrim(b, F.lit("0"))
    low = (x < y) if strict else (x <= y)
    return (F.length(x) < F.length(y)) | ((F.length(x) == F.length(y)) & low)


def split_te(line: Column) -> Column:
    """Fields as written, quotes included; null where quoting is broken."""
    plain = F.split(line, "\t", -1)
    quoted = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    return F.when(~F.contains(line, F.lit('"')), plain).when(F.array_join(quoted, "\t") == line, quoted)


def unquote(field: Column) -> Column:
    return F.when(F.startswith(field, F.lit('"')), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def split_out(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "^ +", ""), " +", -1)


def column_rule(fmt: Column, col: Column, v: Column) -> Column:
    """Reason why a value is invalid in its column (1-based); null if it is valid or anything may stand there."""
    bad = lambda ok, why: F.when(~ok, F.lit(why))
    num, name = v.rlike(NUMBER), v.rlike(NAME)
    pct = v.rlike(DECIMAL) & F.coalesce(v.try_cast("double") <= 100, F.lit(False))
    te = (
        F.when(col == 1, bad(name, "chrom is not a name"))
        .when(col.isin(2, 3), bad(num, "coordinate is not a number"))
        .when(col == 4, bad(v.isin("+", "-", "C"), "strand is not +, - or C"))
        .when(col == 5, bad(v != "", "te_name is empty"))
        .when(col == 8, bad(num | (v == "."), "score is not a number or ."))
    )
    out = (
        F.when(col.isin(1, 15), bad(num, "score or id is not a number"))
        .when(col.isin(2, 3, 4), bad(pct, "percentage is not a number up to 100"))
        .when(col == 5, bad(name, "seq_name is not a name"))
        .when(col.isin(6, 7), bad(num, "coordinate is not a number"))
        .when(col == 8, bad(v.rlike(PAREN), "bases left are not a number in parentheses"))
        .when(col == 9, bad(v.isin("+", "C"), "strand is not + or C"))
        .when(col.isin(12, 13, 14), bad(num | v.rlike(PAREN), "repeat position is not a number"))
    )
    return F.when(fmt == "te", te).when(fmt == "out", out)


CHECKED = {"te": (1, 2, 3, 4, 5, 8), "out": (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 15)}


def parse_lines(df: DataFrame, record_id: str = "record_id", fmt: str = "fmt", line: str = "line_text") -> DataFrame:
    """Structure of each line: ``row, record_id, fmt, line_text, fields, fault, clash``.

    ``row`` numbers the lines, as record ids may repeat or be null; write the result before it is read several times.

    Lines that are no records are left out: null, nothing but spaces and tabs, those that begin
    with ``#``, and header lines of ``out`` (first word ``SW`` or ``score``). One carriage return
    at the end is ignored. ``fault`` is the structural reason: unknown format (also a null one),
    broken quoting or wrong column count; null if the columns can be told apart. ``clash`` names what is wrong
    between values (ends out of order, repeat positions that do not fit the strand) in case these are valid;
    no pattern is matched here, as every distinct value is checked by its column's rule once.
    """
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(record_id).alias("record_id"), F.col(fmt).alias("fmt"), text.alias("line_text"))
    head = F.coalesce(F.col("fmt") == "out", F.lit(False)) & F.col("line_text").rlike(r"^[ \t]*(SW|score)([ \t]|\z)")
    base = base.filter(F.col("line_text").isNotNull() & ~F.col("line_text").rlike(r"\A[ \t]*\z") & ~F.startswith("line_text", F.lit("#")) & ~head)
    raw = F.when(F.col("fmt") == "te", split_te(F.col("line_text"))).when(F.col("fmt") == "out", split_out(F.col("line_text")))
    f = base.withColumn("raw", raw)
    f = f.withColumn("fields", F.when(F.col("fmt") == "te", F.transform("raw", unquote)).otherwise(F.col("raw"))).drop("raw")
    x = lambda i: F.get(F.col("fields"), F.lit(i - 1))
    n = F.size("fields")
    te = F.when(F.col("fields").isNull(), "broken quoting").when(n != 8, "wrong column count")
    out = F.when(~((n == 15) | ((n == 16) & (x(16) == "*"))), "wrong column count")
    fault = F.when(F.col("fmt") == "te", te).when(F.col("fmt") == "out", out).otherwise("unknown format")
    f = f.withColumn("fault", fault)
    # how values stand to each other; counts only where the values themselves turn out valid
    paren = lambda i: F.startswith(x(i), F.lit("("))
    shape = ~paren(13) & F.when(x(9) == "+", ~paren(12) & paren(14)).otherwise(~paren(14) & paren(12))
    clash = (
        F.when(F.col("fault").isNotNull(), F.lit(None))
        .when(F.col("fmt") == "te", F.when(~number_le(x(2), x(3), strict=True), F.array(F.lit(ORDER))))
        .when(F.col("fmt") == "out", F.array_compact(F.array(F.when(~number_le(x(6), x(7)), F.lit(ORDER)), F.when(~shape, F.lit(SHAPE)))))
    )
    return f.withColumn("clash", F.when(F.size(clash) > 0, clash))


#: Faults between values, the columns that they depend on, and their wording.
ORDER, SHAPE = "order", "shape"
DEPENDS = {("te", ORDER): (2, 3), ("out", ORDER): (6, 7), ("out", SHAPE): (9, 12, 13, 14)}
WORDING = {("te", ORDER): "start is not before end", ("out", ORDER): "begin is after end", ("out", SHAPE): "repeat positions do not fit the strand"}


def _values(parsed: DataFrame, columns: dict[str, tuple[int, ...]] = CHECKED) -> DataFrame:
    """One row for each of the columns of lines whose columns could be told apart: ``row, col, value``.

    ``col`` is the column of the format, plus 100 for ``out``, so that rows stay short.
    """
    cols = F.when(F.col("fmt") == "te", F.array(*[F.lit(i) for i in columns["te"]])).otherwise(F.array(*[F.lit(100 + i) for i in columns["out"]]))
    ok = parsed.filter("fault is null").select("row", "fields", F.explode(cols).alias("col"))
    return ok.select("row", "col", F.get("fields", F.col("col") % 100 - 1).alias("value"))


def invalid_values(parsed: DataFrame) -> DataFrame:
    """Dictionary of invalid values ``col, value, why``: each distinct value of a column is checked once."""
    distinct = _values(parsed).select("col", "value").distinct()
    fmt = F.when(F.col("col") > 100, "out").otherwise("te")
    return distinct.withColumn("why", column_rule(fmt, F.col("col") % 100, F.col("value"))).filter("why is not null")


def rejects(parsed: DataFrame) -> DataFrame:
    """Failing lines with all their reasons, sorted: ``row, record_id, reasons``.

    The dictionary of invalid values is joined back to the fields; a value that many lines share
    is looked up per line but was checked once. Structural faults are added per line, faults between
    values where these values are valid. A line of a repeated or null id fails or not on its own.
    """
    none = F.lit(None)
    by_value = _values(parsed).join(invalid_values(parsed), ["col", "value"]).select("row", "why", "col", none.cast("array<int>").alias("on"))
    by_line = parsed.filter("fault is not null").select("row", F.col("fault").alias("why"), none.cast("int").alias("col"), none.cast("array<int>").alias("on"))
    c = parsed.filter("clash is not null").select("row", "fmt", F.explode("clash").alias("kind"))
    pick = lambda of: F.coalesce(*[F.when((F.col("fmt") == f) & (F.col("kind") == k), v) for (f, k), v in of.items()])
    on = {k: F.array(*[F.lit(i + (100 if k[0] == "out" else 0)) for i in v]) for k, v in DEPENDS.items()}
    clashes = c.select("row", pick({k: F.lit(v) for k, v in WORDING.items()}).alias("why"), none.cast("int").alias("col"), pick(on).alias("on"))
    g = by_value.unionByName(by_line).unionByName(clashes).groupBy("row").agg(F.collect_set(F.struct("why", "on")).alias("all"), F.collect_set("col").alias("bad"))
    valid = F.filter("all", lambda r: r["on"].isNull() | ~F.arrays_overlap(r["on"], F.col("bad")))
    bad = g.select("row", F.array_sort(F.array_distinct(F.transform(valid, lambda r: r["why"]))).alias("reasons"))
    return parsed.select("row", "record_id").join(bad, "row").select("row", "record_id", "reasons")


NUMERIC = {"te": (2, 3, 8), "out": (1, 2, 3, 4, 6, 7, 8, 12, 13, 14, 15)}
#: A value in more than one of so many fields is looked up in a table sent to all tasks, which this bounds.
HOT_SHARE = 1000


def _numbers(good: DataFrame) -> DataFrame:
    """Numbers of each valid line: ``row, numbers``, a map of column to ``whole, part, text``.

    Each distinct value is cast once and joined back. The values that hold a thousandth or more of all fields,
    a thousand at most, are sent to all tasks; the others meet by value, without a hot one among them.
    """
    v = _values(good, NUMERIC)
    d = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    bare = F.regexp_replace("value", r"[()]", "")
    d = materialize(d.select("value", "n", F.struct(bare.try_cast("long").alias("whole"), F.col("value").try_cast("double").alias("part"), bare.alias("text")).alias("x")), "numbers")
    often = (F.col("n") * HOT_SHARE >= d.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()) & (F.length("value") <= 64)
    hot = d.filter(often).select("value", "x")
    met = v.join(F.broadcast(hot.select("value", F.col("x").alias("h"))), "value", "left")
    rare = met.filter("h is null").select("row", "col", "value").join(d.filter(~often).select("value", "x"), "value")
    both = met.filter("h is not null").select("row", "col", F.col("h").alias("x")).unionByName(rare.select("row", "col", "x"))
    return both.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col") % 100, "x"))).alias("numbers"))


def _good(parsed: DataFrame, rejected: DataFrame, fmt: str) -> DataFrame:
    good = parsed.filter((F.col("fmt") == fmt) & F.col("fault").isNull()).join(rejected.select("row"), "row", "left_anti")
    return good.join(_numbers(good), "row")


def _too_large(names: dict[str, Column]) -> Column:
    """Numbers beyond a long, as text: ``name=value`` parted by semicolons; null where all fit."""
    parts = F.array_compact(F.array(*[F.when(c["whole"].isNull() & (c["text"] != "."), F.concat(F.lit(f"{n}="), c["text"])) for n, c in names.items()]))
    return F.when(F.size(parts) > 0, F.array_join(parts, ";"))


def typed_te(parsed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Valid ``te`` lines with typed values. The score ``.`` is null.

    A number beyond a long is null in its own column and stands as text in ``too_large``. Repeated lines give a row each.
    """
    good = _good(parsed, rejected, "te")
    x = {n: F.get("fields", F.lit(i)) for i, n in enumerate(TE_FIELDS)}
    num = {n: F.col("numbers")[F.lit(i)] for n, i in (("te_start", 2), ("te_end", 3), ("score", 8))}
    return good.select("record_id", *[(num[n]["whole"] if n in num else c).alias(n) for n, c in x.items()], _too_large(num).alias("too_large"))


def typed_out(parsed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Valid ``out`` lines with typed values. ``overlapped`` tells whether the line ended with ``*``.

    Repeat positions come out by meaning whatever the strand: begin, end and bases left. Numbers
    beyond a long are null and stand in ``too_large``, as in ``typed_te``.
    """
    good = _good(parsed, rejected, "out")
    x = {n: F.get("fields", F.lit(i)) for i, n in enumerate(OUT_FIELDS)}
    at = lambda i: F.col("numbers")[F.lit(i)]
    plus = x["strand"] == "+"
    num = {
        "sw_score": at(1), "seq_begin": at(6), "seq_end": at(7), "hit_id": at(15), "left_bp": at(8),
        "rep_begin": F.when(plus, at(12)).otherwise(at(14)), "rep_end": at(13), "rep_left": F.when(plus, at(14)).otherwise(at(12)),
    }
    return good.select(
        "record_id",
        *[c["whole"].alias(n) for n, c in num.items()],
        *[at(i)["part"].alias(n) for n, i in (("pct_div", 2), ("pct_del", 3), ("pct_ins", 4))],
        *[x[n].alias(n) for n in ("seq_name", "strand", "ele", "ele_class")],
        (F.size("fields") == 16).alias("overlapped"),
        _too_large(num).alias("too_large"),
    )
