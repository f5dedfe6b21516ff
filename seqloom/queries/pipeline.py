"""Queries of the general data-preparation operators (p1, p4, p6) with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import intervals, rejects, skew
from seqloom.queries.registry import registry
from seqloom.session import materialize, table

QUERIES, SQL, query = registry()


def trimmed(c: str) -> Column:
    return F.trim(F.col(c))


def element_name(c: str) -> Column:
    """Name without outer spaces and one trailing underscore; null if nothing is left."""
    return F.nullif(F.regexp_replace(trimmed(c), r"_\z", ""), F.lit(""))


def class_name(c: str) -> Column:
    """Class without outer spaces and question marks; null if nothing is left."""
    return F.nullif(F.replace(trimmed(c), F.lit("?"), F.lit("")), F.lit(""))


# ---- p1: overlapping and gapped intervals

_LTR_SQL = """SELECT DISTINCT trim(chr) AS chr, least(element_start, element_end) AS s, greatest(element_start, element_end) AS e
  FROM ltr_intact WHERE trim(chr) <> '' AND element_start >= 1 AND element_end >= 1"""
_P1_SQL = f"""WITH iv AS ({_LTR_SQL}),
m AS (SELECT chr, s, e, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT chr, grp, min(s) AS span_start, max(e) AS span_end, count(*) AS n FROM g GROUP BY chr, grp),
q AS (SELECT *, lead(span_start) OVER (PARTITION BY chr ORDER BY span_start) AS nx FROM p)"""


def ltr_elements(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ltr_intact")
    t = t.select(trimmed("chr").alias("chr"), "element_start", "element_end")
    return t.filter("chr <> '' and element_start >= 1 and element_end >= 1")


@query(
    "p1_found",
    _P1_SQL
    + """ SELECT chr, 'period' AS kind, span_start, span_end FROM p
UNION ALL SELECT chr, 'gap', span_end + 1, nx - 1 FROM q WHERE nx IS NOT NULL""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(ltr_elements(spark, d), ["chr"], "element_start", "element_end")


@query(
    "p1_chr_cover",
    _P1_SQL
    + """, k AS (SELECT chr, count(*) AS n_periods, sum(span_end - span_start + 1) AS covered, min(span_start) AS first_base, max(span_end) AS last_base FROM p GROUP BY chr)
SELECT chr, CAST(n_periods AS BIGINT) AS n_periods, CAST(covered AS BIGINT) AS covered, CAST(last_base - first_base + 1 - covered AS BIGINT) AS uncovered FROM k""",
)
def p1_chr_cover(spark: SparkSession, d: str) -> DataFrame:
    x = p1_found(spark, d).withColumn("n", F.col("span_end") - F.col("span_start") + 1)
    z = lambda kind, v: F.coalesce(F.sum(F.when(F.col("kind") == kind, v)), F.lit(0)).cast("long")
    return x.groupBy("chr").agg(z("period", F.lit(1)).alias("n_periods"), z("period", F.col("n")).alias("covered"), z("gap", F.col("n")).alias("uncovered"))


# ---- p4: a few keys hold most rows

_RM_SQL = """rm AS (SELECT ann_id, nullif(regexp_replace(trim(any_value(ele)), '_$', ''), '') AS key_name,
  any_value(genome) AS genome, any_value(seq_name) AS seq, any_value(seq_begin) AS b, any_value(seq_end) AS e
  FROM (SELECT * FROM rm_out WHERE ann_id IS NOT NULL) GROUP BY ann_id)"""
_TE_SQL = """te AS (SELECT copy_id, nullif(trim(any_value(te_name)), '') AS key_name,
  any_value(genome) AS genome, any_value(chrom) AS seq, any_value(te_start) + 1 AS b, any_value(te_end) AS e
  FROM (SELECT * FROM te_copies WHERE copy_id IS NOT NULL) GROUP BY copy_id)"""


def rm_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations once each: ``key_name, genome, seq, b, e`` (closed)."""
    t = table(spark, d, "rm_out").select("ann_id", "ordinal", element_name("ele").alias("key_name"), "genome", F.col("seq_name").alias("seq"), F.col("seq_begin").alias("b"), F.col("seq_end").alias("e"))
    return skew.deliver_once(t, "ann_id", ["ordinal"])


def te_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies once each, with closed coordinates."""
    t = table(spark, d, "te_copies").select("copy_id", "ordinal", F.nullif(trimmed("te_name"), F.lit("")).alias("key_name"), "genome", F.col("chrom").alias("seq"), (F.col("te_start") + 1).alias("b"), F.col("te_end").alias("e"))
    return skew.deliver_once(t, "copy_id", ["ordinal"])


def p4_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Compact states of both inputs by name: rows and summed length."""
    key, length = {"key_name": F.col("key_name")}, F.col("e") - F.col("b") + 1
    rm = skew.compact_state(rm_annotations(spark, d), key, {"ann_bases": length}, "n_ann")
    te = skew.compact_state(te_copies(spark, d), key, {"copy_bases": length}, "n_copies")
    return rm, te


@query(
    "p4_found",
    f"""WITH {_RM_SQL}, {_TE_SQL}
SELECT 'ele' AS field_name, key_name FROM rm WHERE key_name IS NOT NULL GROUP BY key_name HAVING count(*) * 100 >= (SELECT count(*) FROM rm)
UNION ALL SELECT 'te_name', key_name FROM te WHERE key_name IS NOT NULL GROUP BY key_name HAVING count(*) * 100 >= (SELECT count(*) FROM te)""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold at least 1 % of the records of either table, from compact states that are written once and rolled up."""
    key = {"key_name": F.col("key_name")}
    rm = skew.compact_state(rm_annotations(spark, d), key, {}, "n").select(F.lit("ele").alias("field_name"), "key_name", "n")
    te = skew.compact_state(te_copies(spark, d), key, {}, "n").select(F.lit("te_name").alias("field_name"), "key_name", "n")
    return skew.key_share_at_least(materialize(rm.unionByName(te), "states"), "field_name", "key_name", "n", 1)


def _covered_sql(t: str) -> str:
    return f"""{t}m AS (SELECT *, max(e) OVER (PARTITION BY key_name, genome, seq ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM
 (SELECT DISTINCT key_name, genome, seq, least(b, e) AS b, greatest(b, e) AS e FROM {t}) x WHERE key_name IS NOT NULL AND genome IS NOT NULL AND seq IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL),
{t}c AS (SELECT key_name, sum(CASE WHEN pe IS NULL OR b > pe THEN e - b + 1 WHEN e <= pe THEN 0 ELSE e - pe END) AS covered FROM {t}m GROUP BY key_name),
{t}n AS (SELECT key_name, count(*) AS n FROM {t} WHERE key_name IS NOT NULL GROUP BY key_name)"""


@query(
    "p4_name_cover",
    f"""WITH {_RM_SQL}, {_TE_SQL}, {_covered_sql("rm")}, {_covered_sql("te")}
SELECT 'ele' AS field_name, n.key_name, n.n AS n_records, CAST(coalesce(c.covered, 0) AS BIGINT) AS covered_bases FROM rmn n LEFT JOIN rmc c USING (key_name)
UNION ALL SELECT 'te_name', n.key_name, n.n, CAST(coalesce(c.covered, 0) AS BIGINT) FROM ten n LEFT JOIN tec c USING (key_name)""",
)
def p4_name_cover(spark: SparkSession, d: str) -> DataFrame:
    """Records and distinct covered bases of each name, in one pass. Hot names are spread over sequences and position buckets."""
    parts = []
    for field, t in (("ele", rm_annotations(spark, d)), ("te_name", te_copies(spark, d))):
        c = intervals.covered_bases(t.filter("key_name is not null"), ["key_name", "genome", "seq"], "b", "e", ["key_name"], "n_records")
        parts.append(c.select(F.lit(field).alias("field_name"), "key_name", "n_records", F.col("covered").alias("covered_bases")))
    return parts[0].unionByName(parts[1])


@query(
    "p4_class_totals",
    f"""WITH {_RM_SQL}, {_TE_SQL},
j AS (SELECT r.key_name, r.e - r.b + 1 AS ann_bases, t.e - t.b + 1 AS copy_bases FROM rm r JOIN te t ON r.key_name = t.key_name)
SELECT coalesce(l.te_class, 'not in library') AS te_class, count(*) AS n_pairs, CAST(coalesce(sum(ann_bases), 0) AS BIGINT) AS ann_bases, CAST(coalesce(sum(copy_bases), 0) AS BIGINT) AS copy_bases
FROM j LEFT JOIN te_library l ON l.te_name = j.key_name GROUP BY ALL""",
)
def p4_class_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals by library class of annotations joined with copies of the same name; the join itself is never formed."""
    rm, te = p4_states(spark, d)
    j = skew.eager_join_totals(rm, te, "key_name", "n_ann", "n_copies", ["ann_bases"], ["copy_bases"])
    lib = table(spark, d, "te_library").select(F.col("te_name").alias("key_name"), "te_class")
    j = j.join(lib, "key_name", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return j.groupBy(F.coalesce("te_class", F.lit("not in library")).alias("te_class")).agg(F.sum("n_pairs").cast("long").alias("n_pairs"), z("ann_bases"), z("copy_bases"))


# ---- p6: rows that fail to parse

_P6_SQL = r"""WITH a AS (SELECT record_id, fmt, regexp_replace(line_text, '\r$', '') AS t FROM raw_records WHERE line_text IS NOT NULL),
b AS (SELECT * FROM a WHERE NOT regexp_full_match(t, '[ \t]*') AND t NOT LIKE '#%' AND NOT (coalesce(fmt, '') = 'out' AND regexp_matches(t, '^[ \t]*(SW|score)([ \t]|$)'))),
te AS (SELECT record_id, t, CASE WHEN contains(t, '"') THEN regexp_extract_all(t, '(?:^|\t)("[^"]*(?:""[^"]*)*"|[^"\t]*)', 1) ELSE string_split(t, chr(9)) END AS raw FROM b WHERE fmt = 'te'),
te2 AS (SELECT record_id, array_to_string(raw, chr(9)) = t AS whole,
  list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM te),
te3 AS (SELECT record_id, coalesce(whole AND len(f) = 8 AND regexp_full_match(f[1], '[A-Za-z0-9_.\-]+') AND regexp_full_match(f[2], '[0-9]+') AND regexp_full_match(f[3], '[0-9]+')
  AND try_cast(f[2] AS HUGEINT) < try_cast(f[3] AS HUGEINT) AND f[4] IN ('+', '-', 'C') AND f[5] <> '' AND regexp_full_match(f[8], '[0-9]+|\.'), false) AS ok, whole, f FROM te2),
ou AS (SELECT record_id, string_split_regex(regexp_replace(t, '^ +', ''), ' +') AS f FROM b WHERE fmt = 'out'),
ou2 AS (SELECT record_id, coalesce((len(f) = 15 OR len(f) = 16 AND f[16] = '*') AND regexp_full_match(f[1], '[0-9]+')
  AND regexp_full_match(f[2], '[0-9]+(\.[0-9]+)?') AND regexp_full_match(f[3], '[0-9]+(\.[0-9]+)?') AND regexp_full_match(f[4], '[0-9]+(\.[0-9]+)?')
  AND try_cast(f[2] AS DOUBLE) <= 100 AND try_cast(f[3] AS DOUBLE) <= 100 AND try_cast(f[4] AS DOUBLE) <= 100
  AND regexp_full_match(f[5], '[A-Za-z0-9_.\-]+') AND regexp_full_match(f[6], '[0-9]+') AND regexp_full_match(f[7], '[0-9]+') AND try_cast(f[6] AS HUGEINT) <= try_cast(f[7] AS HUGEINT)
  AND regexp_full_match(f[8], '\([0-9]+\)') AND regexp_full_match(f[13], '[0-9]+') AND regexp_full_match(f[15], '[0-9]+')
  AND (f[9] = '+' AND regexp_full_match(f[12], '[0-9]+') AND regexp_full_match(f[14], '\([0-9]+\)') OR f[9] = 'C' AND regexp_full_match(f[14], '[0-9]+') AND regexp_full_match(f[12], '\([0-9]+\)')), false) AS ok, f FROM ou)"""


def raw_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut into fields; written once, as values, their dictionary and structural faults each read them."""
    return materialize(rejects.parse_lines(table(spark, d, "raw_records")).drop("line_text"), "parsed")


@query(
    "p6_found",
    _P6_SQL + " SELECT record_id FROM te3 WHERE NOT ok UNION ALL SELECT record_id FROM ou2 WHERE NOT ok UNION ALL SELECT record_id FROM b WHERE fmt IS NULL OR fmt NOT IN ('te', 'out')",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(raw_parsed(spark, d)).select("record_id")


@query("p6_reasons")
def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(raw_parsed(spark, d)).select("record_id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "p6_te_rows",
    _P6_SQL
    + """ SELECT record_id, f[1] AS chrom, try_cast(f[2] AS BIGINT) AS te_start, try_cast(f[3] AS BIGINT) AS te_end, f[4] AS strand, f[5] AS te_name, f[6] AS te_fam, f[7] AS te_class, try_cast(f[8] AS BIGINT) AS score,
 nullif(array_to_string(list_filter([CASE WHEN try_cast(f[2] AS BIGINT) IS NULL THEN 'te_start=' || f[2] END, CASE WHEN try_cast(f[3] AS BIGINT) IS NULL THEN 'te_end=' || f[3] END, CASE WHEN f[8] <> '.' AND try_cast(f[8] AS BIGINT) IS NULL THEN 'score=' || f[8] END], lambda x: x IS NOT NULL), ';'), '') AS too_large FROM te3 WHERE ok""",
)
def p6_te_rows(spark: SparkSession, d: str) -> DataFrame:
    p = raw_parsed(spark, d)
    return rejects.typed_te(p, rejects.rejects(p))


@query(
    "p6_out_rows",
    _P6_SQL
    + """, o AS (SELECT record_id, f, list_transform(f, lambda x: try_cast(replace(replace(x, '(', ''), ')', '') AS BIGINT)) AS n FROM ou2 WHERE ok)
SELECT record_id, n[1] AS sw_score, n[6] AS seq_begin, n[7] AS seq_end, n[15] AS hit_id, CAST(f[2] AS DOUBLE) AS pct_div, CAST(f[3] AS DOUBLE) AS pct_del, CAST(f[4] AS DOUBLE) AS pct_ins,
 f[5] AS seq_name, f[9] AS strand, f[10] AS ele, f[11] AS ele_class, n[8] AS left_bp, CASE WHEN f[9] = '+' THEN n[12] ELSE n[14] END AS rep_begin, n[13] AS rep_end,
 CASE WHEN f[9] = '+' THEN n[14] ELSE n[12] END AS rep_left, len(f) = 16 AS overlapped,
 nullif(array_to_string(list_filter([CASE WHEN n[1] IS NULL THEN 'sw_score=' || f[1] END, CASE WHEN n[6] IS NULL THEN 'seq_begin=' || f[6] END, CASE WHEN n[7] IS NULL THEN 'seq_end=' || f[7] END, CASE WHEN n[15] IS NULL THEN 'hit_id=' || f[15] END, CASE WHEN n[8] IS NULL THEN 'left_bp=' || replace(replace(f[8], '(', ''), ')', '') END,
  CASE WHEN f[9] = '+' AND n[12] IS NULL THEN 'rep_begin=' || f[12] WHEN f[9] <> '+' AND n[14] IS NULL THEN 'rep_begin=' || f[14] END, CASE WHEN n[13] IS NULL THEN 'rep_end=' || f[13] END,
  CASE WHEN f[9] = '+' AND n[14] IS NULL THEN 'rep_left=' || replace(replace(f[14], '(', ''), ')', '') WHEN f[9] <> '+' AND n[12] IS NULL THEN 'rep_left=' || replace(replace(f[12], '(', ''), ')', '') END], lambda x: x IS NOT NULL), ';'), '') AS too_large FROM o""",
)
def p6_out_rows(spark: SparkSession, d: str) -> DataFrame:
    p = raw_parsed(spark, d)
    return rejects.typed_out(p, rejects.rejects(p))
