"""Queries of joins, interval algebra and greedy de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import chains, greedy
from seqloom.operators import intervals as iv
from seqloom.operators.running import following, numbered
from seqloom.queries.registry import registry
from seqloom.session import table

QUERIES, SQL, query = registry()

#: Annotations and copies on one coordinate axis: genome plus number within it.
_AXIS = "genome || ':' || regexp_extract({0}, '([0-9]+)$', 1)"
_A = f"a AS (SELECT DISTINCT ann_id, {_AXIS.format('seq_name')} AS chrom, seq_begin AS a_start, seq_end AS a_end, trim(ele) AS ele FROM rm_out WHERE genome IS NOT NULL AND seq_name IS NOT NULL AND seq_begin <= seq_end)"
_B = f"b AS (SELECT DISTINCT copy_id, {_AXIS.format('chrom')} AS chrom, te_start + 1 AS b_start, te_end AS b_end, trim(te_name) AS te_name FROM te_copies WHERE genome IS NOT NULL AND chrom IS NOT NULL AND te_start < te_end)"
_OV = "greatest(0, least(a_end, b_end) - greatest(a_start, b_start))"


def _axis(c: str):
    return F.concat("genome", F.lit(":"), F.regexp_extract(c, "([0-9]+)$", 1))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "rm_out").filter("genome is not null and seq_name is not null and seq_begin <= seq_end")
    return t.select("ann_id", _axis("seq_name").alias("chrom"), F.col("seq_begin").alias("a_start"), F.col("seq_end").alias("a_end"), F.trim("ele").alias("ele")).distinct()


def copies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "te_copies").filter("genome is not null and chrom is not null and te_start < te_end")
    return t.select("copy_id", _axis("chrom").alias("chrom"), (F.col("te_start") + 1).alias("b_start"), F.col("te_end").alias("b_end"), F.trim("te_name").alias("te_name")).distinct()


def _binned(spark, d, width=100_000):
    a, b = annotations(spark, d), copies(spark, d)
    return a.withColumn("bin", iv.nearest_bin(F.col("a_start"), F.col("a_end"), width)), b.withColumn("bin", iv.nearest_bin(F.col("b_start"), F.col("b_end"), width))


_BIN = "CASE WHEN {0}_start // 100000 = {0}_end // 100000 THEN {0}_start // 100000 WHEN abs({0}_end // 100000 * 100000 - {0}_start) < abs({0}_end - {0}_end // 100000 * 100000) THEN {0}_end // 100000 ELSE {0}_start // 100000 END"
_SAME = "a.chrom = b.chrom AND a_start <= b_end AND b_start <= a_end"


@query("join_j1_overlap_pairs", f"WITH {_A}, {_B} SELECT ann_id, copy_id, {_OV} AS shared FROM a JOIN b ON {_SAME}")
def j1(spark, d):
    """All pairs of annotation and copy that share a base."""
    p = iv.overlap_join(annotations(spark, d), copies(spark, d), ["chrom"], "a_start", "a_end", "b_start", "b_end")
    return p.select("ann_id", "copy_id", iv.overlap_len("a_start", "a_end", "b_start", "b_end").alias("shared"))


@query("join_j1_reciprocal_bin", f"WITH {_A}, {_B}, x AS (SELECT *, {_BIN.format('a')} AS bin FROM a), y AS (SELECT *, {_BIN.format('b')} AS bin FROM b) SELECT ann_id, copy_id FROM x a JOIN y b ON a.chrom = b.chrom AND a.bin = b.bin WHERE a_end > a_start AND b_end > b_start AND {_OV} >= 0.5 * (a_end - a_start) AND {_OV} >= 0.5 * (b_end - b_start)")
def j1b(spark, d):
    """Reciprocal overlap of half the length or more within the bin that holds most of either side."""
    a, b = _binned(spark, d)
    ov = iv.overlap_len("a_start", "a_end", "b_start", "b_end")
    la, lb = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    return a.join(b, ["chrom", "bin"]).filter((la > 0) & (lb > 0) & (ov >= 0.5 * la) & (ov >= 0.5 * lb)).select("ann_id", "copy_id")


@query("join_j2_bins", f"WITH {_A} SELECT ann_id, CAST({_BIN.format('a')} AS BIGINT) AS bin FROM a")
def j2(spark, d):
    return _binned(spark, d)[0].select("ann_id", "bin")


@query("join_j3_overlap_length", "SELECT ordinal, greatest(0, least(te_end, te_start + 500) - greatest(te_start, te_end - 300)) AS shared FROM te_copies")
def j3(spark, d):
    return table(spark, d, "te_copies").select("ordinal", iv.overlap_len("te_start", "te_end", F.col("te_end") - 300, F.col("te_start") + 500).alias("shared"))


@query("join_j4_reciprocal_share", f"WITH {_A}, {_B} SELECT ann_id, copy_id, round({_OV} / nullif(a_end - a_start, 0), 6) AS share_a, round({_OV} / nullif(b_end - b_start, 0), 6) AS share_b FROM a JOIN b ON {_SAME}")
def j4(spark, d):
    p = iv.overlap_join(annotations(spark, d), copies(spark, d), ["chrom"], "a_start", "a_end", "b_start", "b_end")
    ov = iv.overlap_len("a_start", "a_end", "b_start", "b_end")
    z = lambda a, b: F.round(ov / F.nullif(F.col(b) - F.col(a), F.lit(0)), 6)
    return p.select("ann_id", "copy_id", z("a_start", "a_end").alias("share_a"), z("b_start", "b_end").alias("share_b"))


_L = "l AS (SELECT DISTINCT ltr_id, trim(chr) AS chrom, least(element_start, element_end) AS s, greatest(element_start, element_end) AS e FROM ltr_intact WHERE trim(chr) <> '' AND element_start >= 1 AND element_end >= 1)"


def elements(spark: SparkSession, d: str, pre: str = "") -> DataFrame:
    t = table(spark, d, "ltr_intact").filter("trim(chr) <> '' and element_start >= 1 and element_end >= 1")
    return t.select(F.col("ltr_id").alias(f"{pre}id"), F.trim("chr").alias("chrom"), F.least("element_start", "element_end").alias(f"{pre}s"), F.greatest("element_start", "element_end").alias(f"{pre}e")).distinct()


@query("join_j6_nested_elements", f"WITH {_L} SELECT DISTINCT i.ltr_id AS inner_id, o.ltr_id AS outer_id FROM l i JOIN l o ON i.chrom = o.chrom AND o.s < i.s AND i.e < o.e")
def j6(spark, d):
    """Elements that lie strictly inside another one."""
    p = iv.overlap_join(elements(spark, d, "i_"), elements(spark, d, "o_"), ["chrom"], "i_s", "i_e", "o_s", "o_e")
    return p.filter("o_s < i_s and i_e < o_e").select(F.col("i_id").alias("inner_id"), F.col("o_id").alias("outer_id")).distinct()


@query("join_j7_validated_copies", f"WITH {_A}, {_B} SELECT copy_id FROM b WHERE EXISTS (SELECT 1 FROM a WHERE {_SAME} AND {_OV} >= 0.95 * (b_end - b_start))")
def j7(spark, d):
    p = iv.overlap_join(copies(spark, d), annotations(spark, d), ["chrom"], "b_start", "b_end", "a_start", "a_end")
    return p.filter(iv.overlap_len("a_start", "a_end", "b_start", "b_end") >= 0.95 * (F.col("b_end") - F.col("b_start"))).select("copy_id").distinct()


@query("join_j8_gene_proximity", f"""WITH {_A}, g AS (SELECT ltr_id AS gene, chrom2 AS chrom, s AS g_start, e AS g_end, strand FROM (SELECT DISTINCT ltr_id, genome || ':' || regexp_extract(trim(chr), '([0-9]+)$', 1) AS chrom2, least(element_start, element_end) AS s, greatest(element_start, element_end) AS e, coalesce(strand, '?') AS strand FROM ltr_intact WHERE trim(chr) <> '' AND genome IS NOT NULL AND element_start >= 1 AND element_end >= 1))
SELECT gene, ann_id, CASE WHEN a_start <= g_end AND g_start <= a_end THEN 'Inside' WHEN (a_end < g_start) = (strand <> '-') THEN 'Upstream' ELSE 'Downstream' END AS place,
 CASE WHEN a_start <= g_end AND g_start <= a_end THEN 0 ELSE least(abs(a_end - g_start), abs(a_start - g_end)) END AS distance FROM g JOIN a ON a.chrom = g.chrom AND a_start <= g_end + 5000 AND g_start - 5000 <= a_end""")
def j8(spark, d):
    """Annotations in or within 5,000 bases of a gene, with side (by strand) and distance."""
    t = table(spark, d, "ltr_intact").filter("trim(chr) <> '' and genome is not null and element_start >= 1 and element_end >= 1")
    t = t.withColumn("c", F.trim("chr"))
    g = t.select(F.col("ltr_id").alias("gene"), _axis("c").alias("chrom"), F.least("element_start", "element_end").alias("g_start"), F.greatest("element_start", "element_end").alias("g_end"), F.coalesce("strand", F.lit("?")).alias("strand")).distinct()
    g = g.withColumns({"w_start": F.col("g_start") - 5000, "w_end": F.col("g_end") + 5000})
    p = iv.overlap_join(g, annotations(spark, d), ["chrom"], "w_start", "w_end", "a_start", "a_end")
    return p.select("gene", "ann_id", iv.side("a_start", "a_end", "g_start", "g_end", "strand").alias("place"), iv.distance("a_start", "a_end", "g_start", "g_end").alias("distance"))


@query("join_j9_adjacent_pairs", f"WITH {_L}, n AS (SELECT *, lead(ltr_id) OVER w AS next_id, lead(s) OVER w - e AS away FROM l WINDOW w AS (PARTITION BY chrom ORDER BY s, e, ltr_id)) SELECT ltr_id, next_id, away, chrom || ':' || s || '-LTR' AS ltr_name, chrom || ':' || s || '-INT' AS internal_name FROM n WHERE away BETWEEN 0 AND 9")
def j9(spark, d):
    """Neighbouring elements with a gap under 10, named as the terminal and the internal part of one element."""
    t = following(elements(spark, d), ["chrom"], "s", F.struct("id", "s"), "next", ["e", "id"])
    n = t.select("chrom", "s", F.col("id").alias("ltr_id"), F.col("next.id").alias("next_id"), (F.col("next.s") - F.col("e")).alias("away")).filter("away between 0 and 9")
    place = F.concat("chrom", F.lit(":"), F.col("s").cast("string"))
    return n.select("ltr_id", "next_id", "away", F.concat(place, F.lit("-LTR")).alias("ltr_name"), F.concat(place, F.lit("-INT")).alias("internal_name"))


def _plain_join(name, sql, f):
    query(name, sql)(f)


_plain_join("join_j10_lookup", "SELECT c.ordinal, l.wicker FROM te_copies c JOIN te_library l ON l.te_name = c.te_name", lambda s, d: table(s, d, "te_copies").select("ordinal", "te_name").join(table(s, d, "te_library").select("te_name", "wicker"), "te_name").select("ordinal", "wicker"))
_plain_join("join_j11_right", "SELECT l.te_name, c.ordinal FROM te_copies c RIGHT JOIN te_library l ON l.te_name = c.te_name", lambda s, d: table(s, d, "te_copies").select("ordinal", "te_name").join(table(s, d, "te_library").select("te_name"), "te_name", "right").select("te_name", "ordinal"))
_plain_join("join_j12_inner_two_keys", "WITH a AS (SELECT genome, trim(ele) AS n, count(*) AS x FROM rm_out GROUP BY 1, 2), b AS (SELECT genome, trim(te_name) AS n, count(*) AS y FROM te_copies GROUP BY 1, 2) SELECT genome, n, x, y FROM a JOIN b USING (genome, n)", lambda s, d: table(s, d, "rm_out").groupBy("genome", F.trim("ele").alias("n")).agg(F.count(F.lit(1)).alias("x")).join(table(s, d, "te_copies").groupBy("genome", F.trim("te_name").alias("n")).agg(F.count(F.lit(1)).alias("y")), ["genome", "n"]))
_plain_join("join_j13_left", "SELECT r.ann_id, r.ordinal, g.species FROM rm_out r LEFT JOIN genomes g USING (genome)", lambda s, d: table(s, d, "rm_out").select("ann_id", "ordinal", "genome").join(table(s, d, "genomes").select("genome", "species"), "genome", "left").drop("genome"))
_plain_join("join_j14_combine_one", "SELECT genome, size_mb / (SELECT sum(size_mb) FROM genomes) > 0.05 AS large FROM genomes", lambda s, d: table(s, d, "genomes").select("genome", (F.col("size_mb") / table(s, d, "genomes").agg(F.sum("size_mb")).scalar() > 0.05).alias("large")))
_plain_join("join_j15_anti_listed", "SELECT seq_id FROM sequences WHERE seq_id NOT IN (SELECT seq_id FROM sequences WHERE length(chrseq) < 1000)", lambda s, d: table(s, d, "sequences").select("seq_id").join(table(s, d, "sequences").filter("length(chrseq) < 1000").select("seq_id"), "seq_id", "left_anti"))
_plain_join("join_j16_anti_confirmed", "SELECT te_name FROM te_library WHERE te_name NOT IN (SELECT trim(te_name) FROM te_copies WHERE te_name IS NOT NULL)", lambda s, d: table(s, d, "te_library").select("te_name").join(table(s, d, "te_copies").filter("te_name is not null").select(F.trim("te_name").alias("te_name")), "te_name", "left_anti"))
_plain_join("join_j18_semi", "SELECT ordinal FROM te_copies WHERE genome IN (SELECT genome FROM genomes WHERE is_plant = 1)", lambda s, d: table(s, d, "te_copies").select("ordinal", "genome").join(table(s, d, "genomes").filter("is_plant = 1").select("genome"), "genome", "left_semi").select("ordinal"))
_plain_join("join_j22_no_self", f"WITH {_L} SELECT DISTINCT a.ltr_id AS x, b.ltr_id AS y FROM l a JOIN l b ON a.chrom = b.chrom AND a.s <= b.e AND b.s <= a.e AND a.ltr_id < b.ltr_id", lambda s, d: iv.overlap_join(elements(s, d, "i_"), elements(s, d, "o_"), ["chrom"], "i_s", "i_e", "o_s", "o_e").filter("i_id < o_id").select(F.col("i_id").alias("x"), F.col("o_id").alias("y")).distinct())


@query("join_j17_anti_by_cluster", "WITH c AS (SELECT ordinal, te_fam, bool_or(te_name LIKE '%#%' OR te_name LIKE 'te.%') OVER (PARTITION BY te_fam) AS known FROM te_copies) SELECT ordinal, te_fam FROM c WHERE NOT known")
def j17(spark, d):
    """Members of clusters without a library member; the clusters' states are joined, so no cluster is gathered."""
    t = table(spark, d, "te_copies").select("ordinal", "te_name", "te_fam")
    known = t.groupBy("te_fam").agg(F.bool_or(F.col("te_name").like("%#%") | F.col("te_name").like("te.%")).alias("known")).filter("not known")
    return t.join(known.select(F.col("te_fam").alias("f")), F.col("te_fam").eqNullSafe(F.col("f")), "left_semi").select("ordinal", "te_fam")


@query("join_j19_semi_by_place", f"WITH {_A}, {_B}, n AS (SELECT chrom, a_start, a_end FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_SAME} AND a_end > a_start AND b_end > b_start AND {_OV} >= 0.5 * (a_end - a_start) AND {_OV} >= 0.5 * (b_end - b_start))) SELECT ordinal FROM rm_out r WHERE (genome || ':' || regexp_extract(seq_name, '([0-9]+)$', 1), seq_begin, seq_end) IN (SELECT chrom, a_start, a_end FROM n)")
def j19(spark, d):
    """Annotation lines, as delivered, at the places that no copy confirms by half of the length both ways."""
    a, b = annotations(spark, d), copies(spark, d)
    ov = iv.overlap_len("a_start", "a_end", "b_start", "b_end")
    la, lb = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    met = iv.overlap_join(a, b, ["chrom"], "a_start", "a_end", "b_start", "b_end").filter((la > 0) & (lb > 0) & (ov >= 0.5 * la) & (ov >= 0.5 * lb))
    missed = a.join(met.select("ann_id", "chrom", "a_start", "a_end").distinct(), ["ann_id", "chrom", "a_start", "a_end"], "left_anti").select("chrom", "a_start", "a_end")
    r = table(spark, d, "rm_out").select("ordinal", _axis("seq_name").alias("chrom"), F.col("seq_begin").alias("a_start"), F.col("seq_end").alias("a_end"))
    return r.join(missed, ["chrom", "a_start", "a_end"], "left_semi").select("ordinal")


_C2 = "TRY_CAST(regexp_replace({0}, '[()]', '', 'g') AS BIGINT)"


@query("join_j20_domain_cover", f"SELECT DISTINCT ann_id, ele FROM (SELECT ann_id, ele, {_C2.format('c2')} AS e, CASE WHEN strand = '+' THEN {_C2.format('c1')} ELSE {_C2.format('c3')} END AS b FROM rm_out) x JOIN te_library l ON l.te_name = x.ele WHERE (e - b) >= 0.95 * l.cons_len")
def j20(spark, d):
    """Hits that cover 95 % or more of their library entry."""
    bare = lambda c: F.regexp_replace(c, "[()]", "").try_cast("long")
    x = table(spark, d, "rm_out").select("ann_id", "ele", bare("c2").alias("e"), F.when(F.col("strand") == "+", bare("c1")).otherwise(bare("c3")).alias("b"))
    lib = table(spark, d, "te_library").select(F.col("te_name").alias("ele"), "cons_len")
    return x.join(lib, "ele").filter(F.col("e") - F.col("b") >= 0.95 * F.col("cons_len")).select("ann_id", "ele").distinct()


# ---- interval algebra


def _island_sql(rel: str, key: str, gap: str, out: str) -> str:
    return f"""m AS (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT DISTINCT {key}, s, e FROM {rel}) x),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT {key}, min(s) AS span_start, max(e) AS span_end FROM g GROUP BY {key}, grp) {out}"""


def _islands(name: str, gap: str, touch: int):
    @query(name, f"WITH {_L}, " + _island_sql("l", "chrom", gap, "SELECT chrom, span_start, span_end FROM p"))
    def run(spark, d):
        return iv.merged(elements(spark, d), ["chrom"], "s", "e", touch)


_islands("iv_i1_merge_touching", "s > pe", 0)
_islands("iv_i2_merge_gap_ten", "s > pe + 10", 10)


@query("v24_merge_strict", f"WITH {_L}, h AS (SELECT DISTINCT chrom, s, e FROM l WHERE s < e), " + _island_sql("h", "chrom", "s >= pe", "SELECT chrom, span_start, span_end FROM p"))
def v24(spark, d):
    """Half-open intervals that merely touch stay apart; empty ones are left out."""
    t = elements(spark, d).filter("s < e").withColumn("last", F.col("e") - 1)
    return iv.merged(t, ["chrom"], "s", "last", 0).select("chrom", "span_start", (F.col("span_end") + 1).alias("span_end"))


@query("v12_merge_two_lists", f"WITH {_A}, {_B}, u AS (SELECT chrom, a_start AS s, a_end AS e FROM a UNION ALL SELECT chrom, b_start, b_end FROM b), " + _island_sql("u", "chrom", "s > pe + 1", "SELECT chrom, span_start, span_end FROM p"))
def v12(spark, d):
    u = annotations(spark, d).select("chrom", F.col("a_start").alias("s"), F.col("a_end").alias("e")).unionByName(copies(spark, d).select("chrom", F.col("b_start").alias("s"), F.col("b_end").alias("e")))
    return iv.merged(u, ["chrom"], "s", "e")


@query("iv_i3_union_cover", f"WITH {_A}, u AS (SELECT ele, chrom, a_start AS s, a_end AS e FROM a WHERE ele <> ''), " + _island_sql("u", "ele, chrom", "s > pe + 1", "SELECT ele, CAST(sum(span_end - span_start + 1) AS BIGINT) AS covered FROM p GROUP BY ele"))
def i3(spark, d):
    t = annotations(spark, d).filter("ele <> ''")
    return iv.covered_bases(t, ["ele", "chrom"], "a_start", "a_end", by=["ele"])


@query("iv_i4_masked_bases", "WITH r AS (SELECT ordinal, genome, seq_name, seq_begin AS s, seq_end AS e, max(seq_end) OVER (PARTITION BY genome, seq_name ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rm_out WHERE pct_div BETWEEN 0 AND 40) SELECT ordinal, CAST(CASE WHEN s > coalesce(pe, 0) THEN e - s + 1 WHEN e <= coalesce(pe, 0) THEN 0 ELSE e - coalesce(pe, 0) END AS BIGINT) AS bp FROM r")
def i4(spark, d):
    t = table(spark, d, "rm_out").filter("pct_div between 0 and 40").select("ordinal", "genome", "seq_name", "seq_begin", "seq_end")
    return iv.running_masked(t, ["genome", "seq_name"], "ordinal", "seq_begin", "seq_end").select("ordinal", "bp")


# elements with sequences: element n has the sequence of seq_id n; other elements that share bases with it lie on it in proportion
_CUTS = f"""{_L}, s AS (SELECT seq_id, translate(upper(regexp_replace(chrseq, '\\s', '', 'g')), 'MYHRSKVDBW', 'CCCGGGGGGT') AS q FROM sequences WHERE chrseq IS NOT NULL),
o AS (SELECT l.*, q, length(q) AS n FROM l JOIN s ON s.seq_id = l.ltr_id WHERE length(q) > 0),
c AS (SELECT o.ltr_id, i.ltr_id AS inner_id, o.q, o.n, 1 + (greatest(i.s, o.s) - o.s) * o.n // (o.e - o.s + 1) AS a, (least(i.e, o.e) - o.s + 1) * o.n // (o.e - o.s + 1) AS b,
 (least(i.e, o.e) - greatest(i.s, o.s) + 1)::DOUBLE / (i.e - i.s + 1) AS cover FROM o JOIN l i ON i.chrom = o.chrom AND i.ltr_id <> o.ltr_id AND i.s <= o.e AND o.s <= i.e)"""
_REST = """m AS (SELECT *, max(b) OVER (PARTITION BY ltr_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM (SELECT DISTINCT ltr_id, a, b FROM c WHERE {0} AND b >= a) x),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ltr_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT ltr_id, min(a) AS a, max(b) AS b FROM g GROUP BY ltr_id, grp),
k AS (SELECT ltr_id, a, b, lag(b) OVER (PARTITION BY ltr_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY ltr_id ORDER BY a) AS after FROM p),
r AS (SELECT k.ltr_id, string_agg(substr(q, CAST(coalesce(before, 0) + 1 AS INTEGER), CAST(k.a - coalesce(before, 0) - 1 AS INTEGER)) || {1} || CASE WHEN after IS NULL THEN substr(q, CAST(k.b + 1 AS INTEGER)) ELSE '' END, '' ORDER BY k.a) AS rest FROM k JOIN (SELECT DISTINCT ltr_id, q FROM o) z USING (ltr_id) GROUP BY 1)"""


def with_sequence(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.queries.scalar import seqs

    t = seqs(spark, d).filter("q <> ''").select(F.col("seq_id").alias("o_id"), "q")
    return elements(spark, d, "o_").join(t, "o_id")


def element_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of the elements' sequences that other elements lie on: ``ltr_id, inner_id, a, b, cover`` (of the other element)."""
    o = with_sequence(spark, d).withColumn("n", F.length("q").cast("long")).drop("q")
    p = iv.overlap_join(o, elements(spark, d, "i_"), ["chrom"], "o_s", "o_e", "i_s", "i_e").filter("i_id <> o_id")
    lo, hi, width = F.greatest("i_s", "o_s"), F.least("i_e", "o_e"), F.col("o_e") - F.col("o_s") + 1
    whole = lambda x: F.floor(x * F.col("n") / width).cast("long")
    return p.select(F.col("o_id").alias("ltr_id"), F.col("i_id").alias("inner_id"), "n", (whole(lo - F.col("o_s")) + 1).alias("a"), whole(hi - F.col("o_s") + 1).alias("b"), ((hi - lo + 1) / (F.col("i_e") - F.col("i_s") + 1)).alias("cover"))


def _without(spark: SparkSession, d: str, cuts: DataFrame, fill: str | None = None) -> DataFrame:
    t = with_sequence(spark, d).select(F.col("o_id").alias("ltr_id"), "q").distinct()
    return iv.subtract_from_text(t, "ltr_id", "q", cuts.filter("b >= a").select("ltr_id", "a", "b"), "a", "b", fill=fill)


def _rest_sql(cond: str, fill: str) -> str:
    return f"WITH {_CUTS}, {_REST.format(cond, fill)} SELECT DISTINCT o.ltr_id, coalesce(r.rest, o.q) AS rest FROM o LEFT JOIN r USING (ltr_id)"


@query("iv_i5_subtract", _rest_sql("true", "''"))
def i5(spark, d):
    """Sequences of elements without all stretches on which other elements lie."""
    return _without(spark, d, element_cuts(spark, d)).select("ltr_id", F.col("q").alias("rest"))


@query("iv_i6_subtract_covered", _rest_sql("cover >= 0.95", "''"))
def i6(spark, d):
    """The same, but only for other elements of which 95 % or more lie on the sequence."""
    return _without(spark, d, element_cuts(spark, d).filter("cover >= 0.95")).select("ltr_id", F.col("q").alias("rest"))


@query(
    "iv_i7_unnest",
    f"""WITH {_CUTS}, k AS (SELECT c.ltr_id, a, b, q, row_number() OVER (PARTITION BY c.ltr_id ORDER BY b - a DESC, a) AS r FROM c JOIN (SELECT ltr_id AS inner_id, max(ltr_identity) AS identity FROM ltr_intact GROUP BY 1) USING (inner_id)
 WHERE cover >= 0.95 AND identity >= 95 AND b >= a AND c.n - (b - a + 1) >= 100)
SELECT DISTINCT o.ltr_id, CASE WHEN k.ltr_id IS NULL THEN o.q ELSE substr(o.q, 1, CAST(a - 1 AS INTEGER)) || substr(o.q, CAST(b + 1 AS INTEGER)) END AS rest FROM o LEFT JOIN k ON k.ltr_id = o.ltr_id AND k.r = 1""",
)
def i7(spark, d):
    """Sequences with the one nested element cut out that leaves the shortest rest of 100 letters or more; unchanged without any.

    Nested: 95 % of it lie on the sequence, at an identity of 95. Nested elements are alternatives, always cut from the whole.
    """
    good = table(spark, d, "ltr_intact").groupBy(F.col("ltr_id").alias("inner_id")).agg(F.max("ltr_identity").alias("identity")).filter("identity >= 95")
    c = element_cuts(spark, d).filter("cover >= 0.95 and b >= a and n - (b - a + 1) >= 100").join(good, "inner_id")
    best = c.groupBy("ltr_id").agg(F.min_by(F.struct("a", "b"), F.struct(F.col("a") - F.col("b"), "a")).alias("x")).select("ltr_id", "x.*")
    return _without(spark, d, best).select("ltr_id", F.col("q").alias("rest"))


@query("iv_i8_mask", _rest_sql("true", "repeat('N', CAST(k.b - k.a + 1 AS INTEGER))"))
def i8(spark, d):
    """Sequences of elements with N for every letter on which another element lies."""
    return _without(spark, d, element_cuts(spark, d), fill="N").select("ltr_id", F.col("q").alias("rest"))


@query("iv_i9_confusion", f"""WITH {_A}, {_B}, ev AS (SELECT chrom, pos, sum(x) AS x, sum(y) AS y FROM (SELECT chrom, a_start AS pos, 1 AS x, 0 AS y FROM a UNION ALL SELECT chrom, a_end + 1, -1, 0 FROM a UNION ALL SELECT chrom, b_start, 0, 1 FROM b UNION ALL SELECT chrom, b_end + 1, 0, -1 FROM b) GROUP BY 1, 2),
st AS (SELECT chrom, sum(x) OVER w AS x, sum(y) OVER w AS y, lead(pos) OVER w - pos AS n FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, CAST(coalesce(sum(CASE WHEN x > 0 AND y > 0 THEN n END), 0) AS BIGINT) AS tp, CAST(coalesce(sum(CASE WHEN x > 0 AND y = 0 THEN n END), 0) AS BIGINT) AS fn, CAST(coalesce(sum(CASE WHEN x = 0 AND y > 0 THEN n END), 0) AS BIGINT) AS fp FROM st GROUP BY chrom""")
def i9(spark, d):
    a = annotations(spark, d).select("chrom", F.col("a_start").alias("s"), F.col("a_end").alias("e"))
    return iv.confusion_bases(a, copies(spark, d).select("chrom", F.col("b_start").alias("s"), F.col("b_end").alias("e")), ["chrom"], "s", "e")


@query("iv_i10_positional_dedup")
def i10(spark, d):
    """First of each run of elements that overlap by 95 % both ways, in order of position."""
    return greedy.keep_first_overlapping(elements(spark, d), ["chrom"], "id", "s", "e", 0.95).select(F.col("id").alias("ltr_id"))


@query("iv_i11_run_heads")
def i11(spark, d):
    return greedy.run_heads(elements(spark, d), ["chrom"], "id", "s", "e", 0.95).select(F.col("id").alias("ltr_id"), F.col("head_id").cast("long").alias("head_id"))


@query("iv_i12_contained_copies", f"WITH {_L} SELECT DISTINCT a.ltr_id FROM l a JOIN l b ON a.chrom = b.chrom AND a.ltr_id <> b.ltr_id AND a.s <= b.e AND b.s <= a.e WHERE a.e - a.s < b.e - b.s AND a.e > a.s AND greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) >= 0.95 * (a.e - a.s)")
def i12(spark, d):
    p = iv.overlap_join(elements(spark, d, "i_"), elements(spark, d, "o_"), ["chrom"], "i_s", "i_e", "o_s", "o_e").filter("i_id <> o_id and i_e - i_s < o_e - o_s and i_e > i_s")
    return p.filter(iv.overlap_len("i_s", "i_e", "o_s", "o_e") >= 0.95 * (F.col("i_e") - F.col("i_s"))).select(F.col("i_id").alias("ltr_id")).distinct()


@query(
    "iv_i13_flank_cover",
    f"""WITH {_A}, {_B}, h AS (SELECT copy_id, b_start, b_end, greatest(a_start, b_start - 100) AS s, least(a_end, b_end + 100) AS e FROM a JOIN b ON a.chrom = b.chrom AND a_start <= b_end + 100 AND b_start - 100 <= a_end),
m AS (SELECT *, max(e) OVER (PARTITION BY copy_id, b_start, b_end ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT DISTINCT * FROM h) x),
c AS (SELECT copy_id, b_start, b_end, min(s) AS new_start, max(e) AS new_end, CAST(sum(CASE WHEN pe IS NULL OR s > pe THEN e - s + 1 WHEN e <= pe THEN 0 ELSE e - pe END) AS BIGINT) AS covered FROM m GROUP BY 1, 2, 3)
SELECT *, covered < 0.9 * (new_end - new_start + 1) AS false_positive FROM c""",
)
def i13(spark, d):
    """Boundaries of copies moved to the outermost base that hits cover within 100 bases of them; false if the hits cover under 90 % of what lies between."""
    b = copies(spark, d).withColumns({"w_start": F.col("b_start") - 100, "w_end": F.col("b_end") + 100})
    p = iv.overlap_join(b, annotations(spark, d), ["chrom"], "w_start", "w_end", "a_start", "a_end")
    p = p.select("copy_id", "b_start", "b_end", F.greatest("a_start", "w_start").alias("s"), F.least("a_end", "w_end").alias("e"))
    key = ["copy_id", "b_start", "b_end"]
    g = p.groupBy(*key).agg(F.min("s").alias("new_start"), F.max("e").alias("new_end")).join(iv.covered_bases(p, key, "s", "e"), key)
    return g.withColumn("false_positive", F.col("covered") < 0.9 * (F.col("new_end") - F.col("new_start") + 1))


@query(
    "iv_i14_slop",
    f"""WITH z AS (SELECT {_AXIS.format('seq_name')} AS chrom, max(seq_end + try_cast(regexp_replace(left_bp, '[()]', '', 'g') AS BIGINT)) AS size FROM rm_out WHERE genome IS NOT NULL AND seq_name IS NOT NULL GROUP BY 1)
SELECT ordinal, greatest(0, te_start - CASE WHEN strand = '-' THEN 20 ELSE 50 END) AS s, least(size, te_end + CASE WHEN strand = '-' THEN 50 ELSE 20 END) AS e FROM te_copies c LEFT JOIN z ON z.chrom = c.genome || ':' || regexp_extract(c.chrom, '([0-9]+)$', 1)""",
)
def i14(spark, d):
    """Flanks of 50 bases before and 20 after a copy on its own strand, within the sequence; without a bound where its length is not known."""
    bare = F.regexp_replace("left_bp", "[()]", "").try_cast("long")
    z = table(spark, d, "rm_out").filter("genome is not null and seq_name is not null").groupBy(_axis("seq_name").alias("axis")).agg(F.max(F.col("seq_end") + bare).alias("size"))
    t = table(spark, d, "te_copies").select("ordinal", "te_start", "te_end", "strand", _axis("chrom").alias("axis")).join(z, "axis", "left")
    back = F.coalesce(F.col("strand") == "-", F.lit(False))
    return t.select("ordinal", F.greatest(F.lit(0), F.col("te_start") - F.when(back, 20).otherwise(50)).alias("s"), F.least("size", F.col("te_end") + F.when(back, 50).otherwise(20)).alias("e"))


@query("v10_nesting_depth", f"WITH {_L} SELECT i.ltr_id, count(DISTINCT o.ltr_id) AS depth FROM l i LEFT JOIN l o ON i.chrom = o.chrom AND o.s < i.s AND i.e < o.e GROUP BY 1")
def v10(spark, d):
    e = elements(spark, d).select(F.col("id").alias("ltr_id")).distinct()
    return e.join(j6(spark, d).groupBy(F.col("inner_id").alias("ltr_id")).agg(F.count_distinct("outer_id").alias("depth")), "ltr_id", "left").fillna(0, ["depth"])


@query("v25_regions", f"WITH {_L} SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY s, e, ltr_id) - 1 AS region_no, ltr_id, s AS region_start, e AS region_end FROM l")
def v25(spark, d):
    """Regions of each chromosome in order of position, one row each: a list per chromosome would not fit a row."""
    g = numbered(elements(spark, d), ["chrom"], "s", "region_no", ["e", "id"])
    return g.select("chrom", "region_no", F.col("id").alias("ltr_id"), F.col("s").alias("region_start"), F.col("e").alias("region_end"))


@query("v25_regions_by_name", f"WITH {_A} SELECT ele, row_number() OVER (PARTITION BY ele ORDER BY a_start, a_end, ann_id, chrom) - 1 AS region_no, ann_id, chrom, a_start AS region_start, a_end AS region_end FROM a WHERE ele <> ''")
def v25_names(spark, d):
    """Regions of each name; a name that holds a tenth of all rows is spread over stretches of the axis."""
    g = numbered(annotations(spark, d).filter("ele <> ''"), ["ele"], "a_start", "region_no", ["a_end", "ann_id", "chrom"])
    return g.select("ele", "region_no", "ann_id", "chrom", F.col("a_start").alias("region_start"), F.col("a_end").alias("region_end"))


# ---- chains of hits


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of library entries on sequences, made of annotations: query, subject and both coordinate pairs."""
    bare = lambda c: F.regexp_replace(c, "[()]", "").try_cast("long")
    plus = F.col("strand") == "+"
    t = table(spark, d, "rm_out").filter("ele is not null and strand in ('+', 'C') and genome is not null")
    b, e = F.when(plus, bare("c1")).otherwise(bare("c3")), bare("c2")
    left = F.when(plus, bare("c3")).otherwise(bare("c1"))
    t = t.select("ann_id", F.trim("ele").alias("query"), F.concat("genome", F.lit(":"), "seq_name").alias("subject"), b.alias("q_start"), e.alias("q_end"), (e + left).alias("q_len"), F.when(plus, F.col("seq_begin")).otherwise(F.col("seq_end")).alias("s_start"), F.when(plus, F.col("seq_end")).otherwise(F.col("seq_begin")).alias("s_end"))
    return t.filter("q_start is not null and q_end is not null and q_len is not null").distinct()


def _gap_share(t: DataFrame) -> DataFrame:
    return t.withColumn("gap", F.floor(F.col("q_len") * 0.5).cast("long"))


@query("chain_g1_extend")
def g1(spark, d):
    """Chains of hits whose gaps on both sides stay under half of the query length."""
    return chains.chain_hits(_gap_share(hits(spark, d)), "gap", all_compatible=True)


@query("chain_g2_longest")
def g2(spark, d, t: float = 0.3):
    """Hits that lie close together (under half of the query length on the subject) are one cluster; of the chains of a cluster the longest

    counts, if it covers ``t`` of the query; of each query the longest 101 places stay.
    """
    return _longest_of_clusters(spark, d, t)


def _longest_of_clusters(spark, d, cover: float):
    t = hits(spark, d).withColumn("gap", F.floor(F.col("q_len") * 0.5).cast("long")).withColumns({"lo": F.least("s_start", "s_end"), "hi": F.greatest("s_start", "s_end"), "plus": F.col("s_start") <= F.col("s_end")})
    n = t.groupBy("query").agg(F.max("q_len").alias("q_len"))
    # close: each hit reaches half of the query length further
    reach = t.withColumn("far", F.col("hi") + F.greatest(F.col("gap") - 1, F.lit(0)))
    spans = iv.merged(reach, ["query", "subject", "plus"], "lo", "far", 0).select("query", "subject", "plus", F.col("span_start").alias("c_start"), F.col("span_end").alias("c_end"))
    c = chains.chain_hits(t, "gap", all_compatible=True).withColumnRenamed("forward", "plus").withColumns({"lo": F.least("s_start", "s_end"), "hi": F.greatest("s_start", "s_end")})
    c = iv.overlap_join(c, spans, ["query", "subject", "plus"], "lo", "hi", "c_start", "c_end").join(n, "query")
    best = c.groupBy("query", "subject", "plus", "c_start").agg(F.max_by(F.struct("q_start", "q_end", "s_start", "s_end", "n_hits", "q_len"), F.struct(F.col("q_end") - F.col("q_start"), F.col("hi") - F.col("lo"), -F.col("lo"), -F.col("q_start"))).alias("x"))
    best = best.select("query", "subject", F.col("plus").alias("forward"), "x.*").filter(F.col("q_end") - F.col("q_start") + 1 >= cover * F.col("q_len")).drop("q_len")
    w = W.partitionBy("query").orderBy(F.desc(F.abs(F.col("s_end") - F.col("s_start"))), "subject", "s_start", "s_end", "q_start", "q_end")
    return best.withColumn("rank", F.row_number().over(w)).filter("rank <= 101")


@query("chain_g3_full_length")
def g3(spark, d, t: float = 0.95):
    """Chains that cover ``t`` of the query or more, of a subject length that differs by no more than that share."""
    h = hits(spark, d)
    n = h.groupBy("query").agg(F.max("q_len").alias("q_len"))
    c = chains.chain_hits(h.withColumn("gap", F.floor(F.col("q_len") * (1 - t)).cast("long")), "gap", all_compatible=True).join(n, "query")
    q, s = F.col("q_end") - F.col("q_start") + 1, F.abs(F.col("s_end") - F.col("s_start")) + 1
    return c.filter((q >= t * F.col("q_len")) & (F.least(q, s) >= t * F.greatest(q, s))).drop("q_len")


@query("chain_g3_share_of_length")
def g3_share(spark, d):
    """The same for chains of 30 %, of which these hits have some."""
    return g3(spark, d, 0.3)


@query("chain_g6_fixed_gap")
def g6(spark, d):
    return chains.chain_hits(hits(spark, d).withColumn("gap", F.lit(200).cast("long")), "gap", all_compatible=False)


@query("chain_g5_protein")
def g5(spark, d):
    """Chains with a gap of 300 bases on the subject and a third of it on the query; overlaps of over half are dropped."""
    c = chains.chain_hits(hits(spark, d).withColumn("gap", F.lit(300).cast("long")), "gap", all_compatible=True, q_share=1 / 3)
    c = c.withColumns({"s": F.least("s_start", "s_end"), "e": F.greatest("s_start", "s_end")})
    return greedy.drop_overlapping(c, ["subject"], "s", "e", 0.5).drop("s", "e")
