"""Queries of aggregations, ordered operators, set operations, reshaping and whole analyses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import stats
from seqloom.operators import intervals as iv
from seqloom.operators.running import numbered, running
from seqloom.plans import annotation, evaluation, expression, pan
from seqloom.queries.registry import registry
from seqloom.queries.scalar import _S, seqs
from seqloom.session import table

QUERIES, SQL, query = registry()


def q(name: str, sql: str | None = None):
    """Register ``lambda t, spark, d``, where ``t(name)`` loads a table."""

    def add(f):
        def run(spark, d):
            return f(lambda n: table(spark, d, n), spark, d)

        run.__name__, run.__doc__ = name, f.__doc__
        query(name, sql)(run)
        return f

    return add



def rows_n():
    return F.count(F.lit(1)).alias("n")


# ---- annotation summary

_H = """h0 AS (SELECT *, max(seq_end) OVER (PARTITION BY genome, seq_name ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
 lag(trim(ele)) OVER (PARTITION BY genome, seq_name, hit_id ORDER BY ordinal) AS pel, nullif(replace(trim(ele_class), '?', ''), '') AS cls FROM rm_out WHERE pct_div BETWEEN 0 AND 40),
h AS (SELECT genome, seq_name, trim(ele) AS element, coalesce(string_split(cls, '/')[1], 'Unspecified') AS type, coalesce(string_split(cls, '/')[2], 'Unspecified') AS subtype,
 CASE WHEN seq_begin > coalesce(pe, 0) THEN seq_end - seq_begin + 1 WHEN seq_end <= coalesce(pe, 0) THEN 0 ELSE seq_end - coalesce(pe, 0) END AS bp,
 CASE WHEN hit_id IS NULL OR pel IS NULL OR pel <> trim(ele) OR ele IS NULL THEN 1 ELSE 0 END AS is_new FROM h0)"""


def _hits(t):
    return annotation.hits(t("rm_out"))


q("agg_a2_by_element", f"WITH {_H} SELECT element, CAST(sum(is_new) AS BIGINT) AS n, CAST(sum(bp) AS BIGINT) AS bp FROM h GROUP BY 1")(lambda t, s, d: annotation.by_element(_hits(t)))
q("agg_a2_by_type", f"WITH {_H}, g AS (SELECT type, subtype, sum(is_new) AS n, sum(bp) AS bp FROM h GROUP BY 1, 2 UNION ALL SELECT type, 'all', sum(is_new), sum(bp) FROM h GROUP BY 1) SELECT type, subtype, CAST(n AS BIGINT) AS n, CAST(bp AS BIGINT) AS bp, type NOT IN ('Simple_repeat', 'Low_complexity', 'Satellite', 'rRNA', 'scRNA', 'snRNA', 'srpRNA', 'tRNA') AS interspersed FROM g")(lambda t, s, d: annotation.by_type(_hits(t)))
q("agg_a2_by_sequence", f"WITH {_H} SELECT seq_name, CAST(sum(is_new) AS BIGINT) AS n, CAST(sum(bp) AS BIGINT) AS bp FROM h GROUP BY 1")(lambda t, s, d: _hits(t).groupBy("seq_name").agg(F.sum("is_new").alias("n"), F.sum("bp").alias("bp")))
q("agg_a4_masked_percent", f"WITH {_H}, z AS (SELECT genome, CAST(size_mb * 1000000 AS BIGINT) AS size FROM genomes WHERE size_mb IS NOT NULL) SELECT genome, CAST(sum(bp) AS BIGINT) AS bp, any_value(size) AS size, round(sum(bp) * 100.0 / any_value(size), 6) AS percent FROM h JOIN z USING (genome) GROUP BY 1")(
    lambda t, s, d: annotation.masked_share(_hits(t), t("genomes").filter("size_mb is not null").select("genome", (F.col("size_mb") * 1000000).cast("long").alias("size"))).withColumn("percent", F.round("percent", 6))
)
q("agg_a1_collect", "SELECT genome, list(te_name ORDER BY te_name) AS names FROM (SELECT DISTINCT genome, te_name FROM te_copies WHERE te_name IS NOT NULL) GROUP BY 1")(lambda t, s, d: t("te_copies").filter("te_name is not null").groupBy("genome").agg(F.array_sort(F.collect_set("te_name")).alias("names")))
q("agg_a3_distinct_ids", "SELECT genome, count(DISTINCT hit_id) AS n FROM rm_out GROUP BY 1")(lambda t, s, d: t("rm_out").groupBy("genome").agg(F.count_distinct("hit_id").alias("n")))
q("agg_a5_class_ratio", "SELECT te_class, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM te_copies), 6) AS ratio, count(DISTINCT genome) AS species FROM te_copies GROUP BY 1")(
    lambda t, s, d: t("te_copies").groupBy("te_class").agg(rows_n(), F.count_distinct("genome").alias("species")).select("te_class", "n", F.round(F.col("n") / t("te_copies").agg(F.count(F.lit(1))).scalar(), 6).alias("ratio"), "species")
)


def _fragments(t, name, cols):
    x = t(name).select(*[F.expr(e).alias(a) for a, e in cols.items()]).filter("chrom is not null and start is not null and end is not null")
    return x.distinct()


_STD = {"chrom": "concat(genome, ':', regexp_extract(seq_name, '([0-9]+)$', 1))", "id": "ann_id", "start": "seq_begin", "end": "seq_end"}
_TEST = {"chrom": "concat(genome, ':', regexp_extract(chrom, '([0-9]+)$', 1))", "id": "copy_id", "start": "te_start + 1", "end": "te_end"}
_EV = """s AS (SELECT DISTINCT genome || ':' || regexp_extract(seq_name, '([0-9]+)$', 1) AS chrom, ann_id AS id, seq_begin AS a, seq_end AS b FROM rm_out WHERE seq_begin IS NOT NULL AND seq_end IS NOT NULL AND genome IS NOT NULL AND seq_name IS NOT NULL),
t AS (SELECT DISTINCT genome || ':' || regexp_extract(chrom, '([0-9]+)$', 1) AS chrom, copy_id AS id, te_start + 1 AS a, te_end AS b FROM te_copies WHERE te_start IS NOT NULL AND te_end IS NOT NULL AND genome IS NOT NULL AND chrom IS NOT NULL),"""
_BIN = "CASE WHEN {0}.a // 100000 = {0}.b // 100000 THEN {0}.a // 100000 WHEN abs({0}.b // 100000 * 100000 - {0}.a) < abs({0}.b - {0}.b // 100000 * 100000) THEN {0}.b // 100000 ELSE {0}.a // 100000 END"
_MET = """x AS (SELECT (SELECT coalesce(sum(n), 0) FROM h) AS tp, (SELECT coalesce(sum(b - a), 0) FROM t WHERE id NOT IN (SELECT t_id FROM h)) AS fp, (SELECT coalesce(sum(b - a), 0) FROM s WHERE id NOT IN (SELECT s_id FROM h)) AS fn)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS sensitivity, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round(fp::DOUBLE / nullif(tp + fp, 0), 4) AS fdr FROM x"""
_HIT = "h AS (SELECT s.id AS s_id, t.id AS t_id, t.b - t.a AS n FROM s JOIN t ON s.chrom = t.chrom AND {on} WHERE s.b > s.a AND t.b > t.a AND greatest(0, least(s.b, t.b) - greatest(s.a, t.a)) >= 0.5 * (s.b - s.a) AND greatest(0, least(s.b, t.b) - greatest(s.a, t.a)) >= 0.5 * (t.b - t.a))"
for _mode, _on in (("reference", f"{_BIN.format('s')} = {_BIN.format('t')}"), ("exact", "s.a <= t.b AND t.a <= s.b")):
    q(f"agg_a6_library_metrics_{_mode}", f"WITH {_EV} {_HIT.format(on=_on)}, {_MET}")(lambda t, s, d, m=_mode: evaluation.library_metrics(_fragments(t, "rm_out", _STD), _fragments(t, "te_copies", _TEST), 0.5, mode=m))

_PAIRS = "p AS (SELECT l.te_class AS truth, CASE WHEN r.ann_id % 7 = 0 THEN 'Unknown' ELSE coalesce(nullif(replace(trim(r.ele_class), '?', ''), ''), 'Unknown') END AS predicted FROM rm_out r JOIN te_library l ON l.te_name = r.ele)"


def _labels(t):
    lib = t("te_library").select(F.col("te_name").alias("ele"), F.col("te_class").alias("truth"))
    c = F.coalesce(F.nullif(F.replace(F.trim("ele_class"), F.lit("?"), F.lit("")), F.lit("")), F.lit("Unknown"))
    return t("rm_out").join(lib, "ele").select("truth", F.when(F.col("ann_id") % 7 == 0, "Unknown").otherwise(c).alias("predicted"))


_PC = f"""WITH {_PAIRS}, l AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p), c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE truth = label) AS actual, (SELECT count(*) FROM p WHERE predicted = label) AS called FROM l),
m AS (SELECT label, tp, actual, called, coalesce(tp::DOUBLE / nullif(called, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(actual, 0), 0) AS recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""
q("agg_a7_class_metrics", f"{_PC} SELECT label, tp, actual, called, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")(lambda t, s, d: evaluation.per_class(evaluation.confusion(_labels(t))).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")}))
q("agg_a7_macro_metrics", f"{_PC} SELECT round(sum(tp)::DOUBLE / sum(actual), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f")(lambda t, s, d: evaluation.macro(evaluation.per_class(evaluation.confusion(_labels(t)))))
q("agg_a8_confusion", f"WITH {_PAIRS} SELECT truth, predicted, count(*) AS n FROM p GROUP BY 1, 2")(lambda t, s, d: evaluation.confusion(_labels(t)))

# ---- expression near insertions (parts are genes, suppliers samples, line items insertions)

_EXPR = """e AS (SELECT l_partkey AS gene, l_suppkey AS sample, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_partkey AS gene, l_suppkey AS sample, CASE l_linenumber % 3 WHEN 0 THEN 'Upstream' WHEN 1 THEN 'Inside' ELSE 'Downstream' END AS position, l_orderkey AS ordinal FROM lineitem WHERE l_quantity > 25),
pl AS (SELECT e.gene, coalesce(a.position, 'No_Insertion') AS position, e.sample, any_value(e.value) AS value FROM e LEFT JOIN a ON a.gene = e.gene AND a.sample = e.sample GROUP BY 1, 2, 3),
mo AS (SELECT gene, position, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM pl GROUP BY 1, 2)"""


def _placed(t):
    li = t("lineitem")
    e = li.groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample")).agg(F.max("l_extendedprice").alias("value"))
    pos = F.when(F.col("l_linenumber") % 3 == 0, "Upstream").when(F.col("l_linenumber") % 3 == 1, "Inside").otherwise("Downstream")
    a = li.filter("l_quantity > 25").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), pos.alias("position"), F.col("l_orderkey").alias("ordinal"))
    return expression.placed_expression(a, e)


q("de_k6_placed", f"WITH {_EXPR} SELECT gene, position, sample, round(value, 4) AS value FROM pl")(lambda t, s, d: _placed(t).withColumn("value", F.round("value", 4)))
q("agg_a9_mean_wide", f"WITH {_EXPR} SELECT gene, round(max(CASE WHEN position = 'No_Insertion' THEN mean END), 6) AS No_Insertion, round(max(CASE WHEN position = 'Upstream' THEN mean END), 6) AS Upstream, round(max(CASE WHEN position = 'Inside' THEN mean END), 6) AS Inside, round(max(CASE WHEN position = 'Downstream' THEN mean END), 6) AS Downstream FROM mo GROUP BY 1")(
    lambda t, s, d: (lambda w: w.select("gene", *[F.round(c, 6).alias(c) for c in w.columns[1:]]))(_placed(t).groupBy("gene").pivot("position", [expression.BASE, *expression.TYPES]).agg(F.avg("value")))
)
q("agg_a10_welch", f"WITH {_EXPR}, x AS (SELECT m.*, b.n AS n0, b.mean AS m0, b.var AS v0 FROM mo m LEFT JOIN mo b ON b.gene = m.gene AND b.position = 'No_Insertion' WHERE m.position <> 'No_Insertion'), y AS (SELECT *, var / n AS a, v0 / n0 AS b FROM x) SELECT gene, position, CASE WHEN n > 1 AND n0 > 1 AND a + b > 0 THEN round((mean - m0) / sqrt(a + b), 4) + 0.0 END AS t, CASE WHEN n > 1 AND n0 > 1 AND a + b > 0 THEN round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (n0 - 1)), 3) END AS dof, round(log2(mean + 1) - log2(m0 + 1), 5) + 0.0 AS fold FROM y")(
    lambda t, s, d: expression.tests(_placed(t)).select("gene", "position", (F.round("t", 4) + 0.0).alias("t"), F.round("dof", 3).alias("dof"), (F.round("fold", 5) + 0.0).alias("fold"))
)
# rounded: sums of the same values in another order differ in their last digits
q("de_k6_differential")(lambda t, s, d: expression.differential(_placed(t)).withColumns({c: F.round(c, 6) for c in ("fold", "p_adjusted")}))
q("agg_a11_adjusted_p", "WITH x AS (SELECT ordinal, te_class, (score % 1000) / 1000.0::DOUBLE AS p FROM te_copies), c AS (SELECT te_class, p, count(*) AS k FROM x WHERE p IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY te_class ORDER BY p) AS rk, sum(k) OVER (PARTITION BY te_class) AS n FROM c), a AS (SELECT te_class, p, least(1.0, min(p * n / rk) OVER (PARTITION BY te_class ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM r) SELECT x.ordinal, round(a.adj, 6) AS p_adjusted FROM x LEFT JOIN a ON a.te_class = x.te_class AND a.p = x.p")(
    lambda t, s, d: stats.benjamini_hochberg(t("te_copies").select("ordinal", "te_class", ((F.col("score") % 1000) / 1000.0).alias("p")), ["te_class"], "p").select("ordinal", F.round("p_adjusted", 6).alias("p_adjusted"))
)

# ---- presence over genomes


def _masks(t):
    names = sorted(r[0] for r in t("genomes").select("genome").collect())  # a dimension of one row per genome
    c = t("te_copies").filter("trim(te_name) <> ''").groupBy(F.trim("te_name").alias("family"), "genome").agg(rows_n())
    return pan.presence(c, names), names


_PAV = "c AS (SELECT trim(te_name) AS family, count(DISTINCT genome) AS n_genomes FROM te_copies WHERE trim(te_name) <> '' AND genome IN (SELECT genome FROM genomes) GROUP BY 1)"


@q("pan_a15_categories", f"WITH {_PAV}, g AS (SELECT count(*) AS n FROM genomes) SELECT family, n_genomes, CASE WHEN n_genomes = n THEN 'core' WHEN n_genomes >= 0.8 * n THEN 'softcore' WHEN n_genomes >= 2 THEN 'dispensable' ELSE 'private' END AS category FROM c, g")
def a15(t, spark, d):
    m, names = _masks(t)
    return pan.categories(m, len(names)).withColumn("n_genomes", F.col("n_genomes").cast("long"))


@q("pan_a13_curve")
def a13(t, spark, d):
    m, names = _masks(t)
    return pan.curve(m, pan.subsets(spark, len(names)))


@q("pan_a14_fits")
def a14(t, spark, d):
    """Power law of the pan size and decay of the core size; fitted on one row per genome number."""
    m, names = _masks(t)
    rows = pan.curve(m, pan.subsets(spark, len(names))).orderBy("size").collect()  # one row per number of genomes
    x = [r["size"] for r in rows]
    a, b = stats.fit_power(x, [max(r["pan_mean"], 1e-9) for r in rows])
    c, k, z = stats.fit_decay(x, [r["core_mean"] for r in rows])
    return spark.createDataFrame([(round(a, 4), round(b, 4), round(c, 4), round(k, 4), round(z, 4))], "pan_scale double, pan_power double, core_span double, core_decay double, core_floor double")


@q("pan_a16_presence_table", "WITH x AS (SELECT trim(te_name) AS family, genome FROM te_copies WHERE trim(te_name) <> ''), f AS (SELECT DISTINCT family FROM x), g AS (SELECT genome FROM genomes), c AS (SELECT family, genome, count(*) AS n FROM x GROUP BY 1, 2) SELECT family, list(coalesce(n, 0) ORDER BY genome) AS copies, CAST(count(n) AS BIGINT) AS n_genomes FROM f CROSS JOIN g LEFT JOIN c USING (family, genome) GROUP BY 1")
def a16(t, spark, d):
    """Copies of each family in every genome of the table ``genomes``, in order of their names."""
    names = sorted(r[0] for r in t("genomes").select("genome").collect())  # a dimension, one column each
    x = t("te_copies").filter("trim(te_name) <> ''").groupBy(F.trim("te_name").alias("family")).agg(*[F.count(F.when(F.col("genome") == g, 1)).alias(f"_{i}") for i, g in enumerate(names)])
    cells = F.array(*[F.col(f"_{i}") for i in range(len(names))])
    return x.select("family", cells.alias("copies"), F.size(F.filter(cells, lambda n: n > 0)).cast("long").alias("n_genomes"))


# ---- family status from hits

_FS = """x AS (SELECT trim(ele) AS family, ordinal, pct_div, strand, try_cast(regexp_replace(c1, '[()]', '', 'g') AS BIGINT) AS a, try_cast(regexp_replace(c2, '[()]', '', 'g') AS BIGINT) AS b, try_cast(regexp_replace(c3, '[()]', '', 'g') AS BIGINT) AS c,
 (seq_end - seq_begin)::DOUBLE / nullif(seq_end + try_cast(regexp_replace(left_bp, '[()]', '', 'g') AS BIGINT), 0) AS contig_cov FROM rm_out WHERE trim(ele) <> ''),
y AS (SELECT family, ordinal, pct_div, contig_cov, CASE WHEN strand = '+' THEN b + c ELSE b + a END AS len, CASE WHEN strand = '+' THEN a ELSE c END AS s, b AS e FROM x),
z AS (SELECT * FROM y WHERE s <= e AND len > 0 AND contig_cov > {least})"""
_COVER = """i{n} AS (SELECT DISTINCT family, s, e FROM z WHERE pct_div < {limit}), m{n} AS (SELECT *, max(e) OVER (PARTITION BY family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i{n}),
g{n} AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m{n}),
p{n} AS (SELECT family, sum(e1 - s1) AS cov FROM (SELECT family, grp, min(s) AS s1, max(e) AS e1 FROM g{n} GROUP BY 1, 2) GROUP BY 1)"""


def _status_sql(least: float, contig: float, whole: float, most: float) -> str:
    return f"""WITH {_FS.format(least=least)}, {_COVER.format(n=1, limit=5)}, {_COVER.format(n=2, limit=20)},
n AS (SELECT family, arg_min(len, ordinal) AS len, coalesce(bool_or(e - s > {whole}::DOUBLE * len AND contig_cov > {contig} AND pct_div < 5), false) AS perfect FROM z GROUP BY 1)
SELECT n.family, n.len, CAST(coalesce(p1.cov, 0) AS BIGINT) AS cover_close, CAST(coalesce(p2.cov, 0) AS BIGINT) AS cover_near,
 CASE WHEN perfect THEN 'perfect' WHEN coalesce(p1.cov, 0) > {whole}::DOUBLE * n.len THEN 'good' WHEN coalesce(p2.cov, 0) > {most}::DOUBLE * n.len THEN 'present' ELSE 'missing' END AS status FROM n LEFT JOIN p1 USING (family) LEFT JOIN p2 USING (family)"""


q("agg_a17_family_status", _status_sql(0.1, 0.95, 0.95, 0.8))(lambda t, s, d: annotation.family_status(annotation.family_hits(t("rm_out"))))
#: Hits on chromosomes cover next to nothing of them, so that no bound on that share is set.
q("agg_a17_family_status_genome", _status_sql(-1, -1, 0.95, 0.8))(lambda t, s, d: annotation.family_status(annotation.family_hits(t("rm_out")), -1, -1))
#: With lower bounds, at which the families of these hits differ.
q("agg_a17_family_status_part", _status_sql(-1, -1, 0.5, 0.3))(lambda t, s, d: annotation.family_status(annotation.family_hits(t("rm_out")), -1, -1, 0.5, 0.3))


q("agg_a12_mean_deviation", "SELECT l_linenumber, round(avg(l_quantity), 2) AS mean, round(stddev_samp(l_quantity), 2) AS sd FROM lineitem GROUP BY 1")(lambda t, s, d: t("lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_quantity"), 2).alias("mean"), F.round(F.stddev_samp("l_quantity"), 2).alias("sd")))
q("agg_a21_longest_copy", "SELECT te_name, copy_id, n FROM (SELECT trim(te_name) AS te_name, copy_id, te_end - te_start AS n, row_number() OVER (PARTITION BY trim(te_name) ORDER BY te_end - te_start DESC, ordinal) AS r FROM te_copies WHERE trim(te_name) <> '' AND te_end - te_start >= 100) WHERE r = 1")(
    lambda t, s, d: t("te_copies").filter("trim(te_name) <> '' and te_end - te_start >= 100").groupBy(F.trim("te_name").alias("te_name")).agg(F.max_by(F.struct("copy_id", (F.col("te_end") - F.col("te_start")).alias("n")), F.struct(F.col("te_end") - F.col("te_start"), -F.col("ordinal"))).alias("x")).select("te_name", "x.*")
)
q("agg_a22_cluster_sizes", "WITH c AS (SELECT te_fam, count(*) AS n FROM te_copies GROUP BY 1) SELECT count(*) FILTER (n = 1) AS single_clusters, count(*) FILTER (n > 1) AS multi_clusters, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS multi_members FROM c")(
    lambda t, s, d: t("te_copies").groupBy("te_fam").agg(rows_n()).agg(F.count(F.when(F.col("n") == 1, 1)).alias("single_clusters"), F.count(F.when(F.col("n") > 1, 1)).alias("multi_clusters"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("multi_members"))
)
q("agg_a23_genome_totals", f"WITH {_S} SELECT genome, CAST(sum(length(q)) AS BIGINT) AS bases, CAST(sum(length(q) - length(replace(q, 'N', ''))) AS BIGINT) AS unknown FROM s GROUP BY 1")(
    lambda t, s, d: seqs(s, d).groupBy("genome").agg(F.sum(F.length("q")).alias("bases"), F.sum(F.length("q") - F.length(F.replace("q", F.lit("N"), F.lit("")))).alias("unknown"))
)
q("agg_a24_copy_histogram", "SELECT n AS copies, count(*) AS families FROM (SELECT te_name, count(*) AS n FROM te_copies GROUP BY 1) GROUP BY 1")(lambda t, s, d: t("te_copies").groupBy("te_name").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("families")))
q("agg_a25_medians", "SELECT te_class, round(median(te_end - te_start), 2) AS median_length FROM te_copies GROUP BY 1")(lambda t, s, d: t("te_copies").groupBy("te_class").agg(F.round(F.median(F.col("te_end") - F.col("te_start")), 2).alias("median_length")))
q("agg_a26_feature_counts", "WITH r AS (SELECT genome || ':' || regexp_extract(chrom, '([0-9]+)$', 1) AS c, te_start + 1 AS a, te_end AS b FROM te_copies WHERE te_start < te_end), f AS (SELECT DISTINCT ann_id, genome || ':' || regexp_extract(seq_name, '([0-9]+)$', 1) AS c, seq_begin AS a, seq_end AS b FROM rm_out) SELECT f.ann_id, count(*) AS n FROM f JOIN r ON r.c = f.c AND r.a <= f.b AND f.a <= r.b GROUP BY 1")(
    lambda t, s, d: iv.overlap_join(
        t("te_copies").filter("te_start < te_end").select(F.expr(_TEST["chrom"]).alias("c"), (F.col("te_start") + 1).alias("a"), F.col("te_end").alias("b")),
        t("rm_out").select("ann_id", F.expr(_STD["chrom"]).alias("c"), F.col("seq_begin").alias("a2"), F.col("seq_end").alias("b2")).distinct(), ["c"], "a", "b", "a2", "b2").groupBy("ann_id").agg(rows_n())
)
q("scan_s33_base_statistics", f"WITH {_S}, x AS (SELECT seq_id::VARCHAR AS name, length(q) AS bases, length(q) - length(replace(q, 'N', '')) AS unknown FROM s), u AS (SELECT * FROM x UNION ALL SELECT 'All', sum(bases), sum(unknown) FROM x) SELECT name, CAST(bases AS BIGINT) AS bases, CAST(unknown AS BIGINT) AS unknown, CASE WHEN bases > 0 THEN round(unknown::DOUBLE / bases, 6) END AS missing FROM u")(
    lambda t, s, d: (lambda x: x.unionByName(x.agg(F.lit("All").alias("name"), F.sum("bases").alias("bases"), F.sum("unknown").alias("unknown"))).select("name", "bases", "unknown", F.when(F.col("bases") > 0, F.round(F.col("unknown") / F.col("bases"), 6)).alias("missing")))(
        seqs(s, d).select(F.col("seq_id").cast("string").alias("name"), F.length("q").cast("long").alias("bases"), (F.length("q") - F.length(F.replace("q", F.lit("N"), F.lit("")))).cast("long").alias("unknown"))
    )
)

# ---- ordered operators

q("win_w1_running_end", "SELECT ordinal, max(seq_end) OVER (PARTITION BY genome, seq_name ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS top FROM rm_out")(lambda t, s, d: running(_placed_rows(t), ["genome", "seq_name"], "ordinal", {"p": ("max", F.col("seq_end"))}).select("ordinal", F.greatest("p", "seq_end").alias("top")))
q("win_w2_carry_forward", "SELECT ordinal, last_value(hit_id IGNORE NULLS) OVER (PARTITION BY genome, seq_name ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS carried FROM rm_out")(lambda t, s, d: running(_placed_rows(t), ["genome", "seq_name"], "ordinal", {"p": ("last", F.col("hit_id"))}).select("ordinal", F.coalesce("hit_id", "p").alias("carried")))
q("win_w3_running_index", "SELECT seq_id, row_number() OVER (PARTITION BY genome ORDER BY ordinal) - 1 AS idx FROM sequences")(lambda t, s, d: numbered(t("sequences").select("seq_id", "genome", "ordinal"), ["genome"], "ordinal", "idx").select("seq_id", "idx"))
q("win_w4_duplicate_names", "SELECT ordinal, CASE WHEN r = 1 THEN te_name ELSE te_name || '_dup' || (r - 1) END AS instance FROM (SELECT ordinal, te_name, row_number() OVER (PARTITION BY te_name ORDER BY ordinal) AS r FROM te_copies WHERE te_name IS NOT NULL)")(
    lambda t, s, d: _instances(t("te_copies").filter("te_name is not null")).select("ordinal", "instance")
)
q("win_w5_first_by_priority", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS r FROM events) WHERE r = 1")(lambda t, s, d: t("events").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")).alias("event_id")))
q("win_w6_distinct_keep_all", "SELECT genome, te_name, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY genome, te_name ORDER BY ordinal) AS r FROM te_copies) WHERE r = 1")(lambda t, s, d: t("te_copies").groupBy("genome", "te_name").agg(F.min("ordinal").alias("ordinal")))
q("win_w7_sliding_mean", "WITH m AS (SELECT event_id, user_id, ts, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS mean, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM events) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM m WHERE n = 5 AND mean >= 50) WHERE r = 1")(
    lambda t, s, d: (lambda w: t("events").select("user_id", "event_id", "ts", F.avg("value").over(w.rowsBetween(0, 4)).alias("m"), F.count(F.lit(1)).over(w.rowsBetween(0, 4)).alias("n")).filter("n = 5 and m >= 50").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")))(W.partitionBy("user_id").orderBy("ts", "event_id"))
)
q("win_w8_run_lengths", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, max(n) AS longest FROM (SELECT user_id, event_type, g, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2")(
    lambda t, s, d: t("events").withColumn("g", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).groupBy("user_id", "event_type", "g").agg(rows_n()).groupBy("user_id", "event_type").agg(F.max("n").alias("longest"))
)
q("win_w9_previous_row", "SELECT ordinal, seq_begin - lag(seq_end) OVER (PARTITION BY genome, seq_name ORDER BY ordinal) AS away FROM rm_out")(lambda t, s, d: running(_placed_rows(t), ["genome", "seq_name"], "ordinal", {"p": ("last", F.struct("seq_end"))}).select("ordinal", (F.col("seq_begin") - F.col("p.seq_end")).alias("away")))


def _placed_rows(t):
    return t("rm_out").select("genome", "seq_name", "ordinal", "seq_begin", "seq_end", "hit_id")


def _instances(t):
    t = numbered(t.select("ordinal", "te_name"), ["te_name"], "ordinal", "r")
    return t.withColumn("instance", F.when(F.col("r") == 0, F.col("te_name")).otherwise(F.concat("te_name", F.lit("_dup"), F.col("r").cast("string"))))


# ---- sort, top-k, samples

q("top_t1_sorted_hits", "SELECT ann_id, genome, seq_name, seq_begin, seq_end FROM rm_out ORDER BY genome, seq_name, seq_begin, seq_end, ordinal")(lambda t, s, d: t("rm_out").orderBy("genome", "seq_name", "seq_begin", "seq_end", "ordinal").select("ann_id", "genome", "seq_name", "seq_begin", "seq_end"))
q("top_t2_by_length", "SELECT seq_id, length(chrseq) AS n FROM sequences ORDER BY n DESC, seq_id")(lambda t, s, d: t("sequences").select("seq_id", F.length("chrseq").alias("n")).orderBy(F.desc("n"), "seq_id"))
for _name, _k in (("top_t3_per_group", 11), ("top_t4_stop_at_hundred", 100)):
    q(_name, f"SELECT te_name, ordinal, n FROM (SELECT te_name, ordinal, te_end - te_start AS n, row_number() OVER (PARTITION BY te_name ORDER BY te_end - te_start DESC NULLS LAST, ordinal) AS r FROM te_copies) WHERE r <= {_k}")(
        lambda t, s, d, k=_k: t("te_copies").select("te_name", "ordinal", (F.col("te_end") - F.col("te_start")).alias("n")).withColumn("r", F.row_number().over(W.partitionBy("te_name").orderBy(F.desc_nulls_last("n"), "ordinal"))).filter(F.col("r") <= k).drop("r")
    )

_FIVE = "c AS (SELECT te_name, count(*) AS n FROM te_copies GROUP BY 1), k AS (SELECT CASE WHEN sum(least(n, 5)) <= {0} THEN 5 WHEN sum(least(n, 3)) <= {0} THEN 3 ELSE 1 END AS k FROM c)"
_RANK = "row_number() OVER (PARTITION BY te_name ORDER BY te_end - te_start DESC NULLS LAST, ordinal) AS r"


def _shrunk(t, size: int):
    """The longest five copies of each cluster, or three, or one: as many as keep the whole within ``size`` rows."""
    x = t("te_copies").select("te_name", "ordinal", (F.col("te_end") - F.col("te_start")).alias("n"))
    c = x.groupBy("te_name").agg(rows_n())
    total = c.agg(*[F.sum(F.least("n", F.lit(k))).alias(f"k{k}") for k in (5, 3)]).first()
    k = next((k for k in (5, 3) if (total[f"k{k}"] or 0) <= size), 1)
    r = F.row_number().over(W.partitionBy("te_name").orderBy(F.desc_nulls_last("n"), "ordinal"))
    return x.withColumn("r", r).filter(F.col("r") <= k).drop("r")


for _size in (10_000, 1_500, 700):
    q(f"top_t5_within_{_size}", f"WITH {_FIVE.format(_size)} SELECT te_name, ordinal, n FROM (SELECT te_name, ordinal, te_end - te_start AS n, {_RANK} FROM te_copies) WHERE r <= (SELECT k FROM k)")(lambda t, s, d, z=_size: _shrunk(t, z))

_HASH = "md5(ordinal::VARCHAR || ':42')"


def _hash(c: str):
    """Order that is the same on every system."""
    return F.md5(F.concat(F.col(c).cast("string"), F.lit(":42")))


@q("top_t6_largest_and_sample", f"WITH x AS (SELECT te_name, ordinal, {_RANK} FROM te_copies), y AS (SELECT te_name, ordinal, r, row_number() OVER (PARTITION BY te_name, r <= 5 ORDER BY {_HASH}) AS h FROM x) SELECT te_name, ordinal FROM y WHERE r <= 5 OR h <= 5")
def t6(t, spark, d):
    """The five longest copies of each family, and five by a fixed hash of the others; each limit is applied before the shuffle."""
    x = t("te_copies").select("te_name", "ordinal", (F.col("te_end") - F.col("te_start")).alias("n"))
    rank = lambda *o: F.row_number().over(W.partitionBy("te_name").orderBy(*o))
    long = x.withColumn("r", rank(F.desc_nulls_last("n"), "ordinal")).filter("r <= 5").select("te_name", "ordinal")
    # five of the others are among the first ten by hash of all, as five at most are taken away
    some = x.withColumn("h", _hash("ordinal")).withColumn("r", rank("h")).filter("r <= 10").select("te_name", "ordinal", "h")
    rest = some.join(long.select("ordinal"), "ordinal", "left_anti").withColumn("r", rank("h")).filter("r <= 5")
    return long.unionByName(rest.select("te_name", "ordinal"))


q("top_t7_downsample", f"SELECT ordinal FROM te_copies ORDER BY {_HASH} LIMIT 500")(lambda t, s, d: t("te_copies").select("ordinal", _hash("ordinal").alias("h")).orderBy("h").limit(500).select("ordinal"))
q("top_t8_two_rankings", "SELECT copy_id FROM (SELECT copy_id FROM te_copies ORDER BY score DESC NULLS LAST, copy_id LIMIT 5) UNION SELECT copy_id FROM (SELECT copy_id FROM te_copies ORDER BY te_end - te_start DESC NULLS LAST, copy_id LIMIT 5)")(
    lambda t, s, d: t("te_copies").orderBy(F.desc_nulls_last("score"), "copy_id").limit(5).select("copy_id").union(t("te_copies").orderBy(F.desc_nulls_last(F.col("te_end") - F.col("te_start")), "copy_id").limit(5).select("copy_id")).distinct()
)
q("top_t9_by_class", "SELECT te_name, te_class FROM te_library ORDER BY te_class, te_name")(lambda t, s, d: t("te_library").orderBy("te_class", "te_name").select("te_name", "te_class"))

# ---- sets

_names = lambda t: (t("rm_out").select(F.trim("ele").alias("name")), t("te_copies").select(F.trim("te_name").alias("name")))
_N = "a AS (SELECT trim(ele) AS name FROM rm_out), b AS (SELECT trim(te_name) AS name FROM te_copies)"
q("set_e1_union_all", f"WITH {_N} SELECT name FROM a UNION ALL SELECT name FROM b")(lambda t, s, d: _names(t)[0].unionByName(_names(t)[1]))
q("set_e2_union", f"WITH {_N} SELECT name FROM a UNION SELECT name FROM b")(lambda t, s, d: _names(t)[0].union(_names(t)[1]).distinct())
q("set_e3_except", f"WITH {_N} SELECT name FROM a EXCEPT SELECT name FROM b")(lambda t, s, d: _names(t)[0].subtract(_names(t)[1]))
q("set_e4_intersect", f"WITH {_N} SELECT name FROM a INTERSECT SELECT name FROM b")(lambda t, s, d: _names(t)[0].intersect(_names(t)[1]))
q("set_e5_distinct", f"WITH {_N} SELECT DISTINCT name FROM a")(lambda t, s, d: _names(t)[0].distinct())
q("set_e6_append_new", f"WITH {_N} SELECT te_name AS name FROM te_library UNION ALL (SELECT DISTINCT name FROM b WHERE name <> '' AND name NOT IN (SELECT te_name FROM te_library))")(lambda t, s, d: t("te_library").select(F.col("te_name").alias("name")).union(_names(t)[1].filter("name <> ''").distinct().join(t("te_library").select(F.col("te_name").alias("name")), "name", "left_anti")))
q("v27_missing_families", f"WITH {_N} SELECT te_name FROM te_library WHERE te_name NOT IN (SELECT name FROM a WHERE name IS NOT NULL)")(lambda t, s, d: t("te_library").select("te_name").join(_names(t)[0].filter("name is not null").select(F.col("name").alias("te_name")), "te_name", "left_anti"))

# ---- reshaping

q("re_r1_unpivot", "SELECT ordinal, measure, value FROM (UNPIVOT (SELECT ordinal, pct_div, pct_del, pct_ins FROM rm_out) ON pct_div, pct_del, pct_ins INTO NAME measure VALUE value)")(lambda t, s, d: t("rm_out").select("ordinal", "pct_div", "pct_del", "pct_ins").unpivot("ordinal", ["pct_div", "pct_del", "pct_ins"], "measure", "value").filter("value is not null"))
q("re_r2_pivot", "SELECT genome, count(*) FILTER (te_class = 'LTR') AS LTR, count(*) FILTER (te_class = 'LINE') AS LINE, count(*) FILTER (te_class = 'DNA') AS DNA FROM te_copies GROUP BY 1")(lambda t, s, d: t("te_copies").groupBy("genome").pivot("te_class", ["LTR", "LINE", "DNA"]).count().fillna(0, ["LTR", "LINE", "DNA"]))
q("re_r3_case_when", "SELECT ordinal, coalesce(strand, '.') AS strand, CASE WHEN score IS NULL THEN 'none' WHEN score < 1000 THEN 'low' ELSE 'high' END AS level FROM te_copies")(lambda t, s, d: t("te_copies").select("ordinal", F.coalesce("strand", F.lit(".")).alias("strand"), F.when(F.col("score").isNull(), "none").when(F.col("score") < 1000, "low").otherwise("high").alias("level")))
q("re_r4_distance", "SELECT ordinal, CASE WHEN te_start <= 2000000 AND 1000000 <= te_end THEN 0 ELSE least(abs(te_end - 1000000), abs(te_start - 2000000)) END AS distance FROM te_copies")(lambda t, s, d: t("te_copies").select("ordinal", iv.distance("te_start", "te_end", F.lit(1000000), F.lit(2000000)).alias("distance")))
@q("re_r5_binarise", "WITH x AS (SELECT te_name, genome, count(*) AS n FROM te_copies WHERE te_name IS NOT NULL GROUP BY 1, 2), f AS (SELECT DISTINCT te_name FROM x WHERE genome IN (SELECT genome FROM genomes)) SELECT te_name, list(CASE WHEN n > 0 THEN 1 ELSE 0 END ORDER BY g.genome) AS present FROM f CROSS JOIN (SELECT genome FROM genomes) g LEFT JOIN x USING (te_name, genome) GROUP BY 1")
def r5(t, spark, d):
    """Presence of each name in the genomes of the table ``genomes``, in order of their names; names in none of them drop out."""
    names = sorted(r[0] for r in t("genomes").select("genome").collect())  # a dimension, one column each
    x = t("te_copies").filter("te_name is not null").groupBy("te_name").agg(*[(F.count(F.when(F.col("genome") == g, 1)) > 0).cast("int").alias(f"_{i}") for i, g in enumerate(names)])
    cells = F.array(*[F.col(f"_{i}") for i in range(len(names))])
    return x.select("te_name", cells.alias("present")).filter(F.array_contains("present", 1))


q("re_r7_attributes", "SELECT ordinal, 'id=te_' || copy_id || ';name=' || coalesce(te_name, '') || ';classification=' || coalesce(te_class, '') AS attrs, coalesce(te_name, '') AS name_back FROM te_copies")(
    lambda t, s, d: t("te_copies").select("ordinal", F.concat_ws(";", F.concat(F.lit("id=te_"), F.col("copy_id").cast("string")), F.concat(F.lit("name="), F.coalesce("te_name", F.lit(""))), F.concat(F.lit("classification="), F.coalesce("te_class", F.lit("")))).alias("attrs")).select("ordinal", "attrs", F.try_element_at(F.str_to_map("attrs", F.lit(";"), F.lit("=")), F.lit("name")).alias("name_back"))
)
q("re_r8_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t, s, d: t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
_R9 = "f AS (SELECT c.te_name, coalesce(l.te_class, nullif(c.te_class, 'Unknown') || CASE WHEN c.te_fam IS NULL OR c.te_fam = c.te_class THEN '' ELSE '/' || replace(c.te_fam, '?', '') END, 'Unknown') AS label, l.te_name IS NOT NULL AS in_library FROM (SELECT te_name, te_class, te_fam FROM te_copies WHERE te_name IS NOT NULL) c LEFT JOIN te_library l ON l.te_name = c.te_name)"


@q("re_r9_class_fallback", f"WITH {_R9} SELECT te_name, label, CASE WHEN in_library THEN 'library' ELSE 'copies' END AS source, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT te_name, coalesce(te_class, 'Unknown'), 'library only', 0 FROM te_library WHERE te_name NOT IN (SELECT te_name FROM f)")
def r9(t, spark, d):
    """Label of each name: the library's class, else class and family of the copy, else Unknown; with the library's names that have no copy."""
    lib = t("te_library").select("te_name", F.col("te_class").alias("lc"), F.lit(True).alias("known"))
    c = t("te_copies").filter("te_name is not null").groupBy("te_name", "te_class", "te_fam").agg(rows_n()).join(lib, "te_name", "left")
    fam = F.when(F.col("te_fam").isNull() | (F.col("te_fam") == F.col("te_class")), "").otherwise(F.concat(F.lit("/"), F.replace("te_fam", F.lit("?"), F.lit(""))))
    label = F.coalesce("lc", F.concat(F.nullif("te_class", F.lit("Unknown")), fam), F.lit("Unknown"))
    got = c.groupBy("te_name", label.alias("label"), F.when(F.col("known"), "library").otherwise("copies").alias("source")).agg(F.sum("n").alias("n"))
    rest = lib.join(c.select("te_name"), "te_name", "left_anti").select("te_name", F.coalesce("lc", F.lit("Unknown")).alias("label"), F.lit("library only").alias("source"), F.lit(0).cast("long").alias("n"))
    return got.unionByName(rest)


q("re_r10_argmax", "SELECT vec_id, list_position(list_transform(embedding, lambda x: round(x, 4)), list_max(list_transform(embedding, lambda x: round(x, 4)))) - 1 AS best FROM embeddings")(
    lambda t, s, d: t("embeddings").withColumn("r", F.transform("embedding", lambda x: F.round(x, 4))).select("vec_id", (F.array_position("r", F.array_max("r")) - 1).cast("int").alias("best"))
)
@q("re_r11_split", "SELECT te_name, te_class, CAST((row_number() OVER (PARTITION BY te_class ORDER BY md5(te_name || ':42')) - 1) % 5 AS INTEGER) AS fold, CASE WHEN (row_number() OVER (PARTITION BY te_class ORDER BY md5(te_name || ':42')) - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM te_library")
def r11(t, spark, d):
    """Five folds of equal share of each class, in the order of a fixed hash; a class of any size is numbered over stretches of the hash."""
    x = t("te_library").select("te_name", "te_class", _hash("te_name").alias("h"))
    x = numbered(x.withColumn("o", F.conv(F.substring("h", 1, 15), 16, 10).cast("long")), ["te_class"], "o", "n", ["h"], 1 << 52)
    fold = (F.col("n") % 5).cast("int")
    return x.select("te_name", "te_class", fold.alias("fold"), F.when(fold == 0, "test").otherwise("train").alias("part"))


q("re_r12_oversample", "SELECT te_name, unnest(range(1, 1 + CASE WHEN te_class LIKE 'LTR/%' THEN 1 WHEN te_class LIKE 'DNA/%' THEN 2 ELSE 3 END)) AS copy_no FROM te_library")(
    lambda t, s, d: t("te_library").select("te_name", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("te_class").like("LTR/%"), 1).when(F.col("te_class").like("DNA/%"), 2).otherwise(3).cast("long"))).alias("copy_no"))
)

_R13 = "r AS (SELECT genome AS family, seq_id, translate(q, 'N', '-') AS seq, row_number() OVER (PARTITION BY genome ORDER BY md5(seq_id::VARCHAR || ':42')) - 1 AS row_no, max(length(q)) OVER (PARTITION BY genome) AS width FROM s WHERE genome IS NOT NULL)"


@q("re_r13_padding", f"WITH {_S}, {_R13}, n AS (SELECT family, count(*) AS n, max(width) AS width FROM r GROUP BY 1) SELECT family, row_no, seq_id, rpad(seq, CAST(width AS INTEGER), '-') AS seq FROM r WHERE row_no < 100 UNION ALL SELECT family, unnest(range(n, 100)), NULL, repeat('-', width) FROM n WHERE n < 100")
def r13(t, spark, d):
    """Alignments of 100 rows: families of more are sampled by a fixed hash, those of fewer get blank rows; all columns stay."""
    x = seqs(spark, d).filter("genome is not null").select(F.col("genome").alias("family"), "seq_id", F.translate("q", "N", "-").alias("seq"))
    n = x.groupBy("family").agg(rows_n(), F.max(F.length("seq")).alias("width"))
    ids = x.select("family", "seq_id", _hash("seq_id").alias("h"))
    pick = ids.withColumn("row_no", (F.row_number().over(W.partitionBy("family").orderBy("h")) - 1).cast("long")).filter("row_no < 100").select("seq_id", "row_no")
    kept = x.join(pick, "seq_id").join(n, "family").select("family", "row_no", "seq_id", F.rpad("seq", F.col("width"), F.lit("-")).alias("seq"))
    blank = n.filter("n < 100").select("family", F.explode(F.sequence(F.col("n"), F.lit(99).cast("long"))).alias("row_no"), F.lit(None).cast("long").alias("seq_id"), F.repeat(F.lit("-"), F.col("width")).alias("seq"))
    return kept.unionByName(blank)


# ---- further analyses

_W3 = f"WITH {_S}, k AS (SELECT seq_id, unnest(range(1, length(q) - 6)) AS pos, substr(q, unnest(range(1, length(q) - 6)), 8) AS w FROM s WHERE length(q) >= 8)"


def _placed_words(s, d, k=8):
    from seqloom.functions.sequence import words

    return seqs(s, d).filter(F.length("q") >= k).select("seq_id", F.posexplode(words("q", k)).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)


q("v1_word_table", f"{_W3} SELECT w, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 5")(lambda t, s, d: _placed_words(s, d).groupBy("w").agg(rows_n()).filter("n >= 5"))


@q("v2_self_distance", f"{_W3}, x AS (SELECT seq_id, pos, pos - lag(pos) OVER v AS b, lead(pos) OVER v - pos AS a FROM k WINDOW v AS (PARTITION BY seq_id, w ORDER BY pos)), y AS (SELECT seq_id, pos, CASE WHEN b BETWEEN 20 AND 2000 THEN b END AS b, CASE WHEN a BETWEEN 20 AND 2000 THEN a END AS a FROM x) SELECT seq_id, pos, least(a, b) AS score FROM y WHERE a IS NOT NULL OR b IS NOT NULL")
def v2(t, s, d):
    """Distance of each word to its nearest equal word before or after, within bounds."""
    w = W.partitionBy("seq_id", "w").orderBy("pos")
    x = _placed_words(s, d).select("seq_id", "pos", (F.col("pos") - F.lag("pos").over(w)).alias("b"), (F.lead("pos").over(w) - F.col("pos")).alias("a"))
    z = lambda c: F.when(F.col(c).between(20, 2000), F.col(c))
    return x.select("seq_id", "pos", F.least(z("a"), z("b")).alias("score")).filter("score is not null")


@q("v3_block_median", "WITH x AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS block FROM events), y AS (SELECT user_id, block, list(value ORDER BY value) AS v FROM x WHERE value IS NOT NULL GROUP BY 1, 2) SELECT user_id, block, round(v[least(len(v), len(v) // 2 + 1)], 6) AS median FROM y")
def v3(t, s, d):
    """Upper median of fixed blocks of 20 values."""
    x = t("events").withColumn("block", F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 20).cast("long"))
    v = x.filter("value is not null").groupBy("user_id", "block").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return v.select("user_id", "block", F.round(F.element_at("v", F.least(F.size("v"), F.floor(F.size("v") / 2).cast("int") + 1)), 6).alias("median"))


def _smooth_sql(weights) -> str:
    h = len(weights) // 2
    terms = [(f"lag(value, {h - i}) OVER w" if i < h else "value" if i == h else f"lead(value, {i - h}) OVER w", x) for i, x in enumerate(weights)]
    top, low = (" + ".join(f for f in fs) for fs in ([f"{x} * coalesce({t}, 0)" for t, x in terms], [f"CASE WHEN {t} IS NULL THEN 0 ELSE {x} END" for t, x in terms]))
    return f"SELECT event_id, user_id, ts, value, ({top}) / ({low}) AS smooth FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _smooth(t, weights):
    """Weighted mean of a window around each value; at the ends of a series the weights that remain are scaled up."""
    w, h = W.partitionBy("user_id").orderBy("ts", "event_id"), len(weights) // 2
    terms = [(F.lag("value", h - i).over(w) if i <= h else F.lead("value", i - h).over(w), x) for i, x in enumerate(weights)]
    top = sum((F.coalesce(c, F.lit(0.0)) * x for c, x in terms[1:]), F.coalesce(terms[0][0], F.lit(0.0)) * terms[0][1])
    low = sum((F.when(c.isNull(), 0).otherwise(x) for c, x in terms[1:]), F.when(terms[0][0].isNull(), 0).otherwise(terms[0][1]))
    return t("events").filter("value is not null").select("event_id", "user_id", "ts", "value", (top / low).alias("smooth"))


BELL = (1, 4, 6, 4, 1)
q("v13_weighted_smoothing", f"SELECT event_id, round(smooth, 6) AS smooth FROM ({_smooth_sql((1, 2, 1))})")(lambda t, s, d: _smooth(t, (1, 2, 1)).select("event_id", F.round("smooth", 6).alias("smooth")))
q("v13_weighted_smoothing_wide", f"SELECT event_id, round(smooth, 6) AS smooth FROM ({_smooth_sql(BELL)})")(lambda t, s, d: _smooth(t, BELL).select("event_id", F.round("smooth", 6).alias("smooth")))

_V14 = f"""x AS (SELECT *, lead(smooth) OVER w - smooth AS d1, smooth - lag(smooth) OVER w AS d0 FROM ({_smooth_sql(BELL)}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, d1 - d0 AS d2, CASE WHEN d0 > 0 AND d1 < 0 THEN 'peak' WHEN d0 < 0 AND d1 > 0 THEN 'valley' END AS kind FROM x)"""


def _turns(t):
    """First and second differences of the smoothed series, peaks and valleys."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = _smooth(t, BELL).withColumns({"d1": F.lead("smooth").over(w) - F.col("smooth"), "d0": F.col("smooth") - F.lag("smooth").over(w)})
    kind = F.when((F.col("d0") > 0) & (F.col("d1") < 0), "peak").when((F.col("d0") < 0) & (F.col("d1") > 0), "valley")
    return x.withColumns({"d2": F.col("d1") - F.col("d0"), "kind": kind})


q("v14_local_maxima", f"WITH {_V14} SELECT event_id, kind, round(d2, 6) AS bend FROM k WHERE kind IS NOT NULL")(lambda t, s, d: _turns(t).filter("kind is not null").select("event_id", "kind", F.round("d2", 6).alias("bend")))


@q("v14_regions", f"WITH {_V14}, r AS (SELECT *, count(*) FILTER (kind = 'valley') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS region FROM k) SELECT user_id, region, count(*) AS n, min(event_id) AS first_event, count(*) FILTER (kind = 'peak') AS peaks, round(max(smooth), 6) AS top FROM r GROUP BY 1, 2")
def v14r(t, spark, d):
    """Regions between separators (the valleys): their size, peaks and height."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    r = _turns(t).withColumn("region", F.count(F.when(F.col("kind") == "valley", 1)).over(w))
    return r.groupBy("user_id", "region").agg(rows_n(), F.min("event_id").alias("first_event"), F.count(F.when(F.col("kind") == "peak", 1)).alias("peaks"), F.round(F.max("smooth"), 6).alias("top"))


@q("v16_enrichment_ratio", f"{_W3}, c AS (SELECT w, count(*) AS n FROM k GROUP BY 1), a AS (SELECT left(w, 7) AS p, sum(n) AS n FROM c GROUP BY 1), z AS (SELECT right(w, 7) AS s, sum(n) AS n FROM c GROUP BY 1), m AS (SELECT substr(w, 2, 6) AS m, sum(n) AS n FROM c GROUP BY 1) SELECT c.w, c.n, CAST(a.n * z.n * 1000 // m.n AS BIGINT) AS expected_1000, CAST(c.n * m.n * 1000 // (a.n * z.n) AS BIGINT) AS ratio_1000 FROM c JOIN a ON a.p = left(c.w, 7) JOIN z ON z.s = right(c.w, 7) JOIN m ON m.m = substr(c.w, 2, 6)")
def v16r(t, spark, d):
    """Words of eight letters against what a Markov model of the sixth order expects (counts of both seven-letter parts over that of the middle), in thousandths."""
    c = _placed_words(spark, d).groupBy("w").agg(rows_n())
    part = lambda e, k, n: c.groupBy(e.alias(k)).agg(F.sum("n").alias(n))
    a, z, m = F.left("w", F.lit(7)), F.right("w", F.lit(7)), F.substring("w", 2, 6)
    x = c.withColumns({"p": a, "s": z, "m": m}).join(part(a, "p", "na"), "p").join(part(z, "s", "nz"), "s").join(part(m, "m", "nm"), "m")
    return x.select("w", "n", F.expr("na * nz * 1000 div nm").alias("expected_1000"), F.expr("n * nm * 1000 div (na * nz)").alias("ratio_1000"))


q("v20_unclear_bases", "SELECT seq_id, translate(upper(chrseq), 'MYHRSKVDBW', 'CCCGGGGGGT') AS read FROM sequences")(lambda t, s, d: t("sequences").select("seq_id", F.translate(F.upper("chrseq"), "MYHRSKVDBW", "CCCGGGGGGT").alias("read")))
q("v21_density", "SELECT genome, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand IN ('-', 'C')) AS minus, count(*) AS n FROM te_copies GROUP BY 1")(lambda t, s, d: t("te_copies").groupBy("genome").agg(F.count(F.when(F.col("strand") == "+", 1)).alias("plus"), F.count(F.when(F.col("strand").isin("-", "C"), 1)).alias("minus"), rows_n()))
q("v22_fixed_cutting", f"WITH {_S} SELECT seq_id, unnest(range(0, greatest(1, (length(q) + 4999) // 5000))) AS part, length(substr(q, 1 + 5000 * unnest(range(0, greatest(1, (length(q) + 4999) // 5000))), 5000)) AS n FROM s")(
    lambda t, s, d: seqs(s, d).select("seq_id", "q", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("q") / 5000)).cast("long") - 1)).alias("part")).select("seq_id", "part", F.length(F.substring("q", (1 + 5000 * F.col("part")).cast("int"), F.lit(5000))).cast("long").alias("n"))
)

_UNREAD = "(length({0}) - length(replace({0}, 'N', ''))) * 50 >= length({0})"


@q("v22_retried_cutting", f"WITH {_S}, p AS (SELECT seq_id, i * 5000 AS a, substr(q, CAST(i * 5000 + 1 AS INTEGER), 5000) AS x FROM (SELECT seq_id, q, unnest(range(0, (length(q) + 4999) // 5000)) AS i FROM s)), r AS (SELECT seq_id, a + j * 500 AS a, substr(x, CAST(j * 500 + 1 AS INTEGER), 500) AS x FROM (SELECT *, unnest(range(0, (length(x) + 499) // 500)) AS j FROM p WHERE {_UNREAD.format('x')})) SELECT seq_id, a AS part_start, length(x) AS n, false AS retried FROM p WHERE NOT ({_UNREAD.format('x')}) UNION ALL SELECT seq_id, a, length(x), true FROM r")
def v22r(t, spark, d):
    """Pieces of 5,000 letters; one that fails (here: 2 % unknown letters or more) is tried again in pieces of 500."""
    def cut(x, size):
        n = F.ceil(F.length("x") / size).cast("long")
        y = x.filter("x <> ''").select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
        return y.select("seq_id", (F.col("a") + F.col("i") * size).alias("a"), F.substring("x", (F.col("i") * size + 1).cast("int"), F.lit(size)).alias("x"))

    p = cut(seqs(spark, d).select("seq_id", F.lit(0).cast("long").alias("a"), F.col("q").alias("x")), 5000)
    bad = (F.length("x") - F.length(F.replace("x", F.lit("N"), F.lit("")))) * 50 >= F.length("x")
    out = lambda x, again: x.select("seq_id", F.col("a").alias("part_start"), F.length("x").cast("long").alias("n"), F.lit(again).alias("retried"))
    return out(p.filter(~bad), False).unionByName(out(cut(p.filter(bad), 500), True))


q("v29_split_by_kind", "SELECT r.ordinal, CASE WHEN g.is_plant = 1 THEN 'plant' ELSE 'other' END AS part FROM rm_out r JOIN genomes g USING (genome)")(lambda t, s, d: t("rm_out").join(t("genomes").select("genome", "is_plant"), "genome").select("ordinal", F.when(F.col("is_plant") == 1, "plant").otherwise("other").alias("part")))
@q("v31_proportional_sizes", """WITH c AS (SELECT te_fam, count(*) AS n FROM te_copies WHERE te_fam IS NOT NULL GROUP BY 1), x AS (SELECT *, n * 1000 % (SELECT sum(n) FROM c) AS left_over, CAST(greatest(1, n * 1000 // (SELECT sum(n) FROM c)) AS BIGINT) AS base FROM c),
y AS (SELECT *, 1000 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY left_over DESC, te_fam) AS r, row_number() OVER (ORDER BY n DESC, te_fam) AS z FROM x) SELECT te_fam, CAST(greatest(1, base + CASE WHEN rest > 0 AND r <= rest THEN 1 WHEN rest < 0 AND z = 1 THEN rest ELSE 0 END) AS BIGINT) AS target FROM y""")
def v31(t, spark, d):
    """Sizes that add up to 1,000 in proportion, one at least: whole parts, then one more for the largest remainders; what the ones cost too much, the largest cluster pays."""
    c = t("te_copies").filter("te_fam is not null").groupBy("te_fam").agg(rows_n())
    total = c.agg(F.sum("n")).scalar()
    x = c.withColumns({"left_over": F.col("n") * 1000 % total, "base": F.greatest(F.lit(1), F.floor(F.col("n") * 1000 / total)).cast("long")})
    # one row per cluster: ranks over all of them
    w = lambda *o: F.row_number().over(W.orderBy(*o))
    y = x.withColumns({"rest": 1000 - x.agg(F.sum("base")).scalar(), "r": w(F.desc("left_over"), "te_fam"), "z": w(F.desc("n"), "te_fam")})
    more = F.when((F.col("rest") > 0) & (F.col("r") <= F.col("rest")), 1).when((F.col("rest") < 0) & (F.col("z") == 1), F.col("rest")).otherwise(0)
    return y.select("te_fam", F.greatest(F.lit(1), F.col("base") + more).cast("long").alias("target"))


q("v32_medians_by_method", "SELECT method, median(n) AS median_length FROM (SELECT 'rm' AS method, seq_end - seq_begin AS n FROM rm_out UNION ALL SELECT 'te', te_end - te_start FROM te_copies) GROUP BY 1")(lambda t, s, d: t("rm_out").select(F.lit("rm").alias("method"), (F.col("seq_end") - F.col("seq_begin")).alias("n")).union(t("te_copies").select(F.lit("te"), F.col("te_end") - F.col("te_start"))).groupBy("method").agg(F.median("n").alias("median_length")))
@q("v33_type_distribution", """WITH c AS (SELECT l.te_class, count(*) AS copies, round(avg(c.te_end - c.te_start), 4) AS mean_length, round(median(c.te_end - c.te_start), 4) AS median_length FROM te_copies c JOIN te_library l ON l.te_name = c.te_name GROUP BY 1),
i AS (SELECT l.te_class, count(*) AS hits, round(avg(100 - r.pct_div), 4) AS mean_identity, round(median(100 - r.pct_div), 4) AS median_identity, CAST(sum(r.seq_end - r.seq_begin + 1) AS BIGINT) AS bases FROM rm_out r JOIN te_library l ON l.te_name = r.ele GROUP BY 1) SELECT te_class, copies, mean_length, median_length, hits, mean_identity, median_identity, bases FROM c FULL JOIN i USING (te_class)""")
def v33(t, spark, d):
    """Copies, lengths and identities of each class of the library."""
    lib = t("te_library").select("te_name", F.col("te_class").alias("lc"))
    n = F.col("te_end") - F.col("te_start")
    c = t("te_copies").join(lib, "te_name").groupBy(F.col("lc").alias("te_class")).agg(F.count(F.lit(1)).alias("copies"), F.round(F.avg(n), 4).alias("mean_length"), F.round(F.median(n), 4).alias("median_length"))
    same = 100 - F.col("pct_div")
    i = t("rm_out").join(lib, F.col("ele") == F.col("te_name")).groupBy(F.col("lc").alias("te_class")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg(same), 4).alias("mean_identity"), F.round(F.median(same), 4).alias("median_identity"), F.sum(F.col("seq_end") - F.col("seq_begin") + 1).cast("long").alias("bases"))
    return c.join(i, "te_class", "full")


_TOOLS = """p AS (SELECT 'hits' AS tool, l.te_class AS truth, coalesce(nullif(replace(trim(r.ele_class), '?', ''), ''), 'Unknown') AS predicted FROM rm_out r JOIN te_library l ON l.te_name = r.ele
UNION ALL SELECT 'copies', l.te_class, coalesce(c.te_class || CASE WHEN c.te_fam IS NULL OR c.te_fam = c.te_class THEN '' ELSE '/' || c.te_fam END, 'Unknown') FROM te_copies c JOIN te_library l ON l.te_name = c.te_name),
m AS (SELECT tool, coalesce(string_split(truth, '/')[1], 'Unknown') AS truth, coalesce(string_split(predicted, '/')[1], 'Unknown') AS predicted FROM p),
l AS (SELECT DISTINCT tool, label FROM (SELECT tool, truth AS label FROM m UNION ALL SELECT tool, predicted FROM m)), c AS (SELECT l.tool, label, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth = label) AS actual, count(*) FILTER (predicted = label) AS called FROM l JOIN m ON m.tool = l.tool AND (truth = label OR predicted = label) GROUP BY 1, 2),
f AS (SELECT *, coalesce(tp::DOUBLE / nullif(called, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(actual, 0), 0) AS re FROM c)"""


@q("v34_tool_metrics", f"WITH {_TOOLS} SELECT tool, round(sum(tp)::DOUBLE / sum(actual), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS macro_f1 FROM f GROUP BY 1")
def v34(t, spark, d):
    """Labels of two tools, mapped to their first level, against the library's: accuracy and macro precision, recall and F1 of each tool."""
    lib = t("te_library").select("te_name", F.col("te_class").alias("truth"))
    c = F.coalesce(F.nullif(F.replace(F.trim("ele_class"), F.lit("?"), F.lit("")), F.lit("")), F.lit("Unknown"))
    a = t("rm_out").join(lib, F.col("ele") == F.col("te_name")).select("truth", c.alias("predicted"))
    b = t("te_copies").join(lib, "te_name").select("truth", F.coalesce("te_class", F.lit("Unknown")).alias("predicted"))
    first = lambda x: F.coalesce(F.split(x, "/")[0], F.lit("Unknown")).alias(x)
    one = lambda x, tool: evaluation.macro(evaluation.per_class(evaluation.confusion(x.select(first("truth"), first("predicted"))))).select(F.lit(tool).alias("tool"), "*")
    return one(a, "hits").unionByName(one(b, "copies"))


@q("v36_payload_relabel", "WITH r AS (SELECT ordinal, [coalesce(sw_score::VARCHAR, 'NA'), coalesce(strand, 'NA'), coalesce(seq_name, 'NA'), coalesce(seq_begin::VARCHAR, 'NA'), coalesce(seq_end::VARCHAR, 'NA'), coalesce(left_bp, 'NA'), coalesce(c1, 'NA'), coalesce(c2, 'NA'), coalesce(c3, 'NA'), coalesce(ele, 'NA')] AS f, ele, ele_class FROM rm_out) SELECT r.ordinal, array_to_string(list_append(f, coalesce(l.te_class, ele_class, 'Unknown')), ';') AS payload FROM r LEFT JOIN te_library l ON l.te_name = r.ele")
def v36(t, spark, d):
    """Payloads of annotation rows, whose eleventh field, the class, gives way to the library's."""
    z = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    names = ["sw_score", "strand", "seq_name", "seq_begin", "seq_end", "left_bp", "c1", "c2", "c3", "ele", "ele_class"]
    p = t("rm_out").select("ordinal", "ele", "ele_class", F.concat_ws(";", *[z(n) for n in names]).alias("payload"))
    lib = t("te_library").select(F.col("te_name").alias("ele"), "te_class")
    x = p.join(lib, "ele", "left")
    new = F.coalesce("te_class", "ele_class", F.lit("Unknown"))
    return x.select("ordinal", F.array_join(F.transform(F.split("payload", ";"), lambda f, i: F.when(i == 10, new).otherwise(f)), ";").alias("payload"))
