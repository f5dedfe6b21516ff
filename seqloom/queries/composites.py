"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import chains, nearby, rowwise
from seqloom.operators import intervals as iv
from seqloom.queries.families import c1, identity_clusters
from seqloom.queries.intervals_q import _A, _B, _gap_share, _island_sql, annotations, copies, hits
from seqloom.queries.registry import registry
from seqloom.queries.scalar import _S, seqs
from seqloom.session import materialize
from seqloom.sources import lines as ln

QUERIES, SQL, query = registry()


@query("join_j5_redundant_names", f"WITH {_B}, c AS (SELECT copy_id, chrom, b_start AS s, b_end AS e, te_name FROM b WHERE te_name <> '') SELECT x.copy_id AS a, y.copy_id AS b FROM c x JOIN c y ON x.chrom = y.chrom AND x.copy_id < y.copy_id AND x.te_name <> y.te_name AND x.s <= y.e AND y.s <= x.e WHERE x.e > x.s AND y.e > y.s AND least(x.e, y.e) - greatest(x.s, y.s) >= 0.98 * (x.e - x.s) AND least(x.e, y.e) - greatest(x.s, y.s) >= 0.98 * (y.e - y.s)")
def j5(spark, d):
    """Copies under different names at one place: overlap of 98 % of the length both ways."""
    return _same_place(spark, d, 0.98).filter("n1 <> n2").select("a", "b")


def _same_place(spark, d, share):
    c = copies(spark, d).filter("te_name <> ''")
    x = c.select("chrom", F.col("copy_id").alias("a"), F.col("b_start").alias("s1"), F.col("b_end").alias("e1"), F.col("te_name").alias("n1"))
    y = c.select("chrom", F.col("copy_id").alias("b"), F.col("b_start").alias("s2"), F.col("b_end").alias("e2"), F.col("te_name").alias("n2"))
    p = iv.overlap_join(x, y, ["chrom"], "s1", "e1", "s2", "e2").filter("a < b and e1 > s1 and e2 > s2")
    ov = iv.overlap_len("s1", "e1", "s2", "e2")
    return p.filter((ov >= share * (F.col("e1") - F.col("s1"))) & (ov >= share * (F.col("e2") - F.col("s2"))))


@query("join_j5_kept_copies")
def j5_kept(spark, d):
    """Copies in order of id, without those at the place of a kept copy of another name."""
    ids = copies(spark, d).filter("te_name <> ''").select(F.col("copy_id").alias("node")).distinct()
    return nearby.greedy_kept(ids.withColumn("ord", F.col("node")), j5(spark, d)).select(F.col("node").alias("copy_id"))


@query("chain_g4_from_blast")
def g4(spark, d):
    """Chains of hits read from a BLAST table, with the share of the query that they cover."""
    h = hits(spark, d)
    cols = ["query", "subject", F.lit("95.0"), F.col("q_end") - F.col("q_start") + 1, F.lit("0"), F.lit("0"), "q_start", "q_end", "s_start", "s_end", F.lit("1e-30"), F.lit("99")]
    p = ln.write_lines(h.select(F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value")), ln.scratch(spark, "blast"))
    t = ln.parse_table(ln.read_lines(spark, p), ln.BLAST).filter("q_start is not null and s_start is not null")
    n = h.groupBy("query").agg(F.max("q_len").alias("q_len"))
    c = chains.chain_hits(_gap_share(t.join(n, "query")), "gap").join(n, "query")
    return c.withColumn("cover", F.round((F.col("q_end") - F.col("q_start") + 1) / F.col("q_len"), 6))


@query("chain_g7_coarse_boundaries")
def g7(spark, d):
    """Longest chain of each query with flanks of 50 bases, not before the first base."""
    c = chains.chain_hits(_gap_share(hits(spark, d)), "gap")
    s, e = F.least("s_start", "s_end"), F.greatest("s_start", "s_end")
    best = c.groupBy("query").agg(F.max_by(F.struct("subject", s.alias("s"), e.alias("e")), F.struct(e - s, "subject", s)).alias("x"))
    return best.select("query", "x.subject", F.greatest(F.lit(1), F.col("x.s") - 50).alias("coarse_start"), (F.col("x.e") + 50).alias("coarse_end"))


@query("clu_c3_recluster")
def c3(spark, d):
    """Clusters of near copies, their consensus over whole rows, then clusters of the consensus: ``cluster, members, consensus_len, merged``."""
    family = c1(spark, d).select(F.col("name").cast("long").alias("seq_id"), F.col("cluster").cast("long").alias("family"))
    t = materialize(seqs(spark, d).join(family, "seq_id"), "clusters")
    # a cluster of one is its own consensus
    n = t.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    many = t.join(n.filter("members > 1").select("family"), "family").select("family", F.col("seq_id").alias("row"), F.translate("q", "N", "-").alias("seq"))
    cons = rowwise.majority(many).unionByName(t.join(n.filter("members = 1").select("family"), "family").select("family", F.col("q").alias("consensus")))
    cons = materialize(cons, "consensus")
    again = identity_clusters(cons.select(F.col("family").alias("seq_id"), F.col("consensus").alias("q"))).select(F.col("name").cast("long").alias("family"), F.col("cluster").cast("long").alias("merged"))
    out = n.join(cons, "family").join(again, "family", "left")
    return out.select(F.col("family").alias("cluster"), "members", F.length("consensus").alias("consensus_len"), F.coalesce("merged", "family").alias("merged"))


@query("clu_c6_unique_names")
def c6(spark, d):
    """Names in order of their first copy, without those that share a place (90 % both ways) with a kept name."""
    names = copies(spark, d).filter("te_name <> ''").groupBy(F.col("te_name").alias("node")).agg(F.min("copy_id").alias("ord"))
    same = _same_place(spark, d, 0.9).filter("n1 <> n2").select(F.col("n1").alias("a"), F.col("n2").alias("b")).distinct()
    return nearby.greedy_kept(names, same).select(F.col("node").alias("te_name"))


@query("v11_merge_sorted", f"WITH {_A}, u AS (SELECT chrom, a_start AS s, a_end AS e FROM a), " + _island_sql("u", "chrom", "s > pe", "SELECT chrom, span_start, span_end FROM p"))
def v11(spark, d):
    return iv.merged(annotations(spark, d), ["chrom"], "a_start", "a_end", 0)


@query("x4_table_valued", f"WITH {_S} SELECT seq_id, i AS part, substr(q, i * 100 + 1, 100) AS piece FROM (SELECT seq_id, q, unnest(range(0, (length(q) + 99) // 100)) AS i FROM s)")
def x4(spark, d):
    """One sequence to many rows: consecutive pieces of 100 letters."""
    t = seqs(spark, d).withColumn("parts", F.regexp_extract_all("q", F.lit("(?s)(.{1,100})"), F.lit(1)))
    return t.select("seq_id", F.posexplode("parts").alias("part", "piece")).withColumn("part", F.col("part").cast("long"))


@query("agg_a16_class_cover", f"WITH {_A}, k AS (SELECT ann_id, coalesce(nullif(replace(trim(any_value(ele_class)), '?', ''), ''), 'Unknown') AS cls FROM rm_out GROUP BY 1), u AS (SELECT cls, chrom, a_start AS s, a_end AS e FROM a JOIN k USING (ann_id)), " + _island_sql("u", "cls, chrom", "s > pe + 1", "SELECT cls, split_part(chrom, ':', 1) AS genome, CAST(sum(span_end - span_start + 1) AS BIGINT) AS covered FROM p GROUP BY 1, 2"))
def a16c(spark, d):
    """Distinct bases covered by each class in each genome."""
    from seqloom.session import table

    cls = F.coalesce(F.nullif(F.replace(F.trim("ele_class"), F.lit("?"), F.lit("")), F.lit("")), F.lit("Unknown"))
    k = table(spark, d, "rm_out").groupBy("ann_id").agg(F.first(cls).alias("cls"))
    m = iv.merged(annotations(spark, d).join(k, "ann_id"), ["cls", "chrom"], "a_start", "a_end")
    return m.groupBy("cls", F.split("chrom", ":")[0].alias("genome")).agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("covered"))


@query("stream_early_stop_per_key", "SELECT te_name, copy_id FROM (SELECT te_name, copy_id, row_number() OVER (PARTITION BY te_name ORDER BY ordinal) AS r FROM te_copies WHERE te_name IS NOT NULL) WHERE r <= 3")
def early_stop(spark, d):
    """First three copies of each family, kept from batch to batch of a stream."""
    from seqloom.session import table
    from seqloom.streaming import chunks

    return chunks.first_per_key(table(spark, d, "te_copies").select("te_name", "ordinal", "copy_id"), "te_name", "ordinal", 3, ["copy_id"]).select("te_name", "copy_id")
