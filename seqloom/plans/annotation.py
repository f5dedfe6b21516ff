"""Summary of repeat annotations: counts and masked bases by element, type, subtype and sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.intervals import merged, running_masked

#: Classes that are no interspersed repeats: fixed values.
NOT_INTERSPERSED = ("Simple_repeat", "Low_complexity", "Satellite", "rRNA", "scRNA", "snRNA", "srpRNA", "tRNA")


def hits(rm: DataFrame, low: float = 0, high: float = 40) -> DataFrame:
    """Rows in the divergence range with ``type, subtype, bp`` and whether they begin a new element (``is_new``).

    ``bp`` counts only bases beyond the end of all rows before in file order. A row is new if its id
    or its element differs from the row before with that id; without an id it always is.
    """
    t = rm.filter(F.col("pct_div").between(low, high))
    cls = F.nullif(F.replace(F.trim("ele_class"), F.lit("?"), F.lit("")), F.lit(""))
    parts = F.split(cls, "/")
    t = t.withColumns({"type": F.coalesce(F.get(parts, F.lit(0)), F.lit("Unspecified")), "subtype": F.coalesce(F.get(parts, F.lit(1)), F.lit("Unspecified")), "element": F.trim("ele")})
    t = running_masked(t, ["genome", "seq_name"], "ordinal", "seq_begin", "seq_end")
    # rows without an id are always new: each is a group of its own
    group = F.struct("hit_id", F.when(F.col("hit_id").isNull(), F.col("ordinal")).alias("own"))
    before = F.lag("element").over(W.partitionBy("genome", "seq_name", group).orderBy("ordinal"))
    return t.withColumn("is_new", F.when(F.col("hit_id").isNull() | before.isNull() | ~before.eqNullSafe(F.col("element")), 1).otherwise(0))


def by_element(h: DataFrame) -> DataFrame:
    return h.groupBy("element").agg(F.sum("is_new").alias("n"), F.sum("bp").alias("bp"))


def by_type(h: DataFrame) -> DataFrame:
    """Type and subtype, with a subtotal (subtype ``all``) per type."""
    g = h.groupBy("type", "subtype").agg(F.sum("is_new").alias("n"), F.sum("bp").alias("bp"))
    whole = g.groupBy("type").agg(F.sum("n").alias("n"), F.sum("bp").alias("bp")).select("type", F.lit("all").alias("subtype"), "n", "bp")
    return g.unionByName(whole).withColumn("interspersed", ~F.col("type").isin(*NOT_INTERSPERSED))


def masked_share(h: DataFrame, sizes: DataFrame) -> DataFrame:
    """Masked bases of each genome against its size without unknown bases: ``genome, bp, size, percent``."""
    g = h.groupBy("genome").agg(F.sum("bp").alias("bp")).join(sizes, "genome")
    return g.withColumn("percent", F.when(F.col("size") > 0, F.col("bp") * 100.0 / F.col("size")))


def family_hits(rm: DataFrame) -> DataFrame:
    """Hits in positions of their family: ``family, ordinal, len, s, e, pct_div, contig_cov``.

    ``len`` is the family's length by the row; ``contig_cov`` the share of the sequence that the hit covers.
    Rows whose positions are no numbers or out of order, and those without a name, are left out.
    """
    bare = lambda c: F.regexp_replace(c, "[()]", "").try_cast("long")
    plus = F.col("strand") == "+"
    cov = F.try_divide(F.col("seq_end") - F.col("seq_begin"), F.col("seq_end") + bare("left_bp"))
    x = rm.filter("trim(ele) <> ''").select(F.trim("ele").alias("family"), "ordinal", F.when(plus, bare("c2") + bare("c3")).otherwise(bare("c2") + bare("c1")).alias("len"), F.when(plus, bare("c1")).otherwise(bare("c3")).alias("s"), bare("c2").alias("e"), "pct_div", cov.alias("contig_cov"))
    return x.filter("s <= e and len > 0")


def family_status(hits: DataFrame, least_contig: float = 0.1, whole_contig: float = 0.95, whole: float = 0.95, most: float = 0.8, close: float = 5, near: float = 20) -> DataFrame:
    """``family, len, cover_close, cover_near, status`` from the hits of ``family_hits``.

    Only hits on more than ``least_contig`` of their sequence count. perfect: one hit with a divergence under
    ``close`` covers more than ``whole`` of the family and ``whole_contig`` of the sequence; good: hits under
    ``close``, merged over gaps of up to 10, cover more than ``whole``; present: hits under ``near`` cover more
    than ``most``; else missing. ``len`` is that of the first row.
    """
    h = hits.filter(F.col("contig_cov") > least_contig)
    perfect = (F.col("e") - F.col("s") > whole * F.col("len")) & (F.col("contig_cov") > whole_contig) & (F.col("pct_div") < close)
    n = h.groupBy("family").agg(F.min_by("len", "ordinal").alias("len"), F.coalesce(F.bool_or(perfect), F.lit(False)).alias("perfect"))
    for name, limit in (("cover_close", close), ("cover_near", near)):
        m = merged(h.filter(F.col("pct_div") < limit), ["family"], "s", "e", 10)
        n = n.join(m.groupBy("family").agg(F.sum(F.col("span_end") - F.col("span_start")).alias(name)), "family", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    status = F.when(F.col("perfect"), "perfect").when(F.col("cover_close") > whole * F.col("len"), "good").when(F.col("cover_near") > most * F.col("len"), "present").otherwise("missing")
    return n.select("family", "len", "cover_close", "cover_near", status.alias("status"))
