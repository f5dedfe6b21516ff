"""Evaluation of a test annotation against a standard one, and of predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.intervals import nearest_bin, overlap_len, overlap_join


def library_metrics(std: DataFrame, test: DataFrame, share: float, width: int = 100_000, mode: str = "reference") -> DataFrame:
    """Sensitivity, precision, F1 and false discovery rate in bases (4 decimals).

    Tables: ``chrom, start, end`` with a unique ``id``. A test fragment adds its length once per
    standard fragment that it overlaps by ``share`` both ways, else to the false positives;
    standard fragments that no test fragment meets are false negatives. ``reference`` compares only
    fragments of one bin of ``width``; ``exact`` compares all that overlap. Null where a denominator is 0.
    """
    s = std.select("chrom", F.col("id").alias("s_id"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    t = test.select("chrom", F.col("id").alias("t_id"), F.col("start").alias("t0"), F.col("end").alias("t1"))
    if mode == "reference":
        pairs = s.withColumn("bin", nearest_bin(F.col("s0"), F.col("s1"), width)).join(t.withColumn("bin", nearest_bin(F.col("t0"), F.col("t1"), width)), ["chrom", "bin"])
    else:
        pairs = overlap_join(s, t, ["chrom"], "s0", "s1", "t0", "t1")
    ls, lt, ov = F.col("s1") - F.col("s0"), F.col("t1") - F.col("t0"), overlap_len("s0", "s1", "t0", "t1")
    hit = pairs.filter((ls > 0) & (lt > 0) & (ov >= share * ls) & (ov >= share * lt)).select("s_id", "t_id", lt.alias("n"))
    z = lambda df, c, n: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n))
    tp = z(hit, F.col("n"), "tp")
    fp = z(t.join(hit.select("t_id").distinct(), "t_id", "left_anti"), lt, "fp")
    fn = z(s.join(hit.select("s_id").distinct(), "s_id", "left_anti"), ls, "fn")
    one = tp.select("tp", fp.scalar().alias("fp"), fn.scalar().alias("fn"))
    a, b, c = F.col("tp"), F.col("fp"), F.col("fn")
    q = lambda x, y: F.round(F.when(y > 0, x / y), 4)
    return one.select("tp", "fp", "fn", q(a, a + c).alias("sensitivity"), q(a, a + b).alias("precision"), q(2 * a, 2 * a + b + c).alias("f1"), q(b, a + b).alias("fdr"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``truth, predicted, n``."""
    return pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label that occurs on either side; 0 where undefined."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    side = conf.select(F.explode(F.array(*[F.struct(F.col(k).alias("label"), F.lit(k).alias("side"), (F.col("truth") == F.col("predicted")).alias("ok"), "n") for k in ("truth", "predicted")])).alias("x")).select("x.*")
    g = side.groupBy("label").agg(z(F.when((F.col("side") == "truth") & F.col("ok"), F.col("n"))).alias("tp"), z(F.when(F.col("side") == "truth", F.col("n"))).alias("actual"), z(F.when(F.col("side") == "predicted", F.col("n"))).alias("called"))
    p, r = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    return g.select("label", "tp", "actual", "called", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(F.round(F.sum("tp") / F.sum("actual"), 6).alias("accuracy"), *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
