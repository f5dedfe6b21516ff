"""Insertions near genes and the expression of these genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.stats import benjamini_hochberg, t_p_value, welch
from seqloom.session import materialize

TYPES = ("Upstream", "Inside", "Downstream")
BASE = "No_Insertion"


def last_value(cell) -> Column:
    """Last item of a comma list as a number; ``NA`` and null are null."""
    return F.nullif(F.trim(F.element_at(F.split(cell, ","), -1)), F.lit("NA")).try_cast("double")


def placed_expression(assoc: DataFrame, expr: DataFrame) -> DataFrame:
    """One value per gene, position and sample: ``gene, sample, position, value``.

    ``assoc``: ``gene, sample, position, ordinal``; ``expr``: ``gene, sample, value``. Genes without an
    insertion get ``No_Insertion``; of several rows the first by ordinal counts; null values drop out.
    """
    e = expr.filter("value is not null")
    j = assoc.join(e, ["gene", "sample"], "right").withColumn("position", F.coalesce("position", F.lit(BASE)))
    g = j.groupBy("gene", "position", "sample").agg(F.min_by("value", F.coalesce("ordinal", F.lit(0))).alias("value"))
    return g.select("gene", "sample", "position", "value")


def moments(placed: DataFrame) -> DataFrame:
    return placed.groupBy("gene", "position").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def tests(placed: DataFrame) -> DataFrame:
    """Welch's t of each insert type against genes without insertion: ``gene, position, t, dof, fold``."""
    m = moments(placed)
    base = m.filter(F.col("position") == BASE).select("gene", F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("var").alias("v0"))
    x = m.filter(F.col("position") != BASE).join(base, "gene", "left")
    fold = F.log2(F.col("mean") + 1) - F.log2(F.col("m0") + 1)
    return welch(x, "n", "mean", "var", "n0", "m0", "v0").select("gene", "position", "t", "dof", fold.alias("fold"))


def differential(placed: DataFrame, p_most: float = 0.05, fold_least: float = 1.0) -> DataFrame:
    """One row per gene: ``gene, position, fold, p_adjusted, significant, direction``.

    Significant types come first, then Upstream, Inside, Downstream; a gene whose first type has
    no fold or p-value is dropped, even if another type could be tested.
    """
    # one row per gene and type, read several times by the adjustment: written once
    t = materialize(tests(placed).withColumn("p", t_p_value(F.col("t"), F.col("dof"))), "tests")
    t = benjamini_hochberg(t, ["position"], "p")
    sig = (F.abs("fold") > fold_least) & (F.col("p_adjusted") < p_most)
    t = t.withColumn("significant", F.coalesce(sig, F.lit(False)))
    t = t.withColumn("direction", F.when(~F.col("significant"), "ns").when(F.col("fold") > 0, "up").otherwise("down"))
    rank = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("position"))
    w = W.partitionBy("gene").orderBy(F.desc("significant"), rank)
    one = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and fold is not null and p_adjusted > 0")
    return one.select("gene", "position", "fold", "p_adjusted", "significant", "direction")
