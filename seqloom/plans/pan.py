"""Presence of families over genomes: categories and pan/core sizes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Genomes in one long of a mask; more genomes take more longs.
PER_WORD = 62


def _words(n: int) -> range:
    return range((n + PER_WORD - 1) // PER_WORD)


def presence(counts: DataFrame, genomes: list[str]) -> DataFrame:
    """``family`` and a bit mask ``m0, m1, ...`` of the genomes that have it; ``counts``: ``family, genome, n``. Any number of genomes."""
    place = F.create_map(*[x for i, g in enumerate(genomes) for x in (F.lit(g), F.lit(i))]) if genomes else F.lit(None).cast("map<string,int>")
    t = counts.filter(F.col("n") > 0).select("family", F.try_element_at(place, F.col("genome")).alias("i")).filter("i is not null")
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("i") / PER_WORD) == w, F.expr(f"shiftleft(1L, i % {PER_WORD})")).otherwise(F.lit(0).cast("long")))
    return t.groupBy("family").agg(*[bit(w).alias(f"m{w}") for w in _words(max(1, len(genomes)))])


def categories(masks: DataFrame, n_genomes: int, soft: float = 0.8) -> DataFrame:
    """core (all), softcore (at least ``soft`` of them), dispensable (two or more), private (one)."""
    c = reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks.columns if m != "family"])
    kind = F.when(c == n_genomes, "core").when(c >= soft * n_genomes, "softcore").when(c >= 2, "dispensable").otherwise("private")
    return masks.select("family", c.alias("n_genomes"), kind.alias("category"))


def subsets(spark: SparkSession, n: int, most: int = 1000) -> DataFrame:
    """The first ``most`` combinations of each size as masks: ``size, no, s0, s1, ...``. At most ``most * n`` rows, made on the driver."""
    rows = []
    for k in range(1, n + 1):
        for no, c in enumerate(islice(combinations(range(n), k), most)):
            rows.append((k, no, *(sum(1 << (i - w * PER_WORD) for i in c if i // PER_WORD == w) for w in _words(n))))
    return spark.createDataFrame(rows, "size int, no int" + "".join(f", s{w} long" for w in _words(n)))


def curve(masks: DataFrame, subs: DataFrame) -> DataFrame:
    """Mean and deviation of pan and core size by number of genomes: ``size, pan_mean, pan_sd, core_mean, core_sd``.

    Families are counted by mask first, of which there are few, before subsets come in.
    """
    words = [c[1:] for c in masks.columns if c != "family"]
    distinct = masks.groupBy(*[f"m{w}" for w in words]).agg(F.count(F.lit(1)).alias("k"))
    both: list[Column] = [F.col(f"m{w}").bitwiseAND(F.col(f"s{w}")) for w in words]
    some = reduce(lambda a, b: a | b, [x != 0 for x in both])
    has_all = reduce(lambda a, b: a & b, [x == F.col(f"s{w}") for x, w in zip(both, words)])
    # subsets are bounded by their cap; masks by the families
    x = distinct.join(F.broadcast(subs), some)
    per = x.groupBy("size", "no").agg(F.sum("k").alias("pan"), F.coalesce(F.sum(F.when(has_all, F.col("k"))), F.lit(0)).alias("core"))
    return per.groupBy("size").agg(*[F.round(f(c), 2).alias(f"{c}_{n}") for c in ("pan", "core") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
