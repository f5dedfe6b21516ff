"""Mixing of sources to target weights, with capped repeats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import materialize

#: Records per bucket that the distributed prefix sums aim at.
PER_BUCKET = 20_000


def mix_plan(targets: DataFrame, totals: DataFrame, total: int | None = None) -> DataFrame:
    """Budget of each source in each mix: ``mix, source, share, cap, source_size, budget, epochs, rest``.

    ``targets``: ``mix, source, share, cap``; ``totals``: ``source, source_size``. Without
    ``total`` a mix gets the largest size at which no source of it has to repeat a record more than
    ``cap`` times, so that every share can be reached. With ``total`` a source that cannot fill its
    share gives all that its cap allows. Sources without records get no budget.
    """
    t = targets.join(totals, "source", "left").withColumn("source_size", F.coalesce("source_size", F.lit(0)))
    can = F.col("source_size") * F.col("cap")
    if total is None:
        fits = F.when((F.col("share") > 0) & (can > 0), can / F.col("share"))
        size = t.groupBy("mix").agg(F.min(fits).alias("mix_size"))
        t = t.join(size, "mix")
    else:
        t = t.withColumn("mix_size", F.lit(float(total)))
    budget = F.least(F.coalesce(F.round(F.col("share") * F.col("mix_size")), F.lit(0.0)).cast("long"), can.cast("long"))
    t = t.withColumn("budget", F.greatest(budget, F.lit(0)))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    return t.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("mix_size")


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Records of each mix with their number of copies, and the shares reached.

    ``records``: ``id, source, size`` (size in tokens); ``targets``: ``mix, source, share, cap``.
    Returns ``(picked: mix, source, id, size, copies; report: mix, source, share, reached,
    picked_size, n_records, max_copies)``.

    Method: every record has a hash key; within a source, records are sorted by it across the
    cluster and the prefix sums of their sizes are cut where they come nearest to the budget.
    All of a source is taken once per full epoch, the cut decides the last one. Prefix sums are
    those of buckets of the key range plus those within a bucket; a source that holds a third of
    all records has as many more buckets.

    Defined cases: records with a null id or source, or of no size (null and empty texts), are in
    no mix; ids must be unique within a source; ties of the key are settled by id; a source that
    no mix names gives nothing; a named source without records is reported with 0; empty tables
    give empty results.
    """
    r = records.select("id", "source", F.col("size").cast("long").alias("size")).filter("id is not null and source is not null and size > 0")
    r = materialize(r.withColumn("key", F.xxhash64("id", F.lit(seed))), "sizes")
    bits = min(24, max(2, math.ceil(math.log2(max(1, r.count()) / PER_BUCKET + 1))))
    r = r.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    per_bucket = r.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.withColumn("b_start", F.coalesce(F.sum("b_size").over(before), F.lit(0)))
    totals = per_bucket.groupBy("source").agg(F.sum("b_size").alias("source_size"))
    plan = mix_plan(targets, totals, total)
    # plans meet buckets, not records: the join with the records is on evenly filled buckets
    wanted = starts.join(plan, "source").filter((F.col("epochs") > 0) | (F.col("b_start") < F.col("rest")))
    wanted = wanted.select("source", "bucket", "mix", "b_start", "epochs", "rest")
    within = W.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = r.withColumn("r_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = F.col("b_start") + F.col("r_start")
    last = (2 * F.col("rest") >= 2 * start + F.col("size")).cast("long")  # the cut nearest to the budget
    picked = placed.join(wanted, ["source", "bucket"]).select("mix", "source", "id", "size", (F.col("epochs") + last).alias("copies")).filter("copies > 0")
    got = picked.groupBy("mix", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("picked_size"), F.count(F.lit(1)).alias("n_records"), F.max("copies").alias("max_copies"))
    rep = targets.select("mix", "source", "share").join(got, ["mix", "source"], "left").fillna(0, ["picked_size", "n_records", "max_copies"])
    whole = F.sum("picked_size").over(W.partitionBy("mix"))
    rep = rep.withColumn("reached", F.when(whole > 0, F.col("picked_size") / whole).otherwise(0.0))
    return picked, rep.select("mix", "source", "share", "reached", "picked_size", "n_records", "max_copies")
