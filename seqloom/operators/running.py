"""Values that depend on the rows before, for keys of any size.

A window over a key sorts all rows of that key in one task. Here the order column is cut into buckets: a
window runs within one bucket of a key, one row per bucket carries on what lies before it, and both are put
together. Equal orders within a key are settled by ``ties``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Steps of the order column per bucket: rows of one task, where the order is unique within a key.
WIDTH = 1 << 20


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys, nulls included; the right side's are named with ``_r``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r{i}"]) for i, k in enumerate(keys)])


def _with_bucket(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    return df.withColumn("_bkt", F.floor(F.col(order) / width).cast("long"))


def _per_bucket(t: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return t.groupBy(*[F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, "_bkt"])]).agg(*[c.alias(n) for n, c in aggs.items()])


def running(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]], ties: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Adds to each row what the rows before it within ``keys`` come to, itself left out.

    ``values``: name to (kind, column); kinds: ``max``; ``sum`` (0 where nothing is before); ``last`` (the
    last that is not null). Rows with a null order come first, in one bucket. Repeated rows count each.
    """
    agg = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(order, *ties)))}
    t = _with_bucket(df, keys, order, width)
    per = _per_bucket(t, keys, {f"_v_{n}": agg[k](c) for n, (k, c) in values.items()})
    rk = [f"_r{i}" for i in range(len(keys))]
    before = W.partitionBy(*rk).orderBy(F.asc_nulls_first(f"_r{len(keys)}")).rowsBetween(W.unboundedPreceding, -1)
    over = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    offsets = per.select(*rk, f"_r{len(keys)}", *[over[k](F.col(f"_v_{n}")).over(before).alias(f"_o_{n}") for n, (k, _) in values.items()])
    within = W.partitionBy(*keys, "_bkt").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({f"_i_{n}": over[k](c).over(within) for n, (k, c) in values.items()})
    j = t.join(offsets, _same(t, offsets, [*keys, "_bkt"]))
    mix = {
        "max": lambda n: F.greatest(f"_i_{n}", f"_o_{n}"),
        "sum": lambda n: F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0)),
        "last": lambda n: F.coalesce(f"_i_{n}", f"_o_{n}"),
    }
    return j.select(*df.columns, *[mix[k](n).alias(n) for n, (k, _) in values.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Adds the number of each row within its key, from 0."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, ties, width)


def following(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, ties: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Adds ``value`` of the next row within the key, null for the last one. ``value`` must not be null (use a struct)."""
    t = _with_bucket(df, keys, order, width)
    per = _per_bucket(t, keys, {"_f": F.min_by(value, F.struct(F.struct(order, *ties)))})
    rk = [f"_r{i}" for i in range(len(keys))]
    nexts = per.select(*rk, f"_r{len(keys)}", F.lead("_f").over(W.partitionBy(*rk).orderBy(F.asc_nulls_first(f"_r{len(keys)}"))).alias("_n"))
    t = t.withColumn("_l", F.lead(value).over(W.partitionBy(*keys, "_bkt").orderBy(order, *ties)))
    j = t.join(nexts, _same(t, nexts, [*keys, "_bkt"]))
    return j.select(*df.columns, F.coalesce("_l", "_n").alias(name))
