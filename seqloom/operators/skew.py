"""Aggregation over keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deliver_once(df: DataFrame, record_id: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per ``record_id``: the first by ``order`` (by the other columns without one). Rows with a null id are dropped.

    Ids are spread evenly whatever the keys are, so this shuffle has no hot partition. It is one shuffle
    and one sort; columns that are not used afterwards are not shuffled.
    """
    rest = [c for c in df.columns if c != record_id]
    w = W.partitionBy(record_id).orderBy(*(order or rest))
    # not row_number() = 1: its limit would sort the rows once more before the shuffle, for few repeated ids
    first = F.lag(F.lit(1)).over(w).isNull()
    return df.filter(F.col(record_id).isNotNull()).withColumn("_first", first).filter("_first").drop("_first")


def compact_state(df: DataFrame, keys: Mapping[str, Column], measures: Mapping[str, Column], count: str) -> DataFrame:
    """Row count and sums per key: the state that replaces the rows of an input before a join.

    Map-side partial aggregation leaves at most one row per key and task to shuffle, so a
    key that holds a third of all rows costs no more than any other. Null keys keep a row.
    """
    aggs = [F.count(F.lit(1)).alias(count), *[F.sum(c).alias(n) for n, c in measures.items()]]
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*aggs)


def join_states(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """Join compact states, null keys matching each other; keys of either side come out once."""
    ks = list(keys)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in ks], *[c for c in right.columns if c not in ks])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in ks])
    out = left.join(r, cond, how)
    return out.select(*[F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in ks], *[c for c in out.columns if c not in ks and not c.startswith("_r_")])


def eager_join_totals(
    left: DataFrame,
    right: DataFrame,
    key: str,
    l_count: str,
    r_count: str,
    l_sums: Sequence[str] = (),
    r_sums: Sequence[str] = (),
    pairs: str = "n_pairs",
) -> DataFrame:
    """Totals of the inner join of two inputs on ``key``, from their compact states alone.

    The join has ``l_count * r_count`` rows of a key, and each row of the left meets every row
    of the right: a sum over the left counts ``r_count`` times and the other way round. Null
    keys join nothing, as in SQL.
    """
    j = left.join(right, key)
    n = {pairs: F.col(l_count) * F.col(r_count)}
    n |= {c: F.col(c) * F.col(r_count) for c in l_sums} | {c: F.col(c) * F.col(l_count) for c in r_sums}
    return j.select(key, *[v.alias(k) for k, v in n.items()])


def key_share_at_least(states: DataFrame, group: str, key: str, count: str, percent: int) -> DataFrame:
    """Keys of each group whose count is at least ``percent`` of the group's total, null keys included in the total: ``group, key``.

    The totals are a roll-up of the compact states, not of the rows.
    """
    r = states.groupBy(group).agg(F.sum(count).alias("_t"))
    t = states.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(count).alias("_n"))
    got = t.join(r, t["_g"] == r[group]).filter(F.col("_n") * 100 >= F.col("_t") * percent)
    return got.filter("_k is not null").select(group, F.col("_k").alias(key))
