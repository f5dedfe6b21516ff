"""Pairs of rows that share a key, where a few keys are shared by many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.session import materialize

#: Rows of one key that are paired in one task; more are split into blocks.
BLOCK = 256


def pairs_by_key(keyed: DataFrame, keys: list[str], id_col: str, keep: list[str] = (), block: int = BLOCK, where: Column | None = None) -> DataFrame:
    """Pairs ``a < b`` of ids for each key that both have: ``keys, a, b`` and, of both rows, the columns ``keep`` as ``<name>_a, <name>_b``.

    Rows alone under their key go before the pairing. A key of many rows is cut into blocks by a hash of the id, and each pair
    of blocks is a group of its own, so that no task meets more than ``block`` times ``block`` pairs of one key.
    ``where``: a condition on the pairs. Ids must be unique under a key; null keys and ids pair with nothing.
    """
    known = F.col(id_col).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    blocks = F.ceil(F.col("_pair_n") / block).cast("int")
    shared = keyed.filter(known).select(*keys, id_col, *keep).withColumn("_pair_n", n).filter("_pair_n > 1")
    shared = materialize(shared.select(*keys, id_col, *keep, blocks.alias("_pair_m"), F.pmod(F.xxhash64(id_col), blocks).cast("int").alias("_pair_at")), "shared")
    one = lambda name, i, j: shared.select(*keys, F.col(id_col).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in keep], i.alias("_pair_i"), j.alias("_pair_j"))
    low = one("x", F.col("_pair_at"), F.explode(F.sequence(F.col("_pair_at"), F.col("_pair_m") - 1)))
    high = one("y", F.explode(F.sequence(F.lit(0), F.col("_pair_at"))), F.col("_pair_at"))
    met = low.join(high, [*keys, "_pair_i", "_pair_j"]).filter("_pair_i < _pair_j or x < y")
    turn = F.col("x") > F.col("y")
    pick = lambda c, p, q: F.when(turn, F.col(q)).otherwise(F.col(p)).alias(c)
    sides = [pick("a", "x", "y"), pick("b", "y", "x"), *[pick(f"{c}_a", f"{c}_x", f"{c}_y") for c in keep], *[pick(f"{c}_b", f"{c}_y", f"{c}_x") for c in keep]]
    out = met.select(*keys, *sides)
    return out if where is None else out.filter(where)
