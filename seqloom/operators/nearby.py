"""Texts of one length with few mismatches, and greedy choices among neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import mismatches
from seqloom.operators.consensus import components
from seqloom.operators.ordered import ordered_groups
from seqloom.operators.pairs import pairs_by_key


def hamming_pairs(df: DataFrame, group: Sequence[str], id_col: str, text: str, most: int) -> DataFrame:
    """Pairs ``a < b`` of ids of one group whose texts have one length and at most ``most`` mismatches.

    Two such texts agree in at least one of ``most + 1`` parts, so they meet by the text of a part; a pair is
    kept at its first common part only. Ids must be unique, texts distinct within a group (see
    ``hamming_clusters``) and groups not null; a part that very many distinct texts share is split into blocks.
    """
    n = F.length(text)
    at = lambda i: F.floor(F.lit(i) * n / (most + 1)).cast("int")
    parts = F.array(*[F.substring(F.col(text), at(i) + 1, at(i + 1) - at(i)) for i in range(most + 1)])
    t = df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(id_col).alias("_id"), F.col(text).alias("_t"), n.alias("_n"), parts.alias("_p"))
    x = t.select("*", F.posexplode("_p").alias("_i", "_k"))
    keys = [*[f"_g{i}" for i in range(len(group))], "_n", "_i", "_k"]
    first = ~F.exists(F.slice(F.zip_with("_p_a", "_p_b", lambda p, q: p == q), F.lit(1), F.col("_i")), lambda e: e)
    met = pairs_by_key(x, keys, "_id", ["_t", "_p"], where=first & (mismatches("_t_a", "_t_b") <= most))
    return met.select("a", "b")


def hamming_clusters(df: DataFrame, group: Sequence[str], id_col: str, text: str, most: int) -> DataFrame:
    """Components of texts linked by at most ``most`` mismatches: ``id_col, cluster`` (the smallest id of the cluster).

    Equal texts are one node, however many there are. Rows with a null text are left out.
    """
    t = df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(*group, F.col(id_col), F.col(text))
    nodes = t.groupBy(*group, text).agg(F.min(id_col).alias("_node"))
    comp = components(hamming_pairs(nodes, group, "_node", text, most))
    named = nodes.join(comp, F.col("_node") == F.col("node"), "left").select(*group, text, F.coalesce("component", "_node").alias("cluster"))
    return t.join(named, [*group, text]).select(id_col, "cluster")


def greedy_kept(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes kept when they are taken in order and one goes if a neighbour was kept before: ``node``.

    ``nodes``: ``node, ord``; ``edges``: ``a, b``, undirected. Only connected nodes bear on each other, so
    each component is worked on alone, in order; nodes without edges are kept. A component must fit a task.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    comp = components(edges.filter("a <> b"))
    work = both.join(nodes.select(F.col("node").alias("a"), "ord"), "a").join(comp, F.col("a") == F.col("node")).select("component", "ord", "a", "b")

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        near: dict = {}
        for _, _, a, b in rows:  # in order of a
            near.setdefault(a, []).append(b)
        kept = set()
        for a, bs in near.items():
            if kept.isdisjoint(bs):
                kept.add(a)
        return [(a,) for a in near if a in kept]

    kind = nodes.schema["node"].dataType.simpleString()
    got = ordered_groups(work, ["component"], ["ord", "a", "b"], step, f"node {kind}")
    return got.unionByName(nodes.select("node").join(both.select(F.col("a").alias("node")).distinct(), "node", "left_anti"))
