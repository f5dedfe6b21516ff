"""Frequency of every distinct term by sorting and scanning runs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_PARTIAL = "field string, term string, n_records long, n_homes long, first_home string, last_home string, part int"
_NAMES = ["field", "term", "n_records", "n_homes", "first_home", "last_home", "part"]


def _differs(t: pa.RecordBatch, names: list[str]) -> pa.Array:
    """For each row but the first: does any of the columns differ from the row before? Nulls are equal."""
    out = None
    for n in names:
        c = t.column(n)
        a, b = c[1:], c[:-1]
        d = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out = d if out is None else pc.or_(out, d)
    return out


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by field, term, home, record; one partial row per run of a term and batch, all as arrays.

    A run that goes on in the next batch gives another row, with the home that it goes on with; such rows
    are put together like those of a run that passes a partition border.
    """
    part = TaskContext.get().partitionId()
    last: pa.RecordBatch | None = None  # last row of the batch before
    for b in batches:
        if not b.num_rows:
            continue
        joined = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0] if last is not None else b
        if joined.num_rows > 1:
            term = np.asarray(_differs(joined, ["field", "term"]))
            home = term | np.asarray(_differs(joined, ["home"]))
            rec = home | np.asarray(_differs(joined, ["record"]))
        else:
            term = home = rec = np.zeros(0, bool)
        if last is None:  # the first row of all begins a run of everything
            term, home, rec = (np.r_[True, x] for x in (term, home, rec))
        starts = np.unique(np.r_[0, np.flatnonzero(term)])
        ends = np.r_[starts[1:], b.num_rows]
        known = np.asarray(pc.is_valid(b.column("home")))
        n_rec = np.add.reduceat(rec.astype(np.int64), starts)
        n_home = np.add.reduceat((home & known).astype(np.int64), starts)
        first, final = pa.array(starts), pa.array(ends - 1)
        # a home that goes on from the batch before is counted there: its row must not be taken for a new meeting
        begins = b.column("home").take(first)
        if not home[0]:
            begins = pa.concat_arrays([pa.nulls(1, begins.type), begins.slice(1)])
        cols = [b.column("field").take(first), b.column("term").take(first), pa.array(n_rec), pa.array(n_home), begins, b.column("home").take(final), pa.array(np.full(len(starts), part, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES)
        last = b.slice(b.num_rows - 1, 1)


def term_frequencies(df: DataFrame, fields: Mapping[str, Column], record: str, home: str) -> DataFrame:
    """Records and distinct homes of every distinct term: ``field, term, n_records, n_homes``.

    ``fields`` names the term columns; ``record`` identifies a record and ``home`` the group it
    lies in (a document, a sequence). Method: pairs of term and record are sorted across the
    cluster by field, term, home and record, and each partition is scanned once: runs of equal
    terms give the counts. A frequent term is cut by the range partitioning like any other
    stretch of the order, so no task gets more than its share; runs that pass a partition border
    are put together afterwards from one row per term and partition, a home on both sides of the
    border counting once.

    Defined cases: null terms are left out (normalise empty ones to null); a record delivered
    twice counts once per term and home; a record with a null id is left out; a null home counts
    no home; an empty table gives an empty result. Other columns are ignored.
    """
    pairs = df.filter(F.col(record).isNotNull()).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("term")) for n, c in fields.items()])).alias("p"),
        F.col(home).cast("string").alias("home"),
        F.col(record).alias("record"),
    )
    pairs = pairs.select("p.field", "p.term", "home", "record").filter("term is not null")
    order = ["field", "term", "home", "record"]
    partial = pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_runs, _PARTIAL)
    # rows of a term within a partition meet without a gap: their outer homes are the least and the largest
    partial = partial.groupBy("field", "term", "part").agg(F.sum("n_records").alias("n_records"), F.sum("n_homes").alias("n_homes"), F.min("first_home").alias("first_home"), F.max("last_home").alias("last_home"))
    w = W.partitionBy("field", "term").orderBy("part")
    met = partial.withColumn("again", F.coalesce((F.lag("last_home").over(w) == F.col("first_home")).cast("long"), F.lit(0)))
    return met.groupBy("field", "term").agg(F.sum("n_records").alias("n_records"), (F.sum("n_homes") - F.sum("again")).alias("n_homes"))


def marked_terms(freq: DataFrame, homes: DataFrame, rare_max: int = 2, common_percent: int = 60) -> DataFrame:
    """Terms too rare (at most ``rare_max`` records) or too common (in more than ``common_percent`` % of the homes).

    ``homes`` has one row and column, the number of homes. Both marks give two rows.
    """
    rare = F.when(F.col("n_records") <= rare_max, F.lit("rare"))
    common = F.when(F.col("n_homes") * 100 > homes.scalar() * common_percent, F.lit("common"))
    return freq.select("field", "term", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))
