"""Order-dependent algorithms over many small groups, without a Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], step: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``step(key, rows)`` makes of each group, its rows in ``order``.

    Rows are hash-partitioned by group and sorted within partitions by the JVM; a worker reads whole
    Arrow batches and cuts them at group borders, so thousands of small groups cost one pass. One
    group at a time is held in memory: the caller keeps groups bounded.
    """
    cols = df.columns
    at = [cols.index(g) for g in group]
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(spark_schema)
        names = out_schema.names

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], out_schema.field(i).type) for i in range(len(names))], names=names)

        key, held, out = None, [], []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                k = tuple(row[i] for i in at)
                if k != key:
                    if held:
                        out += step(key, held)
                    key, held = k, []
                    if len(out) >= 10_000:
                        yield emit(out)
                        out = []
                held.append(row)
        if held:
            out += step(key, held)
        if out:
            yield emit(out)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


