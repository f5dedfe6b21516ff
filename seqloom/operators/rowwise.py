"""Alignments read row by row: each family is a stream of its rows, of which only the counts of its columns are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


class Columns:
    """Letters of the columns of a family whose rows come in order; shorter rows have gaps up to the end of the longest."""

    def __init__(self):
        self.rows, self.letters = 0, {c: i for i, c in enumerate("ACGT")}
        self.count, self.first = np.zeros((4, 0), np.int32), np.zeros((4, 0), np.int32)
        self.table = self._table()

    def _table(self) -> np.ndarray:
        out = np.full(max(map(ord, self.letters)) + 2, -1, np.int16)
        out[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        return out

    def add(self, text: str) -> None:
        new = set(text) - self.letters.keys() - {"-"}
        if new:
            self.letters |= {c: len(self.letters) + i for i, c in enumerate(sorted(new))}
            self.table = self._table()
        short = max(0, len(text) - self.count.shape[1])
        if new or short:
            grow = ((0, len(new)), (0, short and max(short, self.count.shape[1] // 4)))
            self.count, self.first = np.pad(self.count, grow), np.pad(self.first, grow)
        points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        code = self.table[np.minimum(points, len(self.table) - 1)]
        col = np.flatnonzero(code >= 0)
        at = code[col].astype(np.int64) * self.count.shape[1] + col
        count, first = self.count.reshape(-1), self.first.reshape(-1)
        first[at[count[at] == 0]] = self.rows
        count[at] += 1
        self.rows += 1

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each column the letter that most rows have (then the first seen), how many have it, and how many have a letter."""
        top = (self.count.astype(np.int64) * (self.rows + 1) - self.first).argmax(0)
        return np.array([ord(c) for c in self.letters], np.uint32)[top], np.take_along_axis(self.count, top[None], 0)[0], self.count.sum(0)


def majority_of(c: Columns) -> str:
    letter, n, _ = c.best()
    return letter[n > c.rows // 2].astype("<u4").tobytes().decode("utf-32-le")


def boundary_of(c: Columns, width: int) -> int | None:
    _, n, known = c.best()
    col = np.flatnonzero(known >= c.rows - c.rows // 2)
    if len(col) < width:
        return None
    h, need = n[col] / c.rows, 0.95 if c.rows <= 5 else 0.9 if c.rows <= 10 else 0.85
    total = np.sum([h[i : len(h) - width + 1 + i] for i in range(width)], axis=0)
    hit = np.flatnonzero(np.round(total / width, 9) >= need)
    if not len(hit):
        return None
    near = np.flatnonzero(h[hit[0] : hit[0] + width] >= need - 0.1)
    return int(col[hit[0] + near[0]]) if len(near) else None


def per_family(msa: DataFrame, name: str, kind: str, of: Callable[[Columns], object]) -> DataFrame:
    """``family`` and what ``of`` makes of the columns of ``family, row, seq``. Null and empty rows are left out, families without others too."""
    spark = msa.sparkSession
    t = msa.filter("seq is not null and seq <> ''").select("family", "row", "seq")
    family = t.schema["family"].dataType.simpleString()
    schema = spark.createDataFrame([], f"family {family}, {name} {kind}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        key, c, out = None, None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), out_schema)], schema=out_schema)

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if c is None or k != key:
                    if c is not None:
                        out.append((key, of(c)))
                    if len(out) >= 1000:
                        yield emit()
                        out = []
                    key, c = k, Columns()
                c.add(text)
        if c is not None:
            out.append((key, of(c)))
        if out:
            yield emit()

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return t.repartition(tasks, "family").sortWithinPartitions("family", "row").mapInArrow(run, schema)


def majority(msa: DataFrame) -> DataFrame:
    """``family, consensus``: the most frequent letter of each column if it is in more than half of the rows; other columns vanish."""
    return per_family(msa, "consensus", "string", majority_of)


def homology_boundary(msa: DataFrame, width: int = 10) -> DataFrame:
    """``family, boundary`` as of ``consensus.homology_boundary``; families without one are left out."""
    return per_family(msa, "boundary", "int", lambda c: boundary_of(c, width)).filter(F.col("boundary").isNotNull())
