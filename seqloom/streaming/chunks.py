"""Structured Streaming over files that arrive in chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.sources.lines import scratch


def _replayed(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table as a stream of its files; new files in the folder would go on with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a Parquet table; the checkpoint makes a restart exact."""
    spark = stream.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest_once(df: DataFrame, id_col: str) -> DataFrame:
    """Rows of a stream, each id once: the first delivery of an id is kept, whatever its arrival time.

    There is no watermark, as files do not come in order of arrival times: the state holds every id, in
    RocksDB on the executors' disks.
    """
    spark = df.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_to_end(_replayed(df, "chunks").dropDuplicates([id_col]), "ingest")
    finally:
        spark.conf.set(key, before)


def part_schema(df: DataFrame, by: Sequence[str]) -> str:
    """Columns of one batch's counts; known beforehand, as a stream may bring nothing."""
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "day timestamp", "n long"])


def first_per_key(df: DataFrame, key: str, order: str, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` over a whole stream: ``key, order, keep``.

    The state, ``n`` rows per key at most, is carried from batch to batch as a table; a batch that runs twice
    begins from the state before it, so the result does not change. Rows may come in any order; a null key counts none.
    """
    spark = df.sparkSession
    cols = [key, order, *keep]
    s = _replayed(df.select(*cols).filter(F.col(key).isNotNull()), "firsts")
    at, state = scratch(spark, "firsts-state"), scratch(spark, "firsts-log")
    done: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(s.schema).parquet(f"{at}/{number - 1}") if number else batch.limit(0)
        rank = F.row_number().over(W.partitionBy(key).orderBy(order, *keep))
        batch.unionByName(before).withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r").write.mode("overwrite").parquet(f"{at}/{number}")
        done.append(number)

    q = s.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{at}/{max(done)}") if done else df.select(*cols).limit(0)


def windowed_counts(df: DataFrame, ts: str, by: Sequence[str], width: str) -> DataFrame:
    """Counts per tumbling window, written batch by batch: ``by, day, n``.

    Each batch is aggregated on its own and written under its number, so a batch that runs twice
    replaces itself; the parts are added up on reading. Late rows count in the window they belong
    to, however late they are.
    """
    spark = df.sparkSession
    s = _replayed(df, "events").withColumn("day", F.window(F.col(ts).cast("timestamp"), width)["start"])
    out, state = scratch(spark, "counts-out"), scratch(spark, "counts-state")

    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        done.append(number)
        part = batch.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = s.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(part_schema(df, by)).option("recursiveFileLookup", "true").parquet(out) if done else spark.createDataFrame([], part_schema(df, by))
    return found.groupBy(*by, "day").agg(F.sum("n").alias("n"))
