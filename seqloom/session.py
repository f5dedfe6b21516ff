"""Session helpers: where intermediate tables go, how tables are loaded."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    The cluster names a folder that all executors share in
    ``spark.checkpoint.dir``; only where that is unset, as in tests on one
    machine, a temporary folder is made and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_seqloom_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._seqloom_dir = own
    return own


def _tables_dir(spark: SparkSession) -> str:
    """Subfolder of this application; it is removed with all its tables when the program ends, or by ``drop_tables``."""
    path = f"{shared_dir(spark)}/seqloom-{spark.sparkContext.applicationId}"
    if getattr(spark, "_seqloom_tables", None) != path:
        spark._seqloom_tables = path
        atexit.register(drop_tables, spark)
    return path


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that this application wrote to the shared folder. Results that still read them are lost."""
    path = getattr(spark, "_seqloom_tables", None)
    if path is None or spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended before
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Survives the loss of executors, unlike a local checkpoint, and later
    scans of it are column-pruned.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that their workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seqloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/seqloom_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._seqloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{name}_"
    return name
