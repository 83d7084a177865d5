"""Session, shared-folder and size-check helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sieveloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIEVELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sieveloom-")) / "sieveloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    sc.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="sieveloom-")
        sc.setCheckpointDir(configured)
    return configured or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives the loss of executors.

    Parquet keeps it a fraction of a checkpoint's size and lets later reads prune columns and rows. The
    files go when the driver's JVM ends, or at the end of a ``scratch`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveloom-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within the block are removed at its end, so a long session doesn't fill the shared
    folder. Results must have been written or collected by then."""
    first = len(_TABLES)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_TABLES) > first:
            at = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
            at.getFileSystem(conf).delete(at, True)


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has no more than ``bound`` rows, without counting beyond the bound."""
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """Hint a broadcast only after the row bound is checked; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if at_most(df, bound) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
