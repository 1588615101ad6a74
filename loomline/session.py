"""Sessions and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; partition counts are left to the cluster and to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, name: str = "loomline", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder is set and used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-loomline-", dir="/tmp"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; inside ``released`` it goes at its end."""
    path = f"{scratch_dir(spark).rstrip('/')}/loomline-{name}-{uuid.uuid4().hex}"
    owned = getattr(spark.sparkContext, "_loomline_written", None)
    if owned is not None:
        owned.append(path)
    return path


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write a step once to the shared folder and read it back: lineage ends here, and no later step repeats the work.

    A task holds a row group, of ``group_bytes`` if given, while it writes or reads. The files outlive the loss of any executor. They stay until the cluster clears its scratch folder, because the
    returned frame may be read at any later time; inside ``released`` they go at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Owns what ``materialise`` writes inside, and removes it at the end. Results must have been written before that."""
    context, outer = spark.sparkContext, getattr(spark.sparkContext, "_loomline_written", None)
    context._loomline_written = written = []
    try:
        yield
    finally:
        context._loomline_written = outer
        for path in written:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """For heavy work on each row: rows of a scan with fewer partitions than cores, as of one small file, over all cores.

    A scan that keeps every core busy is left as it is, so at size nothing is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, where the cluster has not installed it."""
    context = spark.sparkContext
    if getattr(context, "_loomline_shipped", False):
        return
    folder = Path(__file__).resolve().parent
    if folder.parent.suffix != ".zip":
        archive = Path(tempfile.mkdtemp(prefix="spark-loomline-"), "loomline_package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(folder.rglob("*.py")):
                out.write(path, path.relative_to(folder.parent))
        context.addPyFile(str(archive))
    context._loomline_shipped = True
