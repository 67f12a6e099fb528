"""Session set-up and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Values the results depend on (time zone, ANSI) or the physical plans count on (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}

# For some 100 TB of facts: reduce tasks of a few hundred MB before AQE merges the
# small ones, larger scan tasks (fewer partial rows per slot), state off the heap.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app: str = "marquee",
    master: str | None = None,
    cluster: bool = False,
    **extra: str,
) -> SparkSession:
    """Session with the settings above; ``extra`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | CLUSTER_SETTINGS if cluster else SETTINGS
    for name, value in settings.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


# The folder of a local session without a checkpoint folder; it goes with the process.
OWN_FOLDERS: list[str] = []


def own_folder() -> str:
    if not OWN_FOLDERS:
        OWN_FOLDERS.append(tempfile.mkdtemp(prefix="marquee-"))
        atexit.register(shutil.rmtree, OWN_FOLDERS[0], ignore_errors=True)
    return OWN_FOLDERS[0]


def has_scheme(path: str | None) -> bool:
    return bool(path and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` or, on a cluster where that is not set
    or has no scheme, below the warehouse, which all executors share too.

    Only a session within one process may fall back to the machine's temporary
    folder, or take a path without a scheme: on a cluster a folder that one machine
    sees is lost together with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and not has_scheme(root):
        # Spark itself puts the scheme in front of the warehouse's path.
        root = spark.conf.get("spark.sql.warehouse.dir", None)
        if not has_scheme(root):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that all executors share, "
                "with its scheme"
            )
    return f"{(root or own_folder()).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: its size is then known, and a lost
    executor costs a re-read of it. It goes with the process, or before by
    ``remove_written``."""
    path = shared_folder(frame.sparkSession, purpose)
    if not WRITTEN:
        atexit.register(remove_written)
    WRITTEN.append((frame.sparkSession, path))
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# Tables that ``written`` left, with their sessions.
WRITTEN: list[tuple[SparkSession, str]] = []


def remove_written() -> None:
    """Deletes the tables of ``written``, once no frame that reads them is needed."""
    while WRITTEN:
        spark, path = WRITTEN.pop()
        # Nothing can be deleted any more through a session that was stopped.
        if spark.sparkContext._jsc is not None:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this package, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty frame that Spark knows to be empty while it plans."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
