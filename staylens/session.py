"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "staylens") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the one of ``spark.checkpoint.dir``.

    Only where that is unset on a single machine, as in tests, it is a temporary one; on a cluster its
    executors could not share that, so there RuntimeError is raised.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHARED:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _SHARED[sc.applicationId] = named or tempfile.mkdtemp(prefix="staylens-checkpoint-")
    return _SHARED[sc.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint in the ``shared_folder``."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once an application.

    The archive lies in the shared folder of ``spark.checkpoint.dir`` where that is a mounted path;
    else the driver serves it to every executor, those that come later included.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    folder = Path(shared) / sc.applicationId if shared.startswith("/") else Path(tempfile.mkdtemp(prefix="staylens-"))
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / "staylens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
