"""Session factory used by scripts and tests; library code never builds a session itself."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a context; their Python need not have it installed.

    The archive is served by the driver, so no shared folder is involved; queries
    started from several threads wait for the first to add it.
    """
    sc = spark.sparkContext
    with _shipping:
        if getattr(sc, "_varve_shipped", False):
            return
        home = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="varve-ship-")), "varve.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(home.rglob("*.py")):
                archive.write(file, str(file.relative_to(home.parent)))
        sc.addPyFile(path)
        sc._varve_shipped = True


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "varve") -> SparkSession:
    """A local session with adaptive execution, UTC dates and a small number of shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, may do without: it gets
    a temporary folder.  A cluster that names none is refused, since its executors
    would write to disks that nobody else can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="varve-shared-")


def durable(df):
    """``df`` written to the checkpoint folder (``shared_folder`` if none is set) and reread: an executor that is lost costs a reread."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables under ``sf_dir``; a path only Spark can open is fine."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
