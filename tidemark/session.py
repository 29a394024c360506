"""Session helpers: settings, checkpoints in the shared folder, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan for work that takes long for each byte: over all cores where its files give too few partitions to use them.

    Only tables of a few files are shuffled; filters and columns are still pushed below.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 2 * scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._tidemark_shipped = True
