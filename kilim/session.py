"""Session helpers: nothing here starts a job."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kilim", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library counts on; a running one is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, so that their Python finds it."""
    context = spark.sparkContext
    if getattr(context, "_kilim_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kilim-")) / "kilim.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._kilim_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and the master is local (tests), a temporary folder is made
    and set; on a cluster without the setting it raises, as a machine's own folder would
    be lost with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kilim-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """df over at least `waves` partitions for each core, for work bound by the CPU: a scan of a
    few large files would leave most cores idle, or all but the last waiting. No shuffle where
    there are enough."""
    least = waves * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
