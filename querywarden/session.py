"""Session settings, the shared scratch folder and the code that executors need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_made: list[str] = []
_shipped: set[str] = set()


def build_session(app: str = "querywarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; skewed joins are split even if that adds a shuffle."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # let top-n ranks be cut before the shuffle for larger n, too
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
        # whole files travel to Python in these batches
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder is made if driver and executors are one process; on a
    cluster that is an error, because executors would write to their own disks.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        if not _one_machine(spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="querywarden-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder; no two calls share one."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove every scratch folder this process has asked for; call it once no result is read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no replay."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the parts that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    fd, archive = tempfile.mkstemp(prefix="querywarden-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
