"""Sessions for local work, and the one place that decides where checkpoints go."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup of this many rows of at most ten fixed-width columns takes under 40 MB when broadcast.
BROADCAST_ROWS = 200_000


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, with the settings that the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("driftaudit").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared checkpoint folder; their lineage ends here.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset on a local master (tests) does a
    temporary folder of this process stand in; on a cluster without the setting this raises.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix=f"driftaudit-{os.getpid()}-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def lookup(small: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small`, computed once and counted: marked for broadcast below the bound, left to a shuffle join above it."""
    kept = cut(small)
    return F.broadcast(kept) if kept.count() <= broadcast_rows else kept
