"""Session building and the few settings the operators read from a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "corvidex", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    return SparkSession.builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is what the cluster names. Only where it is unset, and only
    for a single-machine master (tests), a folder of our own is made.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="corvidex-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*checkpointed: DataFrame) -> None:
    """Deletes the files of checkpointed tables that nothing reads any more.

    Loops that replace their state step by step call this on the old state once the new one
    is written, so the folder holds one state, not all of them. Other plans are left alone.
    """
    for df in checkpointed:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which a lookup side may be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` itself.

    The check reads at most ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
