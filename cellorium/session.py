"""Session settings and the shared-folder checkpoint."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cellorium", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is written for.

    Nothing is forced onto a session that already runs: on a cluster the
    submitting side decides sizes, memory and the checkpoint folder.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting and without a directory a local master gets a temporary
    folder (tests on one machine); any other raises, since its executors share none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cellorium-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
