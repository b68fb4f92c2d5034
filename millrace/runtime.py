"""Session helpers shared by every operator: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, a local session gets a
    temporary folder; a cluster session without one is refused, since a machine-local folder would be invisible
    to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage (reliable, not executor-local).

    With ``rows``, partitions are read together until they hold about so many rows each: what an input of many
    partitions has been reduced to does not travel on as crumbs, each with files of its own in every later shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    return kept if rows is None else kept.coalesce(max(1, -(-kept.count() // rows)))
