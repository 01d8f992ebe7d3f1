"""The folder that the driver and all executors share, for tables that an operator writes on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, the context's checkpoint folder; a local session
    without one gets a new folder, while a cluster, whose executors could not see that, raises RuntimeError."""
    context = spark.sparkContext
    found = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="turnwise-"))
        found = context.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
