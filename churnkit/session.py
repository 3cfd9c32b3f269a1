"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "churnkit", extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's own."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(extra_conf or {})}.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CHURNKIT_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The setting is read from the session; a folder of our own is set only
    when none is configured and everything runs in this machine's JVM.  On a
    cluster a machine's own folder would hold files no other machine sees, so
    a missing setting is an error there.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if not cur:
        cur = spark.conf.get("spark.checkpoint.dir", None)
        if not cur:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            cur = tempfile.mkdtemp(prefix="churnkit-ckpt-")
        sc.setCheckpointDir(cur)
        cur = sc.getCheckpointDir()
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/churnkit-{name}-{uuid.uuid4().hex[:12]}"
