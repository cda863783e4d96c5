"""Where a job may put files of its own: a folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or, without one, a folder of its warehouse.

    On a cluster the warehouse has to be set for that: by default it is a folder of the driver's machine.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not base and not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains(WAREHOUSE):
        raise ValueError(f"set {SETTING} (or {WAREHOUSE}) to a folder that all executors share")
    return base.rstrip("/") if base else f"{spark.conf.get(WAREHOUSE).rstrip('/')}/_scratch"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used: a rerun never overwrites what a reader still needs."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/shelfline/{app}/{label}-{uuid.uuid4().hex}"
