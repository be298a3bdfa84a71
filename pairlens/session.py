"""Session settings and the shared folder for state that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Replies may repeat a JSON key; the last one wins instead of failing the parse.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(name: str, cpus: int | str = "*", partitions: int = 8, memory: str = "8g",
                  folder: str | None = None) -> SparkSession:
    """A session on this machine, for tests, checks and the benchmark; ``folder`` keeps its state."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(partitions)))
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set on the context; a temporary one only on a
    local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pairlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_state_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
