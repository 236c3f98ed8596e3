"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_stages: dict[tuple[str, str, str], str] = {}


def build_session(cores: int | str = "*", memory: str = "20g") -> SparkSession:
    """A local session for tests and benches; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("msgsieve")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without it is
    refused, because a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="msgsieve-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/msgsieve/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per application and read it back.

    The table cuts the lineage, survives lost executors, and gives later plans a columnar scan
    with column pruning and real size statistics.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _stages:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _stages[key] = path
    return spark.read.parquet(_stages[key])
