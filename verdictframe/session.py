"""Session settings and lineage truncation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "verdictframe", cores: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    cores = cores or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERDICTFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("VERDICTFRAME_SHARED_DIR") or tempfile.mkdtemp(prefix="verdictframe-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder: executors of a
    cluster cannot read one another's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    scratch = tempfile.mkdtemp(prefix="verdictframe-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def truncate(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and forget its lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete what :func:`truncate` stored for ``df``; no frame may read it any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        files, at = _file_system(df.sparkSession, file.get())
        files.delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path``, none where it does not exist. Reads no data."""
    files, at = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def move_aside(spark: SparkSession, path: str) -> str | None:
    """Rename an existing folder to a fresh backup name; the name, or None without a folder."""
    files, at = _file_system(spark, path)
    if not files.exists(at):
        return None
    backup = f"{path.rstrip('/')}_backup_{uuid.uuid4().hex}"
    if not files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(backup)):
        raise OSError(f"cannot move {path} to {backup}")
    return backup


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint only after a bounded count proved the side small, its texts included.

    Reads at most ``max_rows + 1`` rows to decide. A larger side keeps the
    plain shuffle join, so results never depend on the outcome.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    size = F.sum(sum(texts, F.lit(0)).cast("long")).alias("size")
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), size).first()
    if found["n"] <= max_rows and (found["size"] or 0) <= max_bytes:
        return F.broadcast(df)
    return df
