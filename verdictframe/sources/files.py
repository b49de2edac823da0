"""Discovery of files: scans of whole folders and stored snapshots of their listing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.sources.sinks import FILE_KINDS, new_visual_files, visual_data


def any_case(extensions: list[str]) -> str:
    """Glob of the extensions, capitals included."""
    spelled = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return f"*.{{{','.join(spelled)}}}"


VISUAL_GLOB = any_case([e for kind in FILE_KINDS.values() for e in kind])


def file_scan(spark: SparkSession, root: str, glob: str = VISUAL_GLOB, since: datetime | None = None) -> DataFrame:
    """Files below ``root``, at any depth: path, modificationTime, length, content.

    The reader lists the folder and leaves out other names, and files of length 0, before it opens a file. ``since``
    leaves out older files in the same way, for folders whose files keep their time of writing;
    where files are moved in with an older time, leave it out and use a snapshot alone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    files = reader.load(root)
    return files if since is None else files.filter(F.col("modificationTime") >= F.lit(since))


def listing(spark: SparkSession, root: str, glob: str = VISUAL_GLOB) -> DataFrame:
    """Path, time and length of the files below ``root``; no content is read."""
    return file_scan(spark, root, glob).select("path", "modificationTime", "length")


def write_snapshot(spark: SparkSession, root: str, path: str, glob: str = VISUAL_GLOB) -> None:
    """Store the listing of ``root``, to be compared with a later one."""
    listing(spark, root, glob).write.mode("overwrite").parquet(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length bigint").parquet(path)


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of two listings: added, removed or changed (time or length differ)."""
    old = before.select("path", F.col("modificationTime").alias("_time"), F.col("length").alias("_length"))
    both = now.join(old, "path", "full")
    same = (F.col("modificationTime") == F.col("_time")) & (F.col("length") == F.col("_length"))
    change = F.when(F.col("_length").isNull(), "added").when(F.col("length").isNull(), "removed").when(~same, "changed")
    return both.select("path", change.alias("change")).filter(F.col("change").isNotNull())


def visual_outputs(
    spark: SparkSession, root: str, before: str, since: datetime | None = None, data: bool = False,
) -> DataFrame:
    """Files of visual kinds that the snapshot at ``before`` does not list: path, kind, digest.

    One file per content, the one with the first path; files of other kinds are not read and
    hide none. The scan turns contents into digests, so that shuffles carry no content.
    ``data`` adds the content as text or base64, by a second read of the files and a join by path.
    """
    files = file_scan(spark, root, since=since)
    found = new_visual_files(files.select("path", "content"), snapshot(spark, before))
    if not data:
        return found
    contents = files.select("path", "content")
    return found.join(contents, "path").withColumn("data", visual_data(F.col("kind"), F.col("content"))).drop("content")
