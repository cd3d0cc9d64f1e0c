"""Folders of tables, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def written_whole(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote a folder has ended: it leaves its mark last."""
    return table_exists(spark, f"{path}/_SUCCESS")


def remove_folder(spark: SparkSession, path: str) -> None:
    system, target = _place(spark, path)
    system.delete(target, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to a place of the same file system where nothing is."""
    system, target = _place(spark, path)
    if not system.rename(target, _place(spark, to)[1]):
        raise OSError(f"could not move {path} to {to}")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none where there is no such folder."""
    system, target = _place(spark, path)
    if not system.exists(target):
        return []
    return [str(status.getPath().getName()) for status in system.listStatus(target) if status.isDirectory()]


def folder_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column by the names of the table's folders; no file is opened."""
    return [name.removeprefix(f"{column}=") for name in folder_names(spark, path) if name.startswith(f"{column}=")]
