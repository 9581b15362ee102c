"""Folders of written tables, through Hadoop's file system (so any shared storage will do)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended well."""
    return exists(spark, f"{path}/_SUCCESS")


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def numbers_in(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers of the folders ``<key>=<number>`` under ``path``, in order."""
    return sorted(int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith(f"{key}="))


def mark(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
