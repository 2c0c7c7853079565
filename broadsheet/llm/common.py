"""Shared folder, stored tables and sizes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session makes one of its own; any other session raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.conf.get("broadsheet.llm.folder", None) is None:
        spark.conf.set("broadsheet.llm.folder", tempfile.mkdtemp(prefix="broadsheet-"))
    return spark.conf.get("broadsheet.llm.folder")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, by one narrow aggregate."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not on their path."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in on_path or context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    context.addPyFile(shutil.make_archive(tempfile.mkdtemp() + "/broadsheet", "zip", root, "broadsheet"))
