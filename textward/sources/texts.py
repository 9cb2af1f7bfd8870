"""Texts from files and tables."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of chunk rows from a folder of Parquet files."""
    return spark.readStream.schema("stream_id string, seq int, chunk string, is_last boolean").parquet(path)


def argument(text: str | None, file: str | None) -> str:
    """A command's text: given in place, else from a file, else from standard input."""
    if text is not None:
        return text
    return Path(file).read_text(encoding="utf-8") if file else sys.stdin.read()


def json_schema(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
