"""Binary files: read from a folder, and written to one by the tasks themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their content; names that start with a dot are skipped, and Spark gives no row for a file of no bytes."""
    return spark.read.format("binaryFile").load(path).filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def write_files(df: DataFrame, path: str) -> int:
    """Write (name, content) rows as files of a folder that all executors can reach; returns how many there are.

    Each task opens the folder's file system itself, so nothing passes through the
    driver. A file gets its name only when it is whole: a task that is lost or runs
    twice leaves none cut short.
    """
    from pyarrow import fs

    target, base = fs.FileSystem.from_uri(path)
    target.create_dir(base, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = fs.FileSystem.from_uri(path)
        n = 0
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                with target.open_output_stream(part) as out:
                    out.write(bytes(content))
                target.move(part, f"{base}/{name}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return df.select("name", "content").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
