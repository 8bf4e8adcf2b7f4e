"""What the training-data operators share: tables, shipping, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
#: The six characters that end a word in every contract: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``, by a path that only Spark need be able to read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package.

    Where the package's folder is on PYTHONPATH the workers find it there.
    Otherwise its sources go to the executors as a zip, once a session.
    """
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_murmura_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="murmura-code-")) / "murmura_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "murmura").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._murmura_shipped = True


def parts(batches: Iterator, rows: int = 512) -> Iterator:
    """Batches cut to ``rows``: what a worker unpacks at a time, whatever batch size the session has set."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
