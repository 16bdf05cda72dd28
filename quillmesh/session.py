"""Session defaults and small table helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; settings given by the cluster stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns are pruned by what is selected later."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not find it on their path.

    The driver serves a zip of the package's sources to the executors, once per
    application; the file on the driver is removed when Python ends.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="quillmesh-")
    _kept.append(folder)
    path = Path(folder.name) / "quillmesh_sources.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


_kept: list[tempfile.TemporaryDirectory] = []
