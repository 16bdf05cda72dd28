"""Results kept by the fingerprint of what they were computed from."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(request: object) -> str:
    """Hash of a request, the same for any order of its keys."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, request: object, compute: Callable[[], DataFrame], ttl_seconds: float | None = None, refresh: bool = False) -> DataFrame:
    """The stored result of ``request``, else the computed one, stored for the next time.

    A result without rows is a hit as well. Only a completed write counts; one
    older than ``ttl_seconds`` is computed again.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{fingerprint(request)}")
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(done) and not refresh:
        age = time.time() - files.getFileStatus(done).getModificationTime() / 1000
        if ttl_seconds is None or age <= ttl_seconds:
            return spark.read.parquet(str(path))
    compute().write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
