"""A keyed table kept as immutable parts behind numbered manifests, written under a lock, on any Hadoop file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.lineage import SharedFiles
from quillmesh.operators.joins import append_new, upsert


class StoreError(RuntimeError):
    """A store that cannot be read or written as asked."""


class KeyedStore:
    """A table of Parquet parts in a shared folder; readers see the parts of the last manifest.

    Executors write a part before the manifest that names it is created, so a
    failed write leaves the old table in place. An append adds one part and
    rewrites nothing; a merge writes the table anew. `vacuum` removes parts and
    manifests that the last one no longer needs.
    """

    def __init__(self, spark: SparkSession, folder: str, record: str, version: int = 1) -> None:
        self.spark, self.files = spark, SharedFiles(spark, folder)
        own = json.dumps({"record": record, "version": version})
        if not self.files.create("store.json", own) and json.loads(self.files.read("store.json")) != json.loads(own):
            raise StoreError(f"{folder} holds {self.files.read('store.json')}, not {own}")

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Exclusive writer; a lock left behind by a dead writer must be removed by hand."""
        if not self.files.create("lock", ""):
            raise StoreError(f"{self.files.folder}/lock exists: another writer is at work")
        try:
            yield
        finally:
            self.files.drop("lock")

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("manifest-")]

    def parts(self) -> list[str]:
        last = self._manifests()
        return json.loads(self.files.read(last[-1])) if last else []

    def read(self) -> DataFrame | None:
        parts = self.parts()
        return self.spark.read.parquet(*(f"{self.files.folder}/{p}" for p in parts)) if parts else None

    def check(self, keys: list[str]) -> None:
        """Raise for rows without a key or with a key that another row has."""
        held = self.read()
        if held is None:
            return
        missing = None
        for k in keys:
            missing = F.col(k).isNull() if missing is None else missing | F.col(k).isNull()
        if held.filter(missing).limit(1).count():
            raise StoreError(f"{self.files.folder} holds rows without {keys}")
        if held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            raise StoreError(f"{self.files.folder} holds a key twice")

    def _write(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.files.folder}/{part}")
        return part

    def _publish(self, parts: list[str]) -> None:
        last = self._manifests()
        number = int(last[-1].split("-")[1]) + 1 if last else 1
        if not self.files.create(f"manifest-{number:012d}", json.dumps(parts)):
            raise StoreError(f"another writer published manifest {number}")

    def append(self, batch: DataFrame, key: Column, order: list[str]) -> int:
        """Add the rows whose key is new, as one more part; the number added."""
        with self.lock():
            old = self.read()
            fresh = append_new(old if old is not None else batch.limit(0), batch, key, order).select(*batch.columns)
            part = self._write(fresh)
            count = self.spark.read.parquet(f"{self.files.folder}/{part}").count()
            if count or old is None:
                self._publish([*self.parts(), part])
            else:
                self.files.drop(part)
            return count

    def merge(self, batch: DataFrame, keys: list[str], volatile: tuple[str, ...] = ()) -> dict[str, int]:
        """Upsert by key; how many rows were inserted, updated, skipped and kept. Conflicts within the batch raise."""
        with self.lock():
            old = self.read()
            if old is not None and old.columns and set(old.columns) != set(batch.columns):
                raise StoreError("batch has other columns than the store")
            side = self._write(upsert(old if old is not None else batch.limit(0), batch, keys, volatile))
            done = self.spark.read.parquet(f"{self.files.folder}/{side}")
            counts = {r["change"]: r["n"] for r in done.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
            self._publish([self._write(done.drop("change"))])
            self.files.drop(side)
            return counts

    def vacuum(self) -> int:
        """Remove parts and manifests the last manifest does not need, for when no reader holds an older one; how many parts."""
        with self.lock():
            kept, last = set(self.parts()), self._manifests()
            gone = [n for n in self.files.names() if n.startswith("part-") and n not in kept]
            for name in (*gone, *last[:-1]):
                self.files.drop(name)
            return len(gone)


def flat_csv(df: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """CSV with lists joined by ``|`` and struct columns flattened to sorted ``prefix.field`` columns."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType
        name = F.col(f"`{field.name}`")
        if kind.typeName() == "array":
            out.append(F.array_join(name.cast("array<string>"), "|").alias(field.name))
        elif kind.typeName() == "struct":
            head = (prefixes or {}).get(field.name, field.name)
            out += [name[f].alias(f"{head}.{f}") for f in sorted(kind.names)]
        elif kind.typeName() == "map":
            out.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(name)))).alias(field.name))
        else:
            out.append(name)
    df.select(*out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
