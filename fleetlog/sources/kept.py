"""Tables in a shared folder that are changed in parts, by versions and a manifest."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on one machine only, the temporary folder where the session names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.gettempdir()
    return there.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below shared_root()."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder."""
    files, path = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def stamp(spark: SparkSession, *paths: str) -> str:
    """A hash of the names, sizes and times of the files in some folders, or of some files."""
    found = []
    for folder in paths:
        files, path = _file_system(spark, folder)
        found += sorted((folder, x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(path))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:16]


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


class KeptTable:
    """Rows below `folder`, in parts. A change writes the parts that it touches as a new version, then a manifest that
    names the version of every part.

    Only what the newest whole manifest names is read, so a change that broke off leaves no trace, and one with a number
    that is already there is not made again. Numbers rise. The manifest has a row for each part; rows are never on the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def number(self) -> int:
        """The number of the last change, or -1."""
        whole = [n for n in children(self.spark, f"{self.folder}/manifest") if exists(self.spark, f"{self.folder}/manifest/{n}/_SUCCESS")]
        return max((int(n.removeprefix("change=")) for n in whole), default=-1)

    def versions(self, number: int | None = None) -> dict[str, int]:
        """The version of each part after a change, by default the last."""
        number = self.number() if number is None else number
        if number < 0:
            return {}
        rows = self.spark.read.schema("part string, version long").parquet(f"{self.folder}/manifest/change={number}").collect()
        return {r.part: r.version for r in rows}

    def read(self, parts: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows of all parts or of some."""
        versions = self.versions(number)
        paths = [f"{self.folder}/version={v}/part={p}" for p, v in sorted(versions.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, number: int, fresh: DataFrame, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], order: tuple[str, ...] = (), also: list[str] = ()) -> list[str]:
        """Puts merge(old rows, fresh rows) in place of the parts, named by `part`, that `fresh` has rows of, and of those in `also`; a part may come back with no row. The parts that were replaced."""
        if number <= self.number():
            return []
        named = part.cast("string")
        level = fresh.storageLevel
        own = not (level.useMemory or level.useDisk)
        fresh = fresh.persist() if own else fresh
        try:
            touched = sorted({*also, *(r.part for r in fresh.select(named.alias("part")).distinct().collect())})
            merged = merge(self.read(touched), fresh).select([f.name for f in self.schema]).withColumn("part", named)
            version = f"{self.folder}/version={number}"
            # Large parts are split along their order.
            dealt = merged.repartitionByRange("part", *order) if order else merged.repartition("part")
            dealt.sortWithinPartitions("part", *order).write.partitionBy("part").mode("overwrite").parquet(version)
        finally:
            if own:
                fresh.unpersist()
        written = {n.removeprefix("part=") for n in children(self.spark, version) if n.startswith("part=")}
        kept = {p: v for p, v in self.versions().items() if p not in touched} | {p: number for p in touched if p in written}
        manifest = self.spark.createDataFrame(sorted(kept.items()), "part string, version long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/change={number}")
        return touched

    def forget(self, last: int = 3) -> None:
        """Deletes parts of versions that none of the last manifests names."""
        numbers = sorted(int(n.removeprefix("change=")) for n in children(self.spark, f"{self.folder}/manifest"))
        used = {(p, v) for n in numbers[-last:] for p, v in self.versions(n).items()}
        for n in numbers[:-last]:
            remove(self.spark, f"{self.folder}/manifest/change={n}")
        for version in children(self.spark, self.folder):
            if version.startswith("version="):
                for name in children(self.spark, f"{self.folder}/{version}"):
                    if name.startswith("part=") and (name.removeprefix("part="), int(version.removeprefix("version="))) not in used:
                        remove(self.spark, f"{self.folder}/{version}/{name}")


def hash_part(key: str, parts: int) -> Column:
    """The part of a row by its key."""
    return F.pmod(F.xxhash64(key), F.lit(parts))
