"""Writing manifests, versions of collections, submissions and questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.etl import keyed_upsert
from reelgrid.sources.schemas import ENTITIES


def append_manifest(df: DataFrame, path: str, entity: str) -> None:
    """Appends rows with the entity's schema; refused when the files there have other columns."""
    spark = df.sparkSession
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTITIES[entity].fields])
    try:
        there = spark.read.parquet(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = rows.columns
    if there != rows.columns:
        raise ValueError(f"{path} has the columns {there}, not {rows.columns}")
    rows.write.mode("append").parquet(path)


class Collection:
    """A collection is a folder of versions, each written once: readers never see half of one.

    ``current`` is the latest complete version. A change of model or schema is a new collection.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        done = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return sorted(d for d in done if d.startswith("v"))

    def exists(self) -> bool:
        return bool(self.versions())

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[-1]}")

    def create(self, rows: DataFrame) -> str:
        if self.exists():
            raise ValueError(f"{self.path} exists")
        return self._write(rows, 1)

    def upsert(self, rows: DataFrame, keys: list[str]) -> str:
        """A new version with the rows of these keys put in place of the old ones; doing it twice changes nothing."""
        v = self.versions()
        return self._write(keyed_upsert(self.current(), rows, keys) if v else rows, int(v[-1][1:7]) + 1 if v else 1)

    def compact(self, files: int) -> str:
        v = self.versions()[-1]
        return self._write(self.current().repartition(files), int(v[1:7]) + 1)

    def delete(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def status(self) -> dict[str, object]:
        v = self.versions()
        return {"exists": bool(v), "version": v[-1] if v else None, "rows": self.current().count() if v else 0}

    def checksums(self) -> DataFrame:
        """(name, length, sha256) of the files of the current version."""
        return _checksums(self.spark, f"{self.path}/{self.versions()[-1]}")

    def snapshot(self, path: str, version: str) -> None:
        """A copy of the current version at ``path`` with a manifest of its files' checksums and the engine's version."""
        self.current().write.mode("errorifexists").parquet(f"{path}/rows")
        sums = _checksums(self.spark, f"{path}/rows")
        sums.withColumn("version", F.lit(version)).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")

    def restore(self, path: str, version: str) -> str:
        """A new version from a snapshot; refused when the versions don't go together or a file isn't what it was."""
        told = self.spark.read.json(f"{path}/manifest")
        if not compatible(told.first()["version"], version):
            raise ValueError(f"a snapshot of {told.first()['version']} can't be restored into {version}")
        same = told.select("name", "sha256").join(_checksums(self.spark, f"{path}/rows"), ["name", "sha256"], "full_outer").where("length is null").limit(1).count() == 0
        there = _checksums(self.spark, f"{path}/rows").count() == told.count()
        if not (same and there):
            raise ValueError(f"{path} was changed since the snapshot")
        v = self.versions()
        return self._write(self.spark.read.parquet(f"{path}/rows"), int(v[-1][1:7]) + 1 if v else 1)

    def _write(self, rows: DataFrame, number: int) -> str:
        name = f"v{number:06d}-{uuid.uuid4().hex[:6]}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return name


def _checksums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def compatible(source: str, target: str) -> bool:
    """Whether a snapshot of one version can be restored into another: same minor version, target patch not older."""
    a, b = ([int(x) for x in v.lstrip("v").split(".")[:3]] for v in (source, target))
    return a[:2] == b[:2] and b[2] >= a[2]


def write_submission(lines: DataFrame, path: str) -> None:
    """At most 100 lines in order, one file, no header."""
    lines.orderBy("position").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)
