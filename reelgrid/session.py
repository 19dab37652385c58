"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder all executors share and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Rows then survive lost executors and are
    computed once.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], object]]:
    """``df`` as a table in the same shared folder, and what deletes it; for loops.

    A checkpoint keeps the size estimate of the plan it cuts. Round after round of joins that estimate
    multiplies until it no longer fits in memory; a table that is read again starts from its files.
    """
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(df.schema).parquet(path.toString()), lambda: files.delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder for the rest of the session, for what is read several times.

    Unlike a checkpoint it has the size of its files, so Spark broadcasts it in joins where it is small.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the session."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())

    def clean() -> None:
        if sc._jsc is not None:
            files.delete(path, True)

    atexit.register(clean)
    return path.toString()


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # A folder of one machine is lost with it, so it will only do where there is no other machine.
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="reelgrid-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def once_per_key(df: DataFrame, keys: list[str], arrival: str | None = "ingested_at") -> DataFrame:
    """One row per key: the earliest arrival, of equally early ones the smallest row.

    An aggregation, not a window, so copies are combined before the shuffle and a key that holds a
    third of all rows reaches its reducer as one row per map task. Null keys form one key.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    orderable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    order = ([arrival] if arrival in rest else []) + [c for c in orderable if c != arrival]
    best = F.min_by(F.struct(*[_name(c) for c in rest]), F.struct(*[_name(c) for c in order]))
    picked = df.groupBy(*[_name(k) for k in keys]).agg(best.alias("__row"))
    return picked.select(*[_name(k) for k in keys], *[F.col("__row").getField(c).alias(c) for c in rest]).select(*[_name(c) for c in df.columns])


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def parallelism(spark: SparkSession) -> int:
    """Partitions for operators that fix their own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
