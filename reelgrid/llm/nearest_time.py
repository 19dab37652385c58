"""Pairing records of two tables by the nearest time of the same entity.

Rows are hash-partitioned by (entity, time bucket), so that a day-long entity spreads over many
tasks, and a bucket that holds very many rows is spread over several. A base row near the edge of a
bucket is also sent to the next one, which makes each bucket complete within the tolerance. Inside
every Arrow partition DuckDB runs a backward and a forward ASOF join over all its buckets at once,
and the nearer candidate within the tolerance is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.session import parallelism

#: Ties: of equally near base rows the earlier time, then the smaller id, which is what min(id) per time gives.
_NEAREST = """
with probe as (select distinct __e, __k, __t, __id from rows where __side = 0),
base as (select __e, __k, __t, min(__id) as __id from rows where __side = 1 group by all),
back as (select p.*, b.__t as bt, b.__id as bid from probe p asof left join base b on p.__e = b.__e and p.__k = b.__k and p.__t >= b.__t),
both_ways as (select p.*, f.__t as ft, f.__id as fid from back p asof left join base f on p.__e = f.__e and p.__k = f.__k and p.__t <= f.__t),
picked as (select __e, __id, case when bt is not null and (ft is null or __t - bt <= ft - __t) then bt else ft end as __m,
  case when bt is not null and (ft is null or __t - bt <= ft - __t) then bid else fid end as __mid, __t from both_ways)
select distinct __e, __id as __probe, __mid as __base, abs(__t - __m) as __off from picked where abs(__t - __m) <= {tolerance}
"""


#: Rows that one task should hold. Partitions are as many as that asks for, and so are the shares of a crowded bucket.
TASK_ROWS = 200_000


def nearest_in_time(probe: DataFrame, base: DataFrame, entity: str, probe_time: str, base_time: str, probe_id: str, base_id: str, tolerance: int, bucket: int = 60_000, task_rows: int = TASK_ROWS) -> DataFrame:
    """For each probe row the base row of the same entity whose integer time is nearest, if within ``tolerance``.

    Times and ids are BIGINT columns. Out: entity, ``probe_id``, ``base_id``, ``offset``; one row per
    matched (entity, probe_id, probe time), and no row for probes without a match.

    ``bucket`` is the width of a time bucket. Base rows with one (entity, time) become one before they
    are sent to the buckets, so a bucket has at most ``bucket`` of them. A bucket with more than
    ``task_rows`` probes is spread over as many shares as that takes, to each of which its base rows
    go; partitions are as many as the rows of both tables ask for. So a task's rows stay about
    ``task_rows`` however large the tables or a single entity are.

    Defined cases: null entities, times or ids match nothing; of equally near base rows the earlier,
    then the smaller id, is taken; repeated rows count once; either table may be empty; other columns,
    also of equal names, are not read.
    """
    width = F.lit(bucket)
    rows = probe.count() + base.count()  # from the files' footers where nothing is filtered
    named = lambda df, t, i: df.select(F.col(entity).alias("__e"), F.col(t).cast("bigint").alias("__t"), F.col(i).cast("bigint").alias("__id")).where("__e is not null and __t is not null and __id is not null")
    p = named(probe, probe_time, probe_id).withColumn("__k", F.floor(F.col("__t") / width))
    b = named(base, base_time, base_id).groupBy("__e", "__t").agg(F.min("__id").alias("__id"))
    near = F.sequence(F.floor((F.col("__t") - tolerance) / width), F.floor((F.col("__t") + tolerance) / width))
    b = b.withColumn("__k", F.explode(near))
    if rows > task_rows:
        # Only crowded buckets are in this table, at most rows / task_rows.
        crowded = p.groupBy("__e", "__k").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select("__e", "__k", F.ceil(F.col("n") / task_rows).cast("int").alias("__shares"))
        p, b = (x.join(crowded, ["__e", "__k"], "left").withColumn("__shares", F.coalesce("__shares", F.lit(1))) for x in (p, b))
        p = p.withColumn("__share", F.pmod(F.xxhash64("__id"), F.col("__shares")).cast("int"))
        b = b.withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    else:
        p, b = (x.withColumn("__share", F.lit(0)) for x in (p, b))
    side = lambda df, s: df.select("__e", "__k", "__share", "__t", "__id", F.lit(s).alias("__side"))
    both = side(p, 0).unionByName(side(b, 1)).repartition(max(parallelism(probe.sparkSession), -(-rows // task_rows)), "__e", "__k", "__share")
    kind = probe.schema[entity].dataType.simpleString()
    matched = both.mapInArrow(_matcher(_NEAREST.format(tolerance=int(tolerance))), f"__e {kind}, __probe bigint, __base bigint, __off bigint")
    return matched.select(F.col("__e").alias(entity), F.col("__probe").alias("probe_id"), F.col("__base").alias("base_id"), F.col("__off").alias("offset"))


def _matcher(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # one partition, about TASK_ROWS rows
        if not sum(b.num_rows for b in got):
            return
        import duckdb

        # Without a folder of its own it can't spill to a local disk; a task's rows are few.
        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as c:
            c.register("rows", pa.Table.from_batches(got))
            t = c.sql(sql).to_arrow_table()
        t = t.cast(pa.schema([("__e", t.schema.field("__e").type), ("__probe", pa.int64()), ("__base", pa.int64()), ("__off", pa.int64())]))
        yield from t.to_batches(max_chunksize=10_000)

    return run
