"""Continuous periods and gaps from overlapping, nested and gapped intervals.

The rows are sorted globally by (entity, start) over range partitions, so an entity that holds a
third of all rows spreads over many of them. Each partition is summarised by the furthest end of
its last entity; these few summaries are combined in order, and a second pass over the same sorted
partitions starts from the carried state. Nothing is ever grouped by entity in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.session import cut_lineage, parallelism


def periods_and_gaps(df: DataFrame, entity: list[str], start: Column, end: Column, partitions: int | None = None) -> DataFrame:
    """Merge half-open integer intervals of each entity into periods and list the gaps between them.

    ``start`` and ``end`` are BIGINT expressions. Intervals that overlap or touch (next start = end)
    run on. Columns out: the entity's, ``span_kind`` ('period' or 'gap'), ``span_start``, ``span_end``.

    Defined cases: a null bound or an end before the start leaves the row out; an empty interval
    (start = end) is a period of no length unless another covers or touches it; repeated rows change
    nothing; a null entity value is an entity of its own; an empty table gives no rows; other columns
    of the input, whatever their names, are not read.
    """
    names = [f"__e{i}" for i in range(len(entity))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(entity, names)], start.cast("bigint").alias("__s"), end.cast("bigint").alias("__t")).where("__s is not null and __t is not null and __t >= __s")
    n = partitions or parallelism(df.sparkSession)
    # The running number splits a key that very many rows share into several range partitions.
    ordered = rows.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(n, *names, "__s", "__n").drop("__n").sortWithinPartitions(*names, "__s")
    ordered = cut_lineage(ordered)
    ends = T.StructType([T.StructField("__p", T.IntegerType()), *[T.StructField(f"__{w}{i}", ordered.schema[c].dataType) for w in ("first", "last") for i, c in enumerate(names)], T.StructField("__max", T.LongType()), T.StructField("__island", T.LongType())])
    # One row per partition, so what comes to the driver is bounded by their number.
    summaries = sorted(ordered.mapInArrow(_summarise(len(names)), ends).collect(), key=lambda r: r["__p"])
    carried = _combine([tuple(r) for r in summaries], len(names))
    spans = T.StructType([T.StructField("span_kind", T.StringType()), *[ordered.schema[c] for c in names], T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType())])
    found = ordered.mapInArrow(_rescan(carried, len(names)), spans)
    merged = found.groupBy("span_kind", *names, "span_start").agg(F.max("span_end").alias("span_end"))
    return merged.select(*[F.col(n).alias(c) for n, c in zip(names, entity)], "span_kind", "span_start", "span_end")


State = tuple[tuple, int, int]  # entity, furthest end, start of the period that is open


def _combine(summaries: list[tuple], width: int) -> dict[int, State]:
    """The state in which each partition begins."""
    carried: dict[int, State] = {}
    state: State | None = None
    for p, *rest in summaries:
        first, last = tuple(rest[:width]), tuple(rest[width : 2 * width])
        furthest, island = rest[2 * width :]
        if state is not None:
            carried[p] = state
        if state is not None and first == last == state[0]:
            island = state[2] if island <= state[1] else island
            furthest = max(furthest, state[1])
        state = (last, furthest, island)
    return carried


def _scan(batch: pa.RecordBatch, width: int, state: State | None) -> tuple[np.ndarray, ...]:
    """Of each row: whether its entity is the row before's, and the furthest end and open period before it."""
    s = batch.column(width).to_numpy()
    t = batch.column(width + 1).to_numpy()
    n = len(s)
    same = np.ones(n, bool)
    for i in range(width):
        c = batch.column(i)
        now, before = c.slice(1), c.slice(0, n - 1)
        eq = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
        same[1:] &= eq.to_numpy(zero_copy_only=False)
    same[0] = state is not None and tuple(batch.column(i)[0].as_py() for i in range(width)) == state[0]
    ahead = t.copy()
    if same[0]:
        ahead[0] = max(ahead[0], state[1])
    group = np.cumsum(~same)
    # A running maximum that starts anew with each entity: ranks of the ends, lifted by the group.
    order = np.argsort(ahead, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    furthest = ahead[order][np.maximum.accumulate(rank + group * n) - group * n]
    before = np.empty(n, np.int64)
    before[1:] = furthest[:-1]
    before[0] = state[1] if same[0] else 0
    opens = ~same | (s > before)
    at = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
    island = np.where(at >= 0, s[at], state[2] if state else 0)
    return s, same, furthest, before, opens, island


def _after(batch: pa.RecordBatch, width: int, furthest: np.ndarray, island: np.ndarray) -> State:
    k = batch.num_rows - 1
    return tuple(batch.column(i)[k].as_py() for i in range(width)), int(furthest[k]), int(island[k])


def _summarise(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if first is None:
                first, types = tuple(b.column(i)[0].as_py() for i in range(width)), [b.schema.field(i).type for i in range(width)]
            _, _, furthest, _, _, island = _scan(b, width, state)
            state = _after(b, width, furthest, island)
        if state is not None:
            values = [TaskContext.get().partitionId(), *first, *state[0], state[1], state[2]]
            kinds = [pa.int32(), *types, *types, pa.int64(), pa.int64()]
            names = ["__p", *[f"__{w}{i}" for w in ("first", "last") for i in range(width)], "__max", "__island"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return run


def _rescan(carried: dict[int, State], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = carried.get(TaskContext.get().partitionId())
        for b in batches:
            if not b.num_rows:
                continue
            s, same, furthest, before, opens, island = _scan(b, width, state)
            state = _after(b, width, furthest, island)
            closes = np.append(opens[1:], True)  # the last row of a period within this batch
            k, g = np.flatnonzero(closes), np.flatnonzero(opens & same)
            take = pa.array(np.concatenate([k, g]))
            kind = pa.array(["period"] * len(k) + ["gap"] * len(g), pa.string())
            columns = [kind, *[b.column(i).take(take) for i in range(width)], pa.array(np.concatenate([island[k], before[g]])), pa.array(np.concatenate([furthest[k], s[g]]))]
            yield pa.RecordBatch.from_arrays(columns, ["span_kind", *[f"__e{i}" for i in range(width)], "span_start", "span_end"])

    return run
