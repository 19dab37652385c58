"""One ranking from several scores of different scales.

A walk over the items: from an item pick one of the scores, then jump uniformly to the items that
this score ranks higher, or stay. Only orders matter, so no score's range does. The stationary
distribution is found by power iteration with damping; one step costs a prefix sum over each score's
sorted order, not a sum over pairs of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.session import cut_lineage, written

#: Low, so that the walk restarts often and the head of one score alone does not hold it.
DAMPING = 0.4
ROUNDS = 60
TOLERANCE = 1e-10
#: A larger group is walked over the cluster instead of in one task.
GROUP_ROWS = 100_000
#: Rounds of such a walk: each brings what is left down by the damping, so after them it is under the same tolerance.
SPREAD_ROUNDS = int(np.ceil(np.log(TOLERANCE) / np.log(DAMPING)))
#: Ranges into which a large group's values are cut for their prefix sums.
RANGES = 512


def percentiles(values: np.ndarray) -> np.ndarray:
    """Of each value its place among the present ones of its column, 0 to 1, ties in the middle; NaN stays."""
    out = np.full(values.shape, np.nan)
    for j in range(values.shape[1]):
        ok = ~np.isnan(values[:, j])
        v = values[ok, j]
        if len(v):
            s = np.sort(v)
            out[ok, j] = (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right")) / 2 / len(v)
    return out


def stationary(values: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The walk's distribution over the rows of a (items, scores) matrix with NaN for missing scores.

    A missing score takes the place that the item's other scores give it on average, so it speaks
    neither for nor against the item; an item without any score stands in the middle.
    """
    n, m = values.shape
    if n == 0 or m == 0:
        return np.full(n, 1 / max(n, 1))
    place = percentiles(values)
    present = ~np.isnan(place)
    counts = present.sum(1)
    own = np.where(counts > 0, np.where(present, place, 0).sum(1) / np.maximum(counts, 1), 0.5)
    place = np.where(present, place, own[:, None])
    orders, ranks, jumps = [], [], []
    for j in range(m):
        s = np.sort(place[:, j])
        orders.append(np.argsort(place[:, j], kind="stable"))
        ranks.append(np.searchsorted(s, place[:, j], "left"))  # how many stand strictly lower
        jumps.append(1.0 / (n - np.searchsorted(s, place[:, j], "right") + 1))  # to a higher one, or stay
    p = np.full(n, 1 / n)
    for _ in range(rounds):
        new = np.zeros(n)
        for order, rank, jump in zip(orders, ranks, jumps):
            out = p * jump
            below = np.concatenate([[0.0], np.cumsum(out[order])])
            new += below[rank] + out
        new = (1 - damping) / n + damping * new / m
        new /= new.sum()
        if np.abs(new - p).sum() < tolerance:
            return new
        p = new
    return p


def _below(rows: DataFrame, keys: list[str], value: str, amount: Column) -> DataFrame:
    """(keys, value, below, here): the sum of ``amount`` over strictly smaller values, and over this one.

    Equal values are combined first; the different ones are cut into ranges at approximate quantiles,
    whose sums are few, and only inside a range are they summed in order. Any cut gives exact sums.
    """
    at = rows.groupBy(*keys, value).agg(F.sum(amount).alias("here"))
    cuts = at.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 2_000).alias("cuts"))
    at = at.join(cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sums = at.groupBy(*keys, "range").agg(F.sum("here").alias("all"))
    sums = sums.withColumn("before", F.sum("all").over(W.partitionBy(*keys).orderBy("range")) - F.col("all")).drop("all")
    inside = F.sum("here").over(W.partitionBy(*keys, "range").orderBy(value)) - F.col("here")
    return at.withColumn("inside", inside).join(sums, [*keys, "range"]).select(*keys, value, (F.col("before") + F.col("inside")).alias("below"), "here")


def _walk_spread(rows: DataFrame, damping: float, rounds: int = SPREAD_ROUNDS) -> DataFrame:
    """(g, i, mass) of groups of any size: the same walk with its prefix sums over the cluster."""
    size = rows.groupBy("g").agg(F.max(F.size("s")).alias("m"), F.count("*").alias("n"))
    full = rows.join(size, "g").select("g", "i", "n", "m", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.try_element_at("s", j + 1))).alias("j", "v")).where("m > 0")
    full, drop_values = written(full.withColumn("v", F.when(~F.isnan("v"), F.col("v"))))
    present = full.where("v is not null")
    ranks = _below(present, ["g", "j"], "v", F.lit(1))
    counts = present.groupBy("g", "j").agg(F.count("*").alias("c"))
    place = present.join(ranks, ["g", "j", "v"]).join(counts, ["g", "j"]).select("g", "i", "j", ((F.col("below") + F.col("below") + F.col("here")) / 2 / F.col("c")).alias("place"))
    own = place.groupBy("g", "i").agg(F.avg("place").alias("own"))
    full = full.join(place, ["g", "i", "j"], "left").join(own, ["g", "i"], "left").select("g", "i", "j", "n", "m", F.coalesce("place", "own", F.lit(0.5)).alias("place"))
    ranks = _below(full, ["g", "j"], "place", F.lit(1))
    full, drop_places = written(full.join(ranks, ["g", "j", "place"]).withColumn("jump", 1 / (F.col("n") - F.col("below") - F.col("here") + 1)).drop("below", "here"))
    drop_values()
    mass, drop = written(full.select("g", "i", (1 / F.col("n")).alias("mass")).distinct())
    for _ in range(rounds):
        out = full.join(mass, ["g", "i"]).withColumn("out", F.col("mass") * F.col("jump"))
        sums = _below(out, ["g", "j"], "place", F.col("out"))
        new = out.join(sums, ["g", "j", "place"]).groupBy("g", "i").agg(F.first("n").alias("n"), (F.sum(F.col("below") + F.col("out")) / F.first("m")).alias("in"))
        new, drop_new = written(new.select("g", "i", ((1 - damping) / F.col("n") + damping * F.col("in")).alias("mass")))
        drop()
        mass, drop = new, drop_new
    drop_places()
    alone = rows.join(size.where("m <= 0"), "g").select("g", "i", (1 / F.col("n")).alias("mass"))
    return mass.unionByName(alone)


def rank_walk(df: DataFrame, group: str, item: str, scores: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, item, mass, place): the items of each group in one order, 1 the best.

    Groups of up to ``group_rows`` items are walked in one task each; larger ones over the cluster,
    with the same result but for the last digits of the mass.

    ``scores`` is an ARRAY<DOUBLE> column; a null or NaN entry, a null array and the end of a shorter
    array are missing scores. Equal masses go by the item.

    Defined cases: null groups or items are left out; a repeated (group, item) counts once, with the
    largest array; a group of one item ranks it first; an empty table gives no rows; other columns
    are not read.
    """
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{scores}`").cast("array<double>").alias("s")).where("g is not null and i is not null").groupBy("g", "i").agg(F.max("s").alias("s"))
    g, i = df.schema[group].dataType.simpleString(), df.schema[item].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        lists = t.column("s").to_pylist()
        width = max((len(s) for s in lists if s), default=0)
        values = np.full((len(lists), width), np.nan)
        for r, s in enumerate(lists):
            if s:
                values[r, : len(s)] = [np.nan if v is None else v for v in s]
        mass = stationary(values)
        order = np.lexsort((np.arange(len(mass)), -np.round(mass, 14)))
        place = np.empty(len(mass), np.int32)
        place[order] = np.arange(1, len(mass) + 1)
        return pa.table({"g": t.column("g"), "i": t.column("i"), "mass": mass, "place": place})

    rows = rows.withColumn("s", F.coalesce("s", F.array().cast("array<double>")))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("g")
    large = cut_lineage(sizes)
    schema = f"g {g}, i {i}, mass double, place int"
    if large.isEmpty():
        made = rows.groupBy("g").applyInArrow(run, schema)
    else:
        made = rows.join(large, "g", "left_anti").groupBy("g").applyInArrow(run, schema)
        spread = _walk_spread(cut_lineage(rows.join(large, "g", "left_semi")), DAMPING)
        # Places by the same two-level sums: how many have more mass, then the item among equals.
        key = F.round(-F.col("mass"), 14)
        spread = spread.withColumn("k", key)
        before = _below(spread, ["g"], "k", F.lit(1))
        among = F.row_number().over(W.partitionBy("g", "k").orderBy("i"))
        placed = spread.join(before, ["g", "k"]).withColumn("place", (F.col("below") + among).cast("int"))
        made = made.unionByName(placed.select("g", "i", "mass", "place"))
    return made.withColumnRenamed("g", group).withColumnRenamed("i", item)
