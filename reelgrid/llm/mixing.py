"""A mixture of sources with target shares of its tokens.

Whole epochs of a source come first; the rest of its budget is a weighted sample without replacement
by exponential keys scaled by a quality weight (Efraimidis-Spirakis): documents in order of
-ln(u) / weight until the budget is reached. The prefix sums are taken in two levels, over a fixed
number of key ranges per source and then inside the one range in which the budget ends, so no source
is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.session import cut_lineage

RANGES = 4096


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: the share of letters and blanks in the text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\s]+", ""))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.25))


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of its shares.

    ``sized``: doc_id, source, n_tokens, weight; ``targets``: source, target_share, max_repeats.
    The size of the mixture is ``total`` or else the largest in which every source that has
    documents can hold its share of it without passing its max_repeats; the shares of sources
    without documents are divided among the rest in proportion and reported as unmet.

    Out: (doc_id, source, n_tokens, copies) and (source, target_share, reachable_share, max_repeats, documents,
    available_tokens, budget_tokens, taken_documents, taken_tokens, actual_share); reachable_share is
    the target's part of the targets of all sources that have documents.

    Defined cases: documents with a null source, of a source without target, or without tokens are
    never taken; null or non-positive weights count as the smallest; a null or negative share is 0;
    null repeats are 1; repeated targets count once; ties of keys go by doc_id; empty tables give an
    empty mixture and a report of zeros.
    """
    goal = targets.groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")).where("source is not null")
    # Only sources of the targets stay, so all tables per source are as small as the targets.
    docs = cut_lineage(sized.join(goal.select("source"), "source", "left_semi").where("n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.greatest(F.coalesce("weight", F.lit(1e-6)), F.lit(1e-6)).alias("weight")))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    keyed = docs.withColumn("key", -F.log(u) / F.col("weight"))
    have = keyed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("available_tokens"), F.avg("key").alias("mean_key"))
    plan = goal.join(have, "source", "left").withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    alive = F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)
    every = W.partitionBy()  # one row per source of the targets
    plan = plan.withColumn("share", F.coalesce(F.try_divide(alive, F.sum(alive).over(every)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.try_divide(F.col("available_tokens") * F.greatest("max_repeats", F.lit(0)), F.col("share")))).over(every)
    plan = plan.withColumn("size", F.lit(float(total)) if total is not None else most)
    room = F.col("available_tokens") * F.greatest("max_repeats", F.lit(0))
    plan = plan.withColumn("budget_tokens", F.coalesce(F.least(F.floor(F.col("size") * F.col("share") + 1e-6), room), F.lit(0)).cast("bigint"))
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("budget_tokens", "available_tokens")), F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens"))
    plan = cut_lineage(plan)  # one row per source

    with_range = keyed.join(F.broadcast(plan.select("source", "epochs", "rest", "mean_key")), "source").withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key") / F.col("mean_key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    # At most RANGES rows a source, so their running sums and the broadcast are bounded.
    sums = with_range.groupBy("source", "range", "rest").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", F.sum("tokens").over(W.partitionBy("source").orderBy("range")) - F.col("tokens"))
    place = F.when(F.col("before") + F.col("tokens") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("edge")
    ranges = sums.select("source", "range", "before", place.alias("place"))
    placed = with_range.join(F.broadcast(ranges), ["source", "range"])
    edge = placed.where("place = 'edge'").withColumn("reached", F.col("before") + F.sum("n_tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    # The document in which the budget ends is taken if that comes nearer to it.
    edge = edge.withColumn("extra", (F.col("reached") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    inner = placed.where("place <> 'edge'").withColumn("extra", (F.col("place") == "in").cast("int"))
    pick = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies")]
    mixture = inner.select(*pick).unionByName(edge.select(*pick)).where("copies > 0")

    taken = mixture.groupBy("source").agg(F.count("*").alias("taken_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"))
    report = plan.select("source", "target_share", F.col("share").alias("reachable_share"), "max_repeats", "documents", "available_tokens", "budget_tokens").join(F.broadcast(taken), "source", "left").withColumn("taken_documents", F.coalesce("taken_documents", F.lit(0))).withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("taken_tokens"), F.sum("taken_tokens").over(every)), F.lit(0.0))
    return mixture, report.withColumn("actual_share", share)
