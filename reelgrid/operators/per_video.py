"""Exact event search by video: every video is judged by all of its points.

First each video gets one score for a query, from its best point for every event and its best whole
shot for the overview; the best videos of a query go on. Then the events are searched inside those
videos alone, where no video competes with another for places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.scalar import GAP_SCALE_SEC
from reelgrid.operators.search import DECIMALS
from reelgrid.operators.sequence import GAP_WEIGHT, PER_VIDEO, best_sequences, candidate_videos, top_per_video

SLOTS = "query_id bigint, event int, video_id string, frame_id bigint, pts_sec double, shot_id int, id bigint, score double"
MAXIMA = "query_id bigint, event int, video_id string, score double"
SCORED = "query_id bigint, video_id string, score double, overview_score double, event_scores array<double>"
CHAINS = "query_id bigint, video_id string, score double, frames array<bigint>, shots array<int>, times array<double>, scores array<double>"
#: Rows of a video beyond this are searched in pieces.
BLOCK_ROWS = 5_000
#: Numbers of a score matrix at once.
CELLS = 2_000_000
#: Videos up to so many rows keep the costs of all their pairs.
TABLE_ROWS = 512
#: The event number of a query's overview, which is compared with whole shots.
OVERVIEW = -1


def videos_by_score(queries: DataFrame, base: DataFrame, limit: int, n_events: int, shots: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, video_id, score, overview_score, event_scores, rank): the ``limit`` best videos of each query.

    score = overview + mean of the events' scores; an event's score is that of the video's best point,
    the overview's that of its best shot, 0 where there is none. Equal scores (to 9 decimals): the
    smaller video_id. ``queries``: query_id, event (0-based, or OVERVIEW), point_id, v; ``base``:
    point_id, video_id, v, each point once; ``shots``: video_id, v. A query's own point is no hit.

    All rows of a video are in one block, so its score is finished there and a block sends only its
    ``limit`` best videos of a query. Only videos of more than ``block_rows`` points are scored in
    pieces, whose maxima are merged over the cluster.
    """
    rows = base.select("point_id", "video_id", "v", F.lit(False).alias("whole"))
    if shots is not None:
        rows = rows.unionByName(shots.select(F.lit(None).cast("bigint").alias("point_id"), "video_id", F.col("v").cast("array<float>").alias("v"), F.lit(True).alias("whole")))
    cut = _pieces(rows, block_rows)
    short = _in_blocks(queries, cut.where("pieces = 1"), _composites(limit, n_events), SCORED, block_rows)
    long = _in_blocks(queries, cut.where("pieces > 1"), _maxima, MAXIMA, block_rows).groupBy("query_id", "event", "video_id").agg(F.max("score").alias("score"))
    n = queries.select("query_id").distinct().withColumn("n", F.lit(n_events))
    merged = candidate_videos(long.where(F.col("event") == OVERVIEW).drop("event"), long.where(F.col("event") >= 0), n, limit)
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "video_id")
    return short.unionByName(merged.select(short.columns)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def slots_of_videos(videos: DataFrame, queries: DataFrame, base: DataFrame, n: int = PER_VIDEO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The n best points of every event inside every chosen video, out of all points of the video, with their place.

    ``videos``: query_id, video_id; ``queries``: query_id, event, point_id, v; ``base``: point_id,
    video_id, frame_id, pts_sec, shot_id, id, v, each point once, frame and video known. A query's own
    point is no hit. Order: score, frame, id.
    """
    return top_per_video(_in_pairs(videos, queries, _pieces(base, block_rows), _slots(n), SLOTS, block_rows), n)


def sequences_of_videos(videos: DataFrame, queries: DataFrame, base: DataFrame, n_events: int, n: int = PER_VIDEO, max_gap: float = 300.0, gap_weight: float = GAP_WEIGHT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, video_id, score, picks): ``best_sequences`` of ``slots_of_videos``.

    A video that fits a block is finished there, so its slots never leave it; only the slots of longer
    videos are merged over the cluster.
    """
    cut = _pieces(base, block_rows)
    short = _in_pairs(videos, queries, cut.where("pieces = 1"), _chains(n, n_events, max_gap, gap_weight), CHAINS, block_rows)
    picks = F.transform(F.arrays_zip("frames", "shots", "times", "scores"), lambda z: F.struct(z["frames"].alias("frame_id"), z["shots"].alias("shot_id"), z["times"].alias("pts_sec"), z["scores"].alias("score")))
    long = top_per_video(_in_pairs(videos, queries, cut.where("pieces > 1"), _slots(n), SLOTS, block_rows), n)
    return short.select("query_id", "video_id", "score", picks.alias("picks")).unionByName(best_sequences(long, n_events, max_gap, gap_weight))


def _pieces(base: DataFrame, block_rows: int) -> DataFrame:
    long = base.groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    # At most rows / block_rows videos are long; Spark decides by their size how to join them.
    return base.join(long, "video_id", "left").withColumn("pieces", F.coalesce(F.ceil(F.col("n") / block_rows), F.lit(1))).drop("n")


def _blocks(base: DataFrame, block_rows: int) -> int:
    n = base.count()
    return max(1, -(-n // block_rows), min(8, -(-n // 500)))


def _placed(base: DataFrame, blocks: int) -> DataFrame:
    piece = F.pmod(F.xxhash64("point_id"), F.col("pieces"))
    return base.withColumn("b", F.pmod(F.xxhash64("video_id", piece), F.lit(blocks)).cast("int")).withColumn("piece", piece).drop("pieces")


def _in_blocks(queries: DataFrame, base: DataFrame, run, schema: str, block_rows: int, query_block: int = 32_768) -> DataFrame:
    """``run`` over pairs of blocks; the rows of a video or piece are in one block each, the events of a query in one."""
    bb, qb = _blocks(base, block_rows), max(1, -(-queries.count() // query_block))
    left = queries.select(F.col("point_id").alias("asked"), F.col("v").cast("array<float>").alias("v"), "query_id", "event", F.explode(F.sequence(F.lit(0), F.lit(bb - 1))).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("q"))
    right = _placed(base, bb).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    rows = left.unionByName(right, allowMissingColumns=True).repartition(min(bb * qb, 4_000), "b", "q")
    return rows.groupBy("b", "q").applyInArrow(lambda t: _block(t, run, schema), schema)


def _in_pairs(videos: DataFrame, queries: DataFrame, base: DataFrame, run, schema: str, block_rows: int) -> DataFrame:
    """``run`` video by video, each with the events of the queries that chose it."""
    bb = _blocks(base, block_rows)
    places = base.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")).distinct()
    asked = videos.select("query_id", "video_id").join(queries.select("query_id", "event", F.col("point_id").alias("asked"), F.col("v").cast("array<float>").alias("v")), "query_id").join(places, "video_id")
    left = asked.withColumn("b", F.pmod(F.xxhash64("video_id", F.col("piece")), F.lit(bb)).cast("int"))
    rows = left.unionByName(_placed(base, bb), allowMissingColumns=True).repartition(min(bb, 4_000), "b")
    return rows.groupBy("b").applyInArrow(lambda t: _pair_block(t, run, schema), schema)


def _result(parts: list[pa.Table], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return pa.concat_tables([s.select(target.names).cast(target) for s in parts]) if parts else target.empty_table()


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    is_query = t.column("query_id").is_valid()
    q = t.filter(is_query).sort_by([("query_id", "ascending"), ("event", "ascending")]).combine_chunks()
    order = [(c, "ascending") for c in ("video_id", "frame_id", "id") if c in t.column_names]
    return q, t.filter(pc.invert(is_query)).sort_by(order).combine_chunks()


def _starts(p: pa.Table) -> np.ndarray:
    video = p.column("video_id").combine_chunks().dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], video[1:] != video[:-1]]))


def _block(t: pa.Table, run, schema: str) -> pa.Table:
    q, p = _sides(t)
    if not (q.num_rows and p.num_rows):
        return _result([], schema)
    keys = (q.column("query_id").to_numpy(), q.column("event").to_numpy())
    return _result(run(keys, (_unit(q), _own(q.column("asked"))), p), schema)


def _pair_block(t: pa.Table, run, schema: str) -> pa.Table:
    q, p = _sides(t)
    parts: list[pa.Table] = []
    if q.num_rows and p.num_rows:
        x, y, asked, own = _unit(q), _unit(p), _own(q.column("asked")), _own(p.column("point_id"))
        query, event = q.column("query_id").to_numpy(), q.column("event").to_numpy()
        # A block can hold several pieces of a video; each is asked by itself.
        at = {}
        for i, key in enumerate(zip(q.column("video_id").to_pylist(), q.column("piece").to_pylist())):
            at.setdefault(key, []).append(i)
        here: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(p.column("video_id").to_pylist(), p.column("piece").to_pylist())):
            here.setdefault(key, []).append(i)
        for key, i in at.items():
            j = here.get(key)
            if j:
                parts += run((query[i], event[i]), (x[i], asked[i]), (y[j], own[j]), p.take(pa.array(j)))
    return _result(parts, schema)


def _own(c: pa.ChunkedArray) -> np.ndarray:
    """Point ids; a row without one is never the query's own."""
    return pc.fill_null(c, -(2**62)).to_numpy()


def _unit(t: pa.Table) -> np.ndarray:
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _video_maxima(asked, p: pa.Table, step: int):
    """Step by step (first query row, best score of each video for each query row); -inf where a video has no row but the query's own."""
    y, own, starts = _unit(p), _own(p.column("point_id")), _starts(p)
    order = np.argsort(own)
    for i in range(0, len(asked[0]), step):
        s = np.round(asked[0][i : i + step] @ y.T, DECIMALS)
        mine = asked[1][i : i + step]
        lo, hi = np.searchsorted(own, mine, "left", sorter=order), np.searchsorted(own, mine, "right", sorter=order)
        for r in np.flatnonzero((hi > lo) & (mine > -(2**62))):
            s[r, order[lo[r] : hi[r]]] = -np.inf
        yield i, np.maximum.reduceat(s, starts, axis=1)


def _whole(p: pa.Table) -> tuple[pa.Table, pa.Table]:
    whole = p.column("whole")
    return p.filter(pc.invert(whole)), p.filter(whole)


def _maxima(keys, asked, p: pa.Table) -> list[pa.Table]:
    parts = []
    for rows, at in zip(_whole(p), (np.flatnonzero(keys[1] >= 0), np.flatnonzero(keys[1] == OVERVIEW))):
        if rows.num_rows and len(at):
            names = rows.column("video_id").combine_chunks().take(pa.array(_starts(rows)))
            for i, best in _video_maxima((asked[0][at], asked[1][at]), rows, max(1, CELLS // rows.num_rows)):
                r, c = np.nonzero(best > -np.inf)
                parts.append(pa.table({"query_id": keys[0][at[i + r]], "event": keys[1][at[i + r]], "video_id": names.take(pa.array(c)), "score": best[r, c]}))
    return parts


def _composites(limit: int, n_events: int):
    def run(keys, asked, p: pa.Table) -> list[pa.Table]:
        points, shots = _whole(p)
        names = sorted(set(p.column("video_id").to_pylist()))
        number = {v: i for i, v in enumerate(names)}
        ids, query = np.unique(keys[0], return_inverse=True)
        parts: list[pa.Table] = []
        step = max(1, CELLS // max(1, p.num_rows * (n_events + 1)))
        for first in range(0, len(ids), step):
            m = min(step, len(ids) - first)
            events = np.full((m, n_events, len(names)), -np.inf)
            overview = np.full((m, len(names)), -np.inf)
            mine = (query >= first) & (query < first + m)
            for rows, at in ((points, np.flatnonzero(mine & (keys[1] >= 0))), (shots, np.flatnonzero(mine & (keys[1] == OVERVIEW)))):
                if not (rows.num_rows and len(at)):
                    continue
                cols = np.array([number[v] for v in rows.column("video_id").take(pa.array(_starts(rows))).to_pylist()])
                for i, best in _video_maxima((asked[0][at], asked[1][at]), rows, max(1, CELLS // rows.num_rows)):
                    k = at[i : i + len(best)]
                    if rows is points:
                        events[(query[k] - first)[:, None], keys[1][k][:, None], cols[None]] = best
                    else:
                        overview[(query[k] - first)[:, None], cols[None]] = best
            named = (overview > -np.inf) | (events > -np.inf).any(axis=1)
            o, e = np.where(overview > -np.inf, overview, 0.0), np.where(events > -np.inf, events, 0.0)
            score = np.where(named, o + e.sum(axis=1) / n_events, -np.inf)
            top = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :limit]  # names are in order, so of equal scores the smaller comes first
            r, c = np.nonzero(np.take_along_axis(named, top, 1))
            v = top[r, c]
            if len(r):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * n_events, pa.int32()), pa.array(e[r, :, v].ravel()))
                parts.append(pa.table({"query_id": ids[first + r], "video_id": pa.array(names).take(pa.array(v)), "score": score[r, v], "overview_score": o[r, v], "event_scores": lists}))
        return parts

    return run


def _best(x: np.ndarray, asked: np.ndarray, y: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, score, is there) of the n best rows of y for each row of x; equal rounded scores: the first row."""
    m, none = len(y), np.iinfo(np.int64).max
    key = np.rint(x @ y.T * 10.0**DECIMALS).astype(np.int64) * -m + np.arange(m)
    order = np.argsort(own)
    at = order[np.minimum(np.searchsorted(own, asked, sorter=order), m - 1)]
    same = np.flatnonzero(own[at] == asked)
    key[same, at[same]] = none
    if n < m:
        key = np.partition(key, n - 1, axis=1)[:, :n]
    key.sort(axis=1)
    ok = key < none
    return np.where(ok, key % m, 0), -(key // m) / 10.0**DECIMALS, ok


def _slots(n: int):
    def run(keys, asked, own, rows: pa.Table) -> list[pa.Table]:
        parts = []
        step = max(1, CELLS // rows.num_rows)
        for i in range(0, len(keys[0]), step):
            pos, score, ok = _best(asked[0][i : i + step], asked[1][i : i + step], *own, n)
            r, c = np.nonzero(ok)
            part = rows.select(["video_id", "frame_id", "pts_sec", "shot_id", "id"]).take(pa.array(pos[r, c]))
            parts.append(part.append_column("query_id", pa.array(keys[0][i + r])).append_column("event", pa.array(keys[1][i + r])).append_column("score", pa.array(score[r, c])))
        return parts

    return run


def _chains(n: int, n_events: int, max_gap: float, gap_weight: float):
    weight = gap_weight * n_events / (n_events - 1) if n_events > 1 else 0.0

    def run(keys, asked, own, rows: pa.Table) -> list[pa.Table]:
        frame, pts = rows.column("frame_id").to_numpy(), rows.column("pts_sec").to_numpy().astype(np.float64)
        if len(np.unique(frame)) < n_events:
            return []

        def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            gap = pts[b] - pts[a]
            fits = (frame[a] < frame[b]) & (True if max_gap <= 0 else np.isnan(gap) | (gap <= max_gap))
            return np.where(fits, weight * np.log1p(np.where(gap > 0, gap, 0)) / np.log1p(GAP_SCALE_SEC), np.inf)

        m = len(frame)
        table = cost(np.arange(m)[:, None], np.arange(m)[None, :]) if m <= TABLE_ROWS else None
        _, first, many = np.unique(keys[0], return_index=True, return_counts=True)
        first = first[many == n_events]  # a query that lacks an event has no sequence
        step = max(1, min(512, CELLS // (m * n_events)))
        parts = []
        for i in range(0, len(first), step):
            at = first[i : i + step]
            for e in range(n_events):
                pos, score, ok = _best(asked[0][at + e], asked[1][at + e], *own, n)
                order = np.argsort(np.where(ok, pos, m), axis=1, kind="stable")  # by frame
                pos, score, ok = (np.take_along_axis(z, order, 1) for z in (pos, score, ok))
                if e == 0:
                    total, chain, each = np.where(ok, score, -np.inf), pos[:, :, None], score[:, :, None]
                else:
                    a, b = last[:, :, None], pos[:, None, :]
                    worth = total[:, :, None] - (table[a, b] if table is not None else cost(a, b))
                    before = np.round(worth, 12).argmax(axis=1)  # the first of equals is the smaller frame
                    total = np.where(ok, np.take_along_axis(worth, before[:, None], 1)[:, 0] + score, -np.inf)
                    chain = np.concatenate([np.take_along_axis(chain, before[:, :, None], 1), pos[:, :, None]], axis=2)
                    each = np.concatenate([np.take_along_axis(each, before[:, :, None], 1), score[:, :, None]], axis=2)
                last = pos
            end = np.round(total, 12).argmax(axis=1)
            best = total[np.arange(len(at)), end]
            there = np.flatnonzero(np.isfinite(best))
            picked, scores = chain[there, end[there]].ravel(), each[there, end[there]].ravel()
            offsets = pa.array(np.arange(0, picked.size + 1, n_events), pa.int32())
            lists = lambda c: pa.ListArray.from_arrays(offsets, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
            took = rows.select(["frame_id", "shot_id", "pts_sec"]).take(pa.array(picked))
            parts.append(pa.table({"query_id": keys[0][at[there]], "video_id": pa.repeat(rows.column("video_id")[0], len(there)), "score": best[there] / n_events, "frames": lists(took.column("frame_id")), "shots": lists(took.column("shot_id")), "times": lists(took.column("pts_sec")), "scores": lists(pa.array(scores))}))
        return parts

    return run
