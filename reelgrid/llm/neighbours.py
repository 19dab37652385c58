"""The k most similar vectors of every vector, through learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts, and a small softmax
classifier learns to tell a vector's part from the vector. Where the vectors need more parts than one
graph can be cut into, each part is cut again in the same way on a sample of its own, over the
cluster. Every vector is indexed in its most probable part and searched in its several most probable
ones, where candidates are ranked by exact cosine. The vectors cross the network once per searched
part and nothing grows with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.session import cut_lineage

#: Neighbours of a sampled vector in the graph that is cut.
GRAPH_K = 10


@dataclass
class Router:
    """The classifier: weights, biases, and the share of the sample that each part holds."""

    weights: np.ndarray
    bias: np.ndarray
    share: np.ndarray

    def chances(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` most probable parts of each row, the best one first, and their log-probabilities."""
        z = x @ self.weights + self.bias
        most = min(most, z.shape[1])
        top = np.argpartition(-z, most - 1, axis=1)[:, :most]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1, kind="stable"), 1)
        peak = z.max(axis=1, keepdims=True)
        return top, np.take_along_axis(z, top, 1) - peak - np.log(np.exp(z - peak).sum(axis=1, keepdims=True))

    def parts(self, x: np.ndarray, most: int) -> np.ndarray:
        return self.chances(x, most)[0]


@dataclass
class Tree:
    """A router whose parts may have routers of their own; the leaves are numbered part by part."""

    top: Router
    below: list[Router | None]

    def __post_init__(self) -> None:
        counts = np.array([1 if r is None else len(r.bias) for r in self.below])
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.share = np.concatenate([[t] if r is None else t * r.share for t, r in zip(self.top.share, self.below)])

    def leaves(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` most probable leaves of each row, the best one first: a leaf's chance is its part's times its own."""
        parts, chance = self.top.chances(x, most)
        if all(r is None for r in self.below):
            return parts
        ids = np.full((len(x), parts.shape[1] * most), -1, np.int64)
        value = np.full(ids.shape, -np.inf)
        for j in range(parts.shape[1]):
            order = np.argsort(parts[:, j], kind="stable")
            ends = np.flatnonzero(np.diff(parts[order, j])) + 1
            for rows in np.split(order, ends):
                p = parts[rows[0], j]
                router = self.below[p]
                if router is None:
                    ids[rows, j * most], value[rows, j * most] = self.first[p], chance[rows, j]
                else:
                    leaf, own = router.chances(x[rows], most)
                    at = j * most + np.arange(leaf.shape[1])
                    ids[rows[:, None], at], value[rows[:, None], at] = self.first[p] + leaf, chance[rows, j, None] + own
        order = np.argsort(-value, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1)  # -1 where a row has fewer


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train_router(sample: np.ndarray, parts: int, seed: int = 11, epochs: int = 12) -> Router:
    """Cut the neighbour graph of unit vectors into balanced parts and fit the classifier to them."""
    x = np.unique(sample, axis=0)
    m, dim = x.shape
    parts = max(1, min(parts, m // 20 or 1))
    if parts == 1:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(m)]
    k = min(GRAPH_K, m - 1)
    graph = np.empty((m, k), np.int64)
    for i in range(0, m, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        graph[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    room = int(np.ceil(1.1 * m / parts))
    centre = x[:parts].copy()
    for _ in range(6):
        label = _balanced(x @ centre.T, room)
        total = np.zeros((parts, dim))
        np.add.at(total, label, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(length > 0, total / np.maximum(length, 1e-12), centre).astype(np.float32)
    near = x @ centre.T
    rows = np.repeat(np.arange(m), k)
    for _ in range(5):  # each node moves to the part of most of its neighbours, while there is room
        votes = _votes(m, parts, rows, graph, label)
        votes += 0.3 * near
        votes[np.arange(m), label] += 0.5
        label = _balanced(votes, room)
    goal = _votes(m, parts, rows, graph, label)
    goal /= goal.sum(1, keepdims=True)
    goal *= 0.5
    goal[np.arange(m), label] += 0.5
    w, b = (centre.T * 10).astype(np.float32), np.zeros(parts, np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for e in range(epochs):
        order = rng.permutation(m)
        for i in range(0, m, 512):
            t = order[i : i + 512]
            z = x[t] @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = (p - goal[t]) / len(t)
            mw, mb = 0.9 * mw + x[t].T @ g, 0.9 * mb + g.sum(0)
            w -= 10 * 0.88**e * mw
            b -= 0.4 * 0.88**e * mb
    router = Router(w, b, np.ones(parts))
    held = np.bincount(router.parts(x, 1)[:, 0], minlength=parts)
    router.share = held / held.sum()
    return router


def _votes(m: int, parts: int, rows: np.ndarray, graph: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each node, how many of its neighbours each part holds; being a neighbour counts half."""
    there = np.bincount(rows * parts + label[graph.ravel()], minlength=m * parts)
    back = np.bincount(graph.ravel() * parts + np.repeat(label, graph.shape[1]), minlength=m * parts)
    return (there + 0.5 * back).reshape(m, parts).astype(np.float32)


def _balanced(score: np.ndarray, room: int) -> np.ndarray:
    """The best-scoring part of each row; a part takes its highest scores up to ``room``, the others go on."""
    score = score.copy()
    label = np.full(len(score), -1)
    left = np.full(score.shape[1], room)
    todo = np.arange(len(score))
    while len(todo):
        best = score[todo].argmax(1)
        value = score[todo, best]
        order = np.lexsort((-value, best))
        place = np.arange(len(order)) - np.searchsorted(best[order], best[order])
        ok = np.zeros(len(todo), bool)
        ok[order] = place < left[best[order]]
        label[todo[ok]] = best[ok]
        left -= np.bincount(best[ok], minlength=len(left))
        score[:, left <= 0] = -np.inf
        todo = todo[~ok]
    return label


def similar_vectors(df: DataFrame, point: str, vector: str, k: int = 10, dim: int = 96, least_cosine: float = -1.0, probes: int = 3, sample_rows: int = 16_384, part_rows: int = 1_000, block_rows: int = 12_000, parts_most: int = 512, leaves_most: int = 65_536, seed: int = 11) -> DataFrame:
    """(point_a, point_b, cosine): for each point its k most similar other points with a cosine of at least ``least_cosine``.

    Equal cosines: the smaller point first. ``sample_rows`` bounds what a router is fitted on, every row
    is indexed. Parts hold about ``part_rows`` vectors: one router makes up to ``parts_most`` of them;
    more vectors are cut in two levels, the second one fitted over the cluster on samples of up to
    ``sample_rows`` vectors a part, into up to ``leaves_most`` parts, which is also what bounds the
    broadcast of the routers (leaves x dim numbers, 25 MB). A part that would hold more than
    ``block_rows`` is searched in several blocks. ``probes`` parts are searched for each vector.

    Defined cases: a vector that is null, of another length than ``dim``, with a null or infinite
    number or all zero is left out on both sides; repeated rows count once; equal vectors under many
    points are searched once and then each of them gets its nearest copies, smallest points first;
    fewer than k others give as many as there are; an empty table gives no rows; a null point is left
    out; other columns are not read. One point with different vectors counts as several.
    """
    v = F.col(f"`{vector}`")
    usable = F.col(f"`{point}`").isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(usable).select(F.col(f"`{point}`").cast("bigint").alias("id"), v.cast("array<float>").alias("v"))
    spark = df.sparkSession
    n = df.count()  # from the files' footers; an upper bound of the usable rows
    pick = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    sample = pick.select("v").limit(2 * sample_rows).toArrow().column("v").combine_chunks()
    if not len(sample) and n > sample_rows:  # few of many rows are usable and the draw missed them
        sample = rows.select("v").limit(sample_rows).toArrow().column("v").combine_chunks()
    if not len(sample):
        return rows.select(F.col("id").alias("point_a"), F.col("id").alias("point_b"), F.lit(1.0).alias("cosine")).limit(0)
    wanted = min(leaves_most, max(1, round(n / part_rows)))
    # Two levels of about equal width, so that no router has more parts than one graph is cut into.
    wide = wanted if wanted <= parts_most else min(parts_most, int(np.ceil(np.sqrt(wanted))))
    router = train_router(unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), wide, seed)
    below = [None] * len(router.bias) if wide == wanted else _routers_below(rows, router, n, part_rows, leaves_most, parts_most, sample_rows, dim, seed)
    tree = Tree(router, below)
    blocks = np.maximum(1, np.ceil(tree.share * n / block_rows)).astype(np.int64)
    shared = spark.sparkContext.broadcast((tree, blocks))  # leaves x dim numbers, bounded by leaves_most
    routed = rows.mapInArrow(_route(shared, probes), "part int, block int, indexed boolean, id bigint, v binary")
    groups = int(blocks.sum())
    routed = routed.repartition(max(1, min(groups, 4_000)), "part", "block")
    near = routed.groupBy("part", "block").applyInArrow(_search(k, dim, least_cosine), "a bigint, b bigint, cosine double")
    return _expand(near, rows, k)


def _routers_below(rows: DataFrame, top: Router, n: int, part_rows: int, leaves_most: int, parts_most: int, sample_rows: int, dim: int, seed: int) -> list[Router | None]:
    """For every part the router that cuts it, fitted over the cluster on a sample of the part; None for a part that is small enough."""
    many = np.clip(np.round(top.share * n / part_rows), 1, parts_most).astype(np.int64)
    over = many.sum() / leaves_most
    if over > 1:
        many = np.maximum(1, np.floor(many / over)).astype(np.int64)
    # As many sampled vectors for each leaf as one level has, at most sample_rows a part.
    rate = np.minimum(1.0, np.minimum(sample_rows, 64 * many) / np.maximum(1.0, top.share * n))
    shared = rows.sparkSession.sparkContext.broadcast((top, rate))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, share = shared.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part = router.parts(unit(x), 1)[:, 0]
                keep = np.flatnonzero((_mark(x) % np.uint64(1 << 20)).astype(np.float64) / (1 << 20) < share[part])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(part[keep], pa.int32()), b.column(1).take(pa.array(keep))], ["part", "v"])

    def fit(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        x = unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim))[: 2 * sample_rows]
        r = train_router(x, int(many[part]), seed)
        return pa.table({"part": pa.array([part], pa.int32()), "w": [r.weights.astype(np.float32).tobytes()], "b": [r.bias.astype(np.float32).tobytes()], "s": [r.share.astype(np.float64).tobytes()]})

    drawn = rows.mapInArrow(draw, "part int, v array<float>").where(F.col("part").isin([int(p) for p in np.flatnonzero(many > 1)]))
    out: list[Router | None] = [None] * len(many)
    # One row a part, leaves_most x dim numbers in all.
    for r in drawn.groupBy("part").applyInArrow(fit, "part int, w binary, b binary, s binary").toLocalIterator():
        bias = np.frombuffer(r["b"], np.float32)
        if len(bias) > 1:
            out[r["part"]] = Router(np.frombuffer(r["w"], np.float32).reshape(dim, -1), bias, np.frombuffer(r["s"], np.float64))
    return out


def _route(shared, probes: int):
    """Rows for the parts: each different vector of a batch once to index it, and copies to search elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, blocks = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            mark = _mark(x[order])
            _, first = np.unique(mark, return_index=True)  # of equal vectors the smallest point stands for all
            keep = order[first]
            ids, x, mark = ids[keep], x[keep], mark[first]
            parts = tree.leaves(unit(x), probes)
            raw = np.ascontiguousarray(x, np.float32)
            for c in range(parts.shape[1]):
                there = np.flatnonzero(parts[:, c] >= 0)
                part, many = parts[there, c], blocks[parts[there, c]]
                own = (mark[there] % many.astype(np.uint64)).astype(np.int64)
                if c == 0:
                    yield _rows(part, own, True, ids[there], raw[there])
                # A vector searches all blocks of its parts; in its own block it does as it is indexed there.
                for block in range(int(many.max(initial=0))):
                    t = np.flatnonzero((many > block) & ((own != block) if c == 0 else True))
                    if len(t):
                        yield _rows(part[t], np.full(len(t), block), False, ids[there[t]], raw[there[t]])

    return run


def _mark(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bits."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(5).integers(1, 2**63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (bits * odd).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)


def _rows(part: np.ndarray, block: np.ndarray, indexed: bool, ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    width = raw.shape[1] * 4
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * width
    v = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(ids), indexed)), pa.array(ids, pa.int64()), v], ["part", "block", "indexed", "id", "v"])


def _search(k: int, dim: int, least: float):
    """The k best of the block for every vector that is searched in it."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim)
        indexed = t.column("indexed").to_numpy()
        mark = _mark(x)
        order = np.lexsort((ids, ~indexed, mark))
        new = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
        keep = order[new]  # one row per vector: the indexed one before a searching one
        smallest = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        ids, x, indexed = smallest, unit(x[keep]), indexed[keep]
        base, base_ids = x[indexed], ids[indexed]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Twice the error of a float32 product of unit vectors: what lies below can't tie with the k-th.
        slack = 2 * (dim + 4) * 2.0**-24
        step = max(1, 4_000_000 // max(1, len(base)))
        for i in range(0, len(ids) if len(base) else 0, step):
            s = x[i : i + step] @ base.T
            hit = s >= least - slack
            if hit.sum() > 8 * (k + 1) * len(s):
                # Many pass: only those that may be among the k best, or tie with the last of them, are multiplied exactly.
                most = min(k + 1, s.shape[1])
                hit &= s >= -np.partition(-s, most - 1, axis=1)[:, most - 1 : most] - slack
            rows, cols = np.nonzero(hit)
            other = ids[i + rows] != base_ids[cols]
            rows, cols = i + rows[other], cols[other]
            cosine = np.empty(len(rows))
            for j in range(0, len(rows), 50_000):
                t = slice(j, j + 50_000)
                a, b = x[rows[t]].astype(np.float64), base[cols[t]].astype(np.float64)
                cosine[t] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            order = np.lexsort((base_ids[cols], -cosine, rows))
            rows, cols, cosine = rows[order], cols[order], cosine[order]
            ok = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & (cosine >= least)
            found.append((ids[rows[ok]], base_ids[cols[ok]], cosine[ok]))
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        a, b, cosine = (np.concatenate(f) for f in zip(*found))
        return pa.table({"a": a, "b": b, "cosine": cosine})

    return run


def _expand(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """From pairs of different vectors, each named by its smallest point, to the k neighbours of every point."""
    marked = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    copied = marked.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("h1", "h2", "rep")
    members = cut_lineage(marked.join(copied, ["h1", "h2"]).select("rep", "id").distinct())
    # The k + 1 smallest members of each group, in two levels so that a group of very many copies is spread.
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    low = members.withColumn("r", F.row_number().over(W.partitionBy("rep", salt).orderBy("id"))).where(F.col("r") <= k + 1)
    low = low.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    smallest = low.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    # Found from either side, a pair counts for both, so it is there at most twice. A vector that is near to
    # very many others has as many rows here: all but the best go before the shuffle and before they are collected.
    both = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= 2 * k)
    best = both.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), F.col("b").alias("b")))), 1, k).alias("best"))
    named = best.select("a", F.explode("best").alias("n")).join(smallest.withColumnRenamed("rep", "b"), F.col("n.b") == F.col("b"), "left").select("a", F.col("n.d").alias("d"), F.explode(F.coalesce("ids", F.array("n.b"))).alias("other"))
    own = smallest.select(F.col("rep").alias("a"), F.lit(-1.0).alias("d"), F.explode("ids").alias("other"))
    lists = named.unionByName(own).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("best"))
    each = lists.join(members.withColumnRenamed("rep", "a"), "a", "left").withColumn("x", F.coalesce("id", "a"))
    kept = each.select("x", F.explode(F.slice(F.filter("best", lambda s: s["other"] != F.col("x")), 1, k)).alias("s"))
    return kept.select(F.col("x").alias("point_a"), F.col("s.other").alias("point_b"), (-F.col("s.d")).alias("cosine"))
