"""Operator 6: approximate nearest neighbours by inner product, with a robust-pruned directed graph over each shard of the vectors.

A shard's vectors have nearly the same length (see BANDS), so a long vector never sets the scale of short ones. Its graph is built by inserting
points in batches: a greedy search on the graph so far proposes neighbours, and relaxed distance pruning keeps a diverse few of them. Queries
run a beam search on every shard's graph, in blocks; the beam is widened until a sample of the block's queries finds what brute force finds,
and the shards' best are merged.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.llm.common import cut, keep, small

#: Neighbours to return; edges of a point after pruning and at most; width of the beam in building and, at first, in queries; relaxation of pruning.
K, EDGES, MOST_EDGES, BUILD_BEAM, BEAM, ALPHA = 20, 28, 40, 64, 64, 1.2
#: Different vectors in a shard at most, about; queries in a block, about; blocks that go through a copy of a shard's graph.
SHARD, BLOCK, SLICE = 12_000, 1_000, 8
#: Queries of a block that are also answered by brute force on each shard, and the share of those answers that the beam has to find.
SAMPLE, RECALL = 10, 0.96
#: Rows of vectors that are broadcast at most.
VECTORS = 20_000


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to the points of its row of ids."""
    d = x[ids] - q[:, None, :]
    return np.einsum("bcd,bcd->bc", d, d)


def beam_search(far: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, graph: np.ndarray, entry: int, b: int, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), nearest first, of the beam of each of b queries at its end; -1 where there are fewer of the n points.

    far(ids, rows) gives the distances of the queries rows to the points of their rows of ids. All queries go in lockstep; in each step,
    each expands its nearest points not expanded yet.
    """
    ids = np.full((b, width), -1)
    dist = np.full((b, width), np.inf)
    open_ = np.zeros((b, width), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = far(np.full((b, 1), entry), np.arange(b))[:, 0]
    live = np.arange(b)
    while live.size:
        rank = np.where(open_[live], dist[live], np.inf)
        pick = np.argpartition(rank, min(step, width - 1), axis=1)[:, :step]
        rows = np.arange(len(live))[:, None]
        use = np.isfinite(rank[rows, pick])
        go = use.any(1)
        live, pick, use = live[go], pick[go], use[go]
        if not live.size:
            break
        at = live[:, None]
        from_ = np.where(use, ids[at, pick], -1)
        open_[at, pick] &= ~use
        near = np.where(from_[:, :, None] >= 0, graph[from_], -1).reshape(len(live), -1)
        new = (near >= 0) & ~seen[at, near]
        order = np.sort(np.where(new, near, -1), axis=1)  # a point that several of them lead to counts once
        new = order >= 0
        new[:, 1:] &= order[:, 1:] != order[:, :-1]
        most = int(new.sum(1).max())
        if not most:
            continue
        to_front = np.argsort(~new, axis=1, kind="stable")[:, :most]  # nothing is reckoned for what isn't new
        order, new = np.take_along_axis(order, to_front, 1), np.take_along_axis(new, to_front, 1)
        seen[np.broadcast_to(at, order.shape)[new], order[new]] = True
        d = np.where(new, far(np.where(new, order, 0), live), np.inf)
        all_ids, all_d = np.concatenate([ids[live], order], 1), np.concatenate([dist[live], d], 1)
        all_open = np.concatenate([open_[live], new], 1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        rows = np.arange(len(live))[:, None]
        ids[live], dist[live], open_[live] = all_ids[rows, best], all_d[rows, best], all_open[rows, best]
    order = np.argsort(dist, axis=1, kind="stable")
    rows = np.arange(b)[:, None]
    dist = dist[rows, order]
    return np.where(np.isfinite(dist), ids[rows, order], -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, edges: int = EDGES, alpha: float = ALPHA) -> np.ndarray:
    """Of each point's candidates (-1 pads), the nearest is kept again and again, with those dropped to which it is alpha times nearer."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    d = np.where(candidates >= 0, _distances(x, np.maximum(candidates, 0), x[points]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(points))
    candidates, d = candidates[rows[:, None], order], d[rows[:, None], order]
    v = x[np.maximum(candidates, 0)]
    norm = np.einsum("bcd,bcd->bc", v, v)
    alive = candidates >= 0
    out = np.full((len(points), edges), -1)
    for k in range(edges):
        first = alive.argmax(1)
        go = alive[rows, first]
        if not go.any():
            break
        out[go, k] = candidates[rows[go], first[go]]
        apart = norm + norm[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", v, v[rows, first])
        alive &= ~((alpha * alpha * apart <= d) & go[:, None])
        alive[rows, first] = False
    return out


def build(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours of each point, entry point)."""
    n = len(x)
    entry = int(np.einsum("nd,nd->n", x - x.mean(0), x - x.mean(0)).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    graph = np.full((n, MOST_EDGES), -1)
    done = min(n, 128)
    start = order[:done]
    graph[start, :EDGES] = robust_prune(x, start, np.tile(start, (done, 1)))
    while done < n:
        batch = order[done : done + min(done, 400)]
        done += len(batch)
        found, _ = beam_search(lambda ids, rows: _distances(x, ids, x[batch[rows]]), n, graph, entry, len(batch), BUILD_BEAM)
        kept = robust_prune(x, batch, found)
        graph[batch, :EDGES] = kept
        to, back = kept[kept >= 0], np.repeat(batch, (kept >= 0).sum(1))
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        target, begin, count = np.unique(to, return_index=True, return_counts=True)
        have = (graph[target] >= 0).sum(1)
        fits = have + count <= MOST_EDGES
        place = np.arange(len(to)) - np.repeat(begin, count) + np.repeat(have, count)
        easy = np.repeat(fits, count)
        graph[to[easy], place[easy]] = back[easy]
        for lo in range(0, len(full := np.flatnonzero(~fits)), 256):
            part = full[lo : lo + 256]
            wide = np.full((len(part), MOST_EDGES + int(count[part].max())), -1)
            wide[:, :MOST_EDGES] = graph[target[part]]
            for i, t in enumerate(part):
                wide[i, MOST_EDGES : MOST_EDGES + count[t]] = back[begin[t] : begin[t] + count[t]]
            graph[target[part]] = -1
            graph[target[part], :EDGES] = robust_prune(x, target[part], wide)
    return graph, entry


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors with one more component that gives all the same length, so that the nearest to (q, 0) has the largest inner product with q."""
    v = v / np.abs(v).max()
    square = np.einsum("nd,nd->n", v, v)
    return np.hstack([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)


def search(v: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, k: int, width: int = BEAM) -> np.ndarray:
    """The ids of the k points found with the largest inner products for each row of q, in no order; -1 where there are fewer.

    Inner products are in double precision. The width doubles until SAMPLE of the queries find RECALL of their true k; a beam as wide as the
    shard would visit every point, so all points are compared then.
    """
    n, at = len(v), np.linspace(0, len(q) - 1, min(SAMPLE, len(q))).astype(int)
    v = v / np.exp2(np.floor(np.log2(np.abs(v).max())))
    q = q / np.exp2(np.floor(np.log2(np.abs(q).max(1, keepdims=True))))

    def exact(rows: np.ndarray) -> np.ndarray:
        if n <= k:
            return np.tile(np.arange(n), (len(rows), 1))
        return np.argpartition(-(q[rows] @ v.T), k - 1, axis=1)[:, :k]

    def near(rows: np.ndarray, width: int) -> np.ndarray:
        return beam_search(lambda ids, some: -np.einsum("bcd,bd->bc", v[ids], q[rows[some]]), n, graph, entry, len(rows), width)[0][:, :k]

    width = max(width, 2 * k)
    if width < n:
        truth = exact(at)
    while width < n:
        found = near(at, width)
        if np.mean([len(np.intersect1d(a, b)) / k for a, b in zip(truth, found)]) >= RECALL:
            return np.concatenate([near(rows, width) for rows in np.array_split(np.arange(len(q)), -(-len(q) // 256))])
        width *= 2
    out = np.full((len(q), k), -1)
    for rows in np.array_split(np.arange(len(q)), -(-len(q) // 128)):
        out[rows, : min(n, k)] = exact(rows)
    return out


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: not null, not zero, every component finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0)).distinct()


#: Bands of length in each power of two. In a narrow one the component that lifted() adds is small, so the graph's distances are the given vectors'.
BANDS = 16


def band_of(v):
    """The band of a vector's length, computed without overflow. Edges are between powers of 2^(1/BANDS), so that length 1 isn't one."""
    big = F.array_max(F.transform(v, lambda c: F.abs(c)))
    square = F.aggregate(v, F.lit(0.0), lambda s, c: s + (c / big) * (c / big))
    return F.floor(BANDS * (F.log2(big) + F.log2(square) / 2) + 0.5).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors found for each of queries (both vec_id, embedding), without the query's own id.

    Rows that are null, zero or not finite take no part (see usable()). Equal vectors are one point of the graph with the k + 1 smallest
    of their ids, more of which can't be in a result; so a vector of very many rows costs one. Queries with equal vectors are one search.
    Ties go to the smaller id. Vectors of another number of components or another band of lengths (see band_of()) are in shards of their own.
    Empty tables give no rows; extra columns aren't read.
    """
    of_vector = Window.partitionBy("v").orderBy("vec_id")
    points = usable(vectors).withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = cut(points.select("v", "ids", F.get("ids", F.lit(0)).alias("point"), F.size("v").alias("dim"), band_of(F.col("v")).alias("band")))
    asked = cut(usable(queries))
    searches = cut(asked.groupBy("v").agg(F.min("vec_id").alias("search")).withColumn("dim", F.size("v")))
    shards = cut(points.groupBy("dim", "band").agg(F.count("*").alias("n"), F.ceil(F.count("*") / shard).cast("int").alias("shards")))
    n_shards, n = (x or 1 for x in shards.agg(F.sum("shards"), F.sum("n")).first())
    spread = max(4 * -(-n // shard), min(4 * n_shards, 64))  # many shards of few vectors share a task
    shards = shards.drop("n")
    blocks = max(1, -(-searches.count() // block))
    slices = -(-blocks // SLICE)

    def make(table: pa.Table) -> pa.Table:
        keep("ann")
        ids = table.column("point").to_numpy()
        v = _matrix(table.column("v"))
        order = np.argsort(ids)
        graph, entry = build(lifted(v[order]))
        blob = _pack(ids=ids[order], v=v[order], graph=graph.astype(np.int32), entry=np.array(entry))
        return pa.table({c: table.column(c)[:1] for c in ("dim", "band", "shard")} | {"index": pa.array([blob], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        blob = _pack(ids=table.column("search").to_numpy(), v=_matrix(table.column("v")))
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "asked": pa.array([blob], pa.binary())})

    of_shard = ["dim", "band", "shard"]
    dealt = points.join(F.broadcast(shards), ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    index = cut(dealt.select("point", "v", *of_shard).repartition(spread, *of_shard).groupBy(*of_shard).applyInArrow(make, "dim int, band int, shard int, index binary"))
    grouped = searches.withColumn("block", F.pmod(F.xxhash64("search"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(gather, "dim int, block int, asked binary")
    grouped = grouped.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("slice", F.pmod("block", F.lit(slices)))
    copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    by = [*of_shard, "slice"]

    def answer(batches):
        keep("ann")
        for batch in batches:
            for i in range(batch.num_rows):
                a, q = (np.load(io.BytesIO(batch.column(c)[i].as_py())) for c in ("index", "asked"))
                v, ids, vec, who = a["v"], a["ids"], q["v"], q["ids"]
                found = search(v, a["graph"], int(a["entry"]), vec, k + 1)
                for lo in range(0, len(who), 256):
                    part = found[lo : lo + 256]
                    ok = part >= 0
                    score = np.einsum("qcd,qd->qc", v[np.maximum(part, 0)], vec[lo : lo + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who[lo : lo + 256], ok.sum(1))), pa.array(ids[part[ok]]), pa.array(score[ok])], ["search", "point", "score"])

    spread *= slices
    hits = grouped.repartition(spread, *by).join(copies.repartition(spread, *by), by).select("index", "asked").mapInArrow(answer, "search long, point long, score double")
    best = Window.partitionBy("search").orderBy(F.col("score").desc(), "point")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    hits = hits.join(points.select("point", "ids"), "point").select("search", "score", F.explode("ids").alias("vec_id"))
    hits = cut(hits.withColumn("n", F.row_number().over(Window.partitionBy("search").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("n") <= k + 1).drop("n"))
    each = asked.join(small(searches.select("v", "search"), VECTORS), "v").select(F.col("vec_id").alias("query_id"), "search")
    each = each.join(small(hits), "search").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks]).to_numpy()
    return flat.reshape(len(column), -1)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
