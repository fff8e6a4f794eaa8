"""Exact nearest neighbours in blocks: each group compares one block of queries with one block of points, a tile of their distances at a time, and
passes on k rows a query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and points of a tile: a task holds one matrix of their distances, 8 bytes each.
QUERIES, POINTS = 1_000, 4_000
#: Numbers in a block of vectors at most, about: a group holds one of each side, some hundred megabytes as Arrow and matrix.
BLOCK = 8_000_000


def blocks(n: int, m: int, dimensions: int, groups: int, queries: int = QUERIES, points: int = POINTS) -> tuple[int, int]:
    """Blocks of n queries and of m points: about so many pairs as groups, with each side shuffled little, unless tiles are fewer or a block would
    be larger than BLOCK."""
    tiles_q, tiles_p = max(1, math.ceil(n / queries)), max(1, math.ceil(m / points))
    own = max(1, min(tiles_q, round(math.sqrt(groups * max(n, 1) / max(m, 1)))))
    other = max(1, min(tiles_p, math.ceil(groups / own)))
    own = max(1, min(tiles_q, math.ceil(groups / other)))
    return max(own, math.ceil(n * dimensions / BLOCK)), max(other, math.ceil(m * dimensions / BLOCK))


def nearest(queries: DataFrame, points: DataFrame, k: int, queries_a_block: int = QUERIES, points_a_block: int = POINTS) -> DataFrame:
    """q_id, id, dist, rank: the k points of least squared distance to each query, itself left out, ties to smaller ids.

    queries and points have id (long) and v (array of numbers, of one length); rows of null vectors take no part. Distances are rounded to
    nine places and summed in the order of the dimensions. Both sides are cut into blocks by a hash of the id, and a pair of blocks is a
    group. Each side is shuffled once for each block of the other, so blocks are as few as keep all tasks at work and as memory allows; a group goes
    through its pair in tiles. The merge sees k rows a query and block of points, never all pairs. All pairs are compared: the time is quadratic.
    """
    q, p = (df.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v") for df in (queries, points))
    (n, d), (m, e) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first() for df in (q, p))
    nq, np_ = blocks(n, m, max(1, d, e), 2 * int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), queries_a_block, points_a_block)
    # of one type on both sides: a long and an int of the same value are dealt to different partitions, where their group has no other side
    dealt = lambda df, own, other, n, m: df.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    def tile(qi, a, pi, b, bound):
        """Rows of a, ids and distances of the k nearest of b, of those within the rows' bounds.

        One product of matrices tells distances up to a small error; what may be among the nearest by them is measured exactly.
        """
        import numpy as np

        with np.errstate(all="ignore"):
            aa, bb = (a * a).sum(1), (b * b).sum(1)
            if np.isfinite(aa).all() and np.isfinite(bb).all():
                about = aa[:, None] + bb - 2 * (a @ b.T)
                slack = 2e-9 + 1e-14 * (a.shape[1] + 2) * (aa + bb.max())  # the product's error, and half a step of the ninth place on both sides
            else:
                about, slack = np.zeros((len(a), len(b))), np.zeros(len(a))
                for j in range(a.shape[1]):
                    about += (a[:, j, None] - b[None, :, j]) ** 2
                slack = slack + 2e-9
        if np.isin(qi, pi).any():
            about[qi[:, None] == pi] = np.inf
        about = np.where(np.isnan(about), np.inf, about)
        if len(b) > k and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(about, k - 1, axis=1)[:, k - 1] + slack)
        row, column = np.nonzero((about <= (bound + slack)[:, None]) & np.isfinite(about))
        d = np.zeros(len(row))
        for j in range(a.shape[1]):
            d += (a[row, j] - b[column, j]) ** 2
        d = np.round(d, 9)
        here = np.isfinite(d)
        return nearest_of(row[here], pi[column[here]], d[here])

    def nearest_of(row, id_, dist):
        import numpy as np

        order = np.lexsort((id_, dist, row))
        row, id_, dist = row[order], id_[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], id_[keep], dist[keep]

    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(table):
            lists = table.column("v").combine_chunks()
            return table.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(left) and len(right):
            (qi, a), (pi, b) = matrix(left), matrix(right)
            parts = []
            for i in range(0, len(a), queries_a_block):
                own, bound = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.full(len(a[i : i + queries_a_block]), np.inf)
                for j in range(0, len(b), points_a_block):
                    new = tile(qi[i : i + queries_a_block], a[i : i + queries_a_block], pi[j : j + points_a_block], b[j : j + points_a_block], bound)
                    own = nearest_of(*(np.concatenate(both) for both in zip(own, new)))
                    last = np.searchsorted(own[0], np.arange(len(bound))) + k - 1
                    full = np.bincount(own[0], minlength=len(bound)) == k
                    bound[full] = own[2][last[full]]
                parts.append((qi[i + own[0]], *own[1:]))
            found = [np.concatenate(c) for c in zip(*parts)]
        return pa.table(dict(zip(("q_id", "id", "dist"), found)), pa.schema([("q_id", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())]))

    pairs = dealt(q, "_q", "_p", nq, np_).groupBy("_q", "_p").cogroup(dealt(p, "_p", "_q", np_, nq).groupBy("_q", "_p"))
    found = pairs.applyInArrow(compare, "q_id long, id long, dist double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def purity(near: DataFrame, labels: DataFrame, at: list[int]) -> DataFrame:
    """One row with purity_k for each k: the share of neighbours up to rank k that have their query's label. labels has id and label."""
    own = labels.select(F.col("id").alias("q_id"), F.col("label").alias("_q"))
    same = (F.col("label") == F.col("_q")).cast("int")
    told = near.join(labels.select("id", "label"), "id").join(own, "q_id")
    return told.agg(*(F.avg(F.when(F.col("rank") <= k, same)).alias(f"purity_{k}") for k in at))


def votes(near: DataFrame, labels: DataFrame, label, least: float = 1e-9) -> DataFrame:
    """q_id, vote: the share of a label among a query's neighbours, each weighing by the inverse of its distance. label may be a column of labels renamed q_label, the query's own."""
    own = labels.select(F.col("id").alias("q_id"), F.col("label").alias("q_label"))
    weight = 1 / (F.sqrt("dist") + F.lit(least))
    told = near.join(labels.select("id", "label"), "id").join(own, "q_id")
    return told.groupBy("q_id").agg((F.sum((F.col("label") == label).cast("int") * weight) / F.sum(weight)).alias("vote"))
