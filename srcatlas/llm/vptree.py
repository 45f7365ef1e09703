"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from srcatlas.llm.common import cut

#: So many points are compared at once, at the ends of the tree.
LEAF = 128
#: Rows of a shard while there are few shards, how many shards that may be, and the rows of a shard beyond.
SMALL, SPREAD, LARGE = 4_000, 64, 100_000


class VPTree:
    """A tree over distinct unit vectors, by their Euclidean distance, which orders as the cosine does.

    A node's points lie within (inside) or beyond (outside) the median distance to its
    vantage point. A branch is skipped if the triangle inequality, with its bound scaled
    by ``factor``, shows that it holds nothing nearer than the k found: at 1 exactly what
    can't hold any, above 1 more. Duplicates should be one point: copies can't be parted.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        order = np.arange(len(points))
        stack = [(order, -1, 0)] if len(points) else []
        while stack:
            own, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = at
            if len(own) <= LEAF:
                self.nodes.append([own])
                continue
            # the vantage point is the one furthest from the first: such points part the others best
            first = self.points[own] - self.points[own[0]]
            v = own[int((first * first).sum(axis=1).argmax())]
            rest = own[own != v]
            gap = self.points[rest] - self.points[v]
            d = np.sqrt((gap * gap).sum(axis=1))
            near = np.argsort(d, kind="stable")
            half = len(rest) // 2
            inside, outside = rest[near[:half]], rest[near[half:]]
            # vantage point; ranges of distances on both sides; children
            self.nodes.append([v, -1, -1, d[near[0]], d[near[half - 1]], d[near[half]], d[near[-1]]])
            stack.append((outside, at, 2))
            stack.append((inside, at, 1))

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, reach: float = np.inf) -> tuple[np.ndarray, float]:
        """Indices of the k nearest points that the pruned search meets, and all others as near as the k-th; and its distance.

        Nothing beyond a ``reach`` that is known from elsewhere is looked for.
        """
        if not self.nodes:
            return np.zeros(0, dtype=np.int64), reach
        found, dist = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        stack = [(0, 0.0)]
        while stack:
            at, bound = stack.pop()
            if bound * factor > reach:
                continue
            node = self.nodes[at]
            ids = node[0] if len(node) == 1 else np.array([node[0]])
            gap = self.points[ids] - q
            d = np.sqrt((gap * gap).sum(axis=1))
            near = d <= reach
            if near.any():
                found.append(ids[near])
                dist.append(d[near])
                every = np.concatenate(dist)
                if len(every) >= k:
                    reach = min(reach, float(np.partition(every, k - 1)[k - 1]) + 1e-9)
            if len(node) > 1:
                x = float(d[0])
                inner, outer = max(0.0, node[3] - x, x - node[4]), max(0.0, node[5] - x, x - node[6])
                # the nearer side is searched first, so it is pushed last
                stack += [(node[1], inner), (node[2], outer)] if outer < inner or (outer == inner and x > node[4]) else [(node[2], outer), (node[1], inner)]
        ids, d = np.concatenate(found), np.concatenate(dist)
        return ids[d <= reach], reach


def _distinct_ids(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and vectors of a part; of rows of one id the one whose vector comes first by its components."""
    ids, raw = part["vec_id"].to_numpy(dtype=np.int64), np.stack(part["vec"].to_numpy()).astype(np.float64)
    order = np.lexsort((*raw.T[::-1], ids))
    ids, raw = ids[order], raw[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], raw[first]


class Shard:
    """The tree over a shard's distinct vectors, and the rows that have each."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        size = np.sqrt((raw * raw).sum(axis=1))
        self.ids = ids
        self.distinct, first, group = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        self.members = np.argsort(group, kind="stable")
        self.starts = np.searchsorted(group[self.members], np.arange(len(self.distinct) + 1))
        self.sizes = size[first]
        self.tree = VPTree(self.distinct / self.sizes[:, None])

    def reach(self, q: np.ndarray, k: int, factor: float) -> float:
        """A distance within which this shard has k rows other than the query's own; infinite if it may have fewer."""
        return self.tree.search(q / np.sqrt((q * q).sum()), k + 1, factor)[1]

    def nearest(self, qid: int, q: np.ndarray, k: int, factor: float, reach: float) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k nearest rows within ``reach``, other than the query's own."""
        length = np.sqrt((q * q).sum())
        # one more than asked for, as the query may be among them; copies of a point score the same, so its k + 1 smallest ids do
        hits, _ = self.tree.search(q / length, k + 1, factor, reach)
        score = (self.distinct[hits] * q).sum(axis=1) / (self.sizes[hits] * length)
        rows = [(-s, int(i)) for s, h in zip(score.tolist(), hits.tolist(), strict=True) for i in self.ids[self.members[self.starts[h] : min(self.starts[h + 1], self.starts[h] + k + 1)]] if i != qid]
        return [(qid, i, -s) for s, i in sorted(rows)[:k]]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Shard | None, tuple]]:
    """The rows of a join of query blocks with shards, unpacked; a shard that stands in several rows in a row is unpacked once."""
    last, shard = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["tree"] is None:
                last, shard = None, None
            elif (row["dim"], row["shard"]) != last:
                last, shard = (row["dim"], row["shard"]), pickle.loads(row["tree"])
            yield row, shard, pickle.loads(row["asked"])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and a vector that isn't null, zero or with null or non-finite parts."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))


def shards_for(rows: int) -> int:
    """How many shards: of SMALL rows each up to SPREAD shards, then larger ones of at most LARGE rows. A function of the rows alone."""
    return max(1, ceil(rows / LARGE), min(ceil(rows / SMALL), SPREAD))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.15, shards: int | None = None, query_rows: int = 2_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all ``vectors`` for each of ``queries``, by cosine.

    Vectors are dealt into shards by the hash of their id (see shards_for), and each
    shard's tree is built once and stored. Queries are dealt into blocks of about
    ``query_rows``. Each block first asks one shard, which gives every query a distance
    within which k rows lie; with that the block goes past all shards, and a shard
    answers only with what is as near. So a task holds one tree and one block at a time,
    trees stay where they are while blocks move, and the answers that are ranked at the
    end are few. ``factor`` 1 is exact; above, branches are pruned harder (see VPTree).

    Scores are computed in double precision from the original vectors; equal scores stand
    by vec_id. A row isn't its own neighbour. Rows that don't take part (see usable) are
    neither queries nor candidates; vectors of another length share no space, so each
    length is searched on its own. Copies are one point of a tree. Of rows of one id and
    length that one counts whose vector comes first by its components.
    """
    rows = usable(vectors, vec_id, vector).withColumn("dim", F.size("vec"))
    asked = usable(queries, vec_id, vector).withColumn("dim", F.size("vec"))
    parts, blocks = shards or shards_for(rows.count()), max(1, ceil(asked.count() / query_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(Shard(*_distinct_ids(part)))]})

    def gather(key, part: pd.DataFrame) -> pd.DataFrame:
        ids, raw = _distinct_ids(part)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "asked": [pickle.dumps((ids, raw, np.full(len(ids), np.inf)))]})

    # as many partitions as shards, so that they run side by side however few bytes they have
    placed = lambda df: df.repartition(parts, "dim", "shard")
    trees = cut(rows.withColumn("shard", deal("vec_id", parts)).repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))
    waiting = cut(asked.withColumn("block", deal("vec_id", blocks)).groupBy("dim", "block").applyInPandas(gather, "dim int, block int, asked binary"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard, (ids, raw, reach) in _pairs(batches):
            if shard is not None:
                reach = np.array([shard.reach(q, k, factor) for q in raw])
            yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([pickle.dumps((ids, raw, reach))], pa.binary())], names=["dim", "asked"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, (ids, raw, reach) in _pairs(batches):
            out = [hit for qid, q, r in zip(ids.tolist(), raw, reach.tolist(), strict=True) for hit in shard.nearest(qid, q, k, factor, r)]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    home = placed(waiting.withColumn("shard", F.pmod(F.col("block"), F.lit(parts)))).join(placed(trees), ["dim", "shard"], "left")
    ready = cut(home.select("dim", "shard", "tree", "asked").mapInArrow(first, "dim int, asked binary"))
    every = placed(ready.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))).join(placed(trees), ["dim", "shard"])
    found = every.select("dim", "shard", "tree", "asked").mapInArrow(second, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
