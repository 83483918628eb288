"""Exact top-k by inner product of quantised vectors, with a KD-tree in each shard.

Rows fall into shards of bounded size by position: median splits along the widest side, found on a
bounded sample (which decides where rows lie, not what is found); a place that very many rows share is
dealt to several shards. In a shard, median splits along the widest side build a tree whose nodes have
tight bounding boxes. A query visits nodes best first, by the largest inner product that a point of
the box can have, and stops when no box reaches its k-th score. That k-th score is carried on: every
query first searches the shard where it lies itself, and then only those shards whose own tight box
can reach what it found.

Queries and shards meet in blocks (a shard's rows and at most ``QUERY_BLOCK`` queries), so no task
holds more than that. What reaches the driver is the sample and a box for each shard.

Defined cases: rows whose id or vector is null or empty, or with a null or non-finite component,
take no part; vectors are compared with those of the same length only; a query's candidates are the
rows of every other id; of several query rows with one id the smallest vector is the query, while
as candidates repeated rows all count; ties go to the smaller id; other columns are not read; an empty
table gives no rows. Scores beyond a long saturate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, tidy
from .vectors import best, matrix, merged, query_rows, taking_part

SHARD_ROWS = 16_384
QUERY_BLOCK = 4_096
LONG = 2**63 - 1


class KdTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        work = [(0, len(points), -1, 0)]
        while work:
            start, stop, parent, side = work.pop()
            node, own = len(self.span), points[self.order[start:stop]]
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, stop))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            axis = int(np.argmax(high - low))
            if stop - start > leaf and high[axis] > low[axis]:
                mid = (stop - start) // 2
                self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, axis], mid)]
                work += [(start, start + mid, node, 0), (start + mid, stop, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.ids = points[self.order], ids[self.order]

    def bound(self, nodes, q: np.ndarray) -> np.ndarray:
        """The largest inner product that a point of each box can have."""
        return np.maximum(self.low[nodes] * q, self.high[nodes] * q).sum(axis=1)

    def search(self, q: np.ndarray, own_id: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best with a score of at least ``floor``, not those of ``own_id``."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.points.dtype)
        queue = [(-self.bound([0], q)[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            children = self.children[node]
            if children[0] >= 0:
                for b, child in zip(self.bound(children, q), children):
                    if b >= floor:
                        heapq.heappush(queue, (-b, child))
                continue
            start, stop = self.span[node]
            s = self.points[start:stop] @ q
            hit = np.flatnonzero((s >= floor) & (self.ids[start:stop] != own_id))
            if len(hit):
                ids, scores = np.concatenate([ids, self.ids[start:stop][hit]]), np.concatenate([scores, s[hit]])
                keep = best(scores, ids, k)
                ids, scores = ids[keep], scores[keep]
                if len(ids) == k:
                    floor = max(floor, scores[-1])
        return ids, scores


def quantised(m: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * m)


def exact_type(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in a type in which sums of products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


class Positions:
    """Where a vector lies: median splits of a sample along the widest side, the fullest place first."""

    def __init__(self, points: np.ndarray, places: int):
        self.axis, self.at, self.next = [0], [0.0], [[-1, -1]]  # of each node; a place is -1 - its number
        queue, done = [(-len(points), 0, points)], []
        while queue and len(queue) + len(done) < places:
            _, node, own = heapq.heappop(queue)
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int(np.argmax(high - low))
            if high[axis] == low[axis]:  # all of it is one point
                done.append(node)
                continue
            side = own[:, axis]
            at = max(float(np.partition(side, len(side) // 2)[len(side) // 2]), float(side[side > low[axis]].min()))
            self.axis[node], self.at[node], self.next[node] = axis, at, [len(self.axis), len(self.axis) + 1]
            for part in (own[side < at], own[side >= at]):
                heapq.heappush(queue, (-len(part), len(self.axis), part))
                self.axis.append(0)
                self.at.append(0.0)
                self.next.append([-1, -1])
        ends = sorted([*done, *(node for _, node, _ in queue)])
        self.places, number = len(ends), {node: i for i, node in enumerate(ends)}
        self.place = np.array([number.get(node, -1) for node in range(len(self.axis))])
        self.axis, self.at, self.next = np.array(self.axis), np.array(self.at), np.array(self.next)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (open_ := np.flatnonzero(self.place[node] < 0)).size:
            here = node[open_]
            node[open_] = self.next[here, (x[open_, self.axis[here]] >= self.at[here]).astype(int)]
        return self.place[node]


def search(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, most_fit: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    result = "query_id long, vec_id long, score long, copy long"
    rows = stored(taking_part(small_batches(df), vec_id, embedding, zero=True).withColumn("dim", F.size("vector")))
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # one row for each length of vectors
    if not sizes:
        return merged(df.sparkSession.createDataFrame([], result), k)
    positions = {}
    for dim, n in sizes.items():
        sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, most_fit * n // sum(sizes.values()))).select("vector").toArrow()
        positions[dim] = Positions(quantised(matrix(sample.column("vector"), dim), scale), -(-n // SHARD_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(2))
            for dim in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == dim))
                own = b.take(at)
                where = positions[dim].of(quantised(matrix(own.column(1), dim), scale))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(where, pa.int32())], names=["vec_id", "vector", "dim", "place"])

    rows = stored(rows.mapInArrow(tidy(place), "vec_id long, vector array<double>, dim int, place int"))
    held = {(r[0], r[1]): r[2] for r in rows.groupBy("dim", "place").count().collect()}  # one row for each place
    shards = {dim: [] for dim in sizes}  # the place and the slice of each shard
    for (dim, at), n in sorted(held.items()):
        shards[dim] += [(at, s, -(-n // SHARD_ROWS)) for s in range(-(-n // SHARD_ROWS))]
    layout = df.sparkSession.createDataFrame([(dim, at, s, i, n) for dim, of in shards.items() for i, (at, s, n) in enumerate(of)], "dim int, place int, slice int, shard int, slices int")
    slices = F.broadcast(layout.select("dim", "place", "slices").distinct())  # one row for each SHARD_ROWS rows of the table

    def dealt(x: DataFrame) -> DataFrame:
        sliced = x.join(slices, ["dim", "place"]).withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("slices")).cast("int")).drop("slices")
        return sliced.join(F.broadcast(layout.drop("slices")), ["dim", "place", "slice"]).select("vec_id", "vector", "dim", "shard")

    chosen = query_rows(rows, every).withColumn("dim", F.size("vector")).join(rows.select("vec_id", "vector", "place").distinct(), ["vec_id", "vector"])
    queries = stored(dealt(chosen))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    spread = dealt(rows).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]

    def meet(points: pa.Table, asked: pa.Table, boxes: bool) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": [], "copy": []}
        box = {"dim": [], "shard": [], "low": [], "high": []}
        if points.num_rows:
            dim, x = points.column("dim")[0].as_py(), quantised(matrix(points.column("vector"), points.column("dim")[0].as_py()), scale)
            if boxes and points.column("block")[0].as_py() == 0:
                box = {"dim": [dim], "shard": [points.column("shard")[0].as_py()], "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()]}
            if asked.num_rows:
                p, q = exact_type(x, quantised(matrix(asked.column("vector"), dim), scale))
                tree = KdTree(p, np.asarray(points.column("vec_id"), np.int64))
                floors = asked.column("floor").to_pylist()
                for i, own in enumerate(asked.column("vec_id").to_pylist()):
                    ids, scores = tree.search(q[i], own, k, -np.inf if floors[i] is None else floors[i])
                    out["query_id"] += [own] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += [max(-LONG - 1, min(LONG, int(s))) for s in scores]
                    out["copy"] += range(len(ids))
        found = pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))
        if not boxes:
            return found
        box = pa.table(box, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
        return pa.concat_tables([found, box], promote_options="default")

    def met(asked: DataFrame, boxes: bool) -> DataFrame:
        schema = result + (", dim int, shard int, low array<double>, high array<double>" if boxes else "")
        return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda points, asked: meet(points, asked, boxes), schema)

    both = stored(met(queries.withColumn("floor", F.lit(None).cast("long")), True))
    home = both.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score", "copy")
    box = {}
    for dim in sizes:
        own = both.filter((F.col("low").isNotNull()) & (F.col("dim") == dim)).select("shard", "low", "high").toArrow()
        box[dim] = np.asarray(own.column("shard"), np.int32), matrix(own.column("low"), dim), matrix(own.column("high"), dim)
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "vector", "dim", "shard", "block", "floor")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for each other shard whose box can reach what they have found."""
        for b in batches:
            at, to = [], []
            for i in range(b.num_rows):
                dim, own, floor = (b.column(c)[i].as_py() for c in (2, 3, 5))
                shard, low, high = box[dim]
                q = quantised(np.array(b.column(1)[i].as_py(), np.float64), scale)
                most = np.maximum(low * q, high * q).sum(axis=1)
                good = shard[(shard != own) & ((floor is None) | (most + np.abs(most) * 1e-9 >= (-np.inf if floor is None else floor)))]
                at += [i] * len(good)
                to += good.tolist()
            own = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(to, pa.int32()), own.column(4), own.column(5)], names=["vec_id", "vector", "dim", "shard", "block", "floor"])

    away = stored(asking.mapInArrow(tidy(reach), "vec_id long, vector array<double>, dim int, shard int, block int, floor long"))
    return merged(home.unionByName(met(away, False)), k)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.w) = len(q.w)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
