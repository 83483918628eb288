"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with
product-quantised residuals.

Centroids and codebooks are fitted on at most ``most_fit`` rows (a documented sample, first by
hashed id); every row is indexed. There are about sqrt(rows) lists. A query probes the lists whose
centroids have the largest bounds on the inner product (the centroid's own plus what a list of that
spread and size adds) and estimates every score there from its table of sub-vector products
(asymmetric: the query is not quantised); where lists meet queries there are codes, and no vectors of
rows. Of all its estimates a query's ``shortlist`` best are reranked exactly, on the vectors.

Lists are put together in parts of bounded size, large lists are cut into several, and queries come in
blocks, so a list with a third of all rows is many tasks.

Defined cases: null, empty and zero vectors, and those with a null or non-finite component, take no
part; neither do vectors whose length isn't the commonest one (the smaller of equally common ones),
since the measure isn't defined between lengths; of several query rows with one id the smallest
vector is the query; repeated rows are candidates as often as they occur; ties, in estimates too, go
to the smaller vec_id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, tidy
from .vectors import best, matrix, merged, query_rows, taking_part

PART_ROWS = 32_768
QUERY_BLOCK = 1_024
#: Queries of a group of the reranking, which has few candidates of each.
RERANK_BLOCK = 32_768
PAIRS = 32_768


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[s : s + 8192] @ centres.T).argmin(axis=1) for s in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[r.choice(len(x), int((~full).sum()))]
    return centres


@dataclass
class IvfPq:
    centres: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # for each sub-space (codewords, its dimensions)
    cuts: list[tuple[int, int]]
    reach: np.ndarray  # of each list: what its residuals are likely to add to a unit query's product

    @staticmethod
    def fit(x: np.ndarray, lists: int, spaces: int = 32, codewords: int = 256, seed: int = 3) -> IvfPq:
        r = np.random.default_rng(seed)
        dim = x.shape[1]
        centres = k_means(x, lists, 8, r)
        near = nearest_centre(x, centres)
        rest = x - centres[near]
        held = np.bincount(near, minlength=len(centres))
        spread = np.sqrt(np.bincount(near, weights=(rest**2).sum(axis=1), minlength=len(centres)) / np.maximum(held, 1) / dim)
        reach = spread * np.sqrt(2 * np.log(np.maximum(held, 2)))
        edges = np.linspace(0, dim, min(spaces, dim) + 1).astype(int)
        cuts = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]
        return IvfPq(centres, [k_means(rest[:, a:b], codewords, 6, r) for a, b in cuts], cuts, reach)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row and the codes of its residual."""
        where = nearest_centre(x, self.centres)
        rest = x - self.centres[where]
        codes = np.stack([nearest_centre(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], axis=1)
        return where, codes.astype(np.uint8)

    @property
    def width(self) -> int:
        return max(map(len, self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each sub-space the inner products of the query with its codewords."""
        out = np.zeros((len(self.books), self.width))
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out[i, : len(book)] = book @ q[a:b]
        return out


def laid_out(sizes: list[int]) -> tuple[list[int], list[int]]:
    """For each list its first part and into how many parts its rows are dealt, so that a part has
    about PART_ROWS rows at most: small lists share one, a large one has several of its own."""
    first, slices, part, room = [], [], 0, PART_ROWS
    for n in sizes:
        if n > room and room < PART_ROWS:
            part, room = part + 1, PART_ROWS
        first.append(part)
        slices.append(max(1, -(-n // PART_ROWS)))
        if slices[-1] > 1:
            part, room = part + slices[-1], PART_ROWS
        else:
            room -= n
    return first, slices


def search(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probed: float = 0.8, shortlist: int = 200, most_fit: int = 20_000, most_lists: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (double) for rows whose id is divisible by ``every``. There are
    about sqrt(rows) lists, at most ``most_lists``; a query probes the share ``probed`` of them."""
    spark = df.sparkSession
    rows = stored(taking_part(small_batches(df), vec_id, embedding, zero=False).withColumn("dim", F.size("vector")))
    dims = sorted((-n, d) for d, n in ((r[0], r[1]) for r in rows.groupBy("dim").count().collect()))
    schema = "query_id long, vec_id long, score double, copy long"
    if not dims:
        return merged(spark.createDataFrame([], schema), k)
    n, dim = -dims[0][0], dims[0][1]
    rows = rows.filter(F.col("dim") == dim).drop("dim")
    sample = matrix(pa.Table.from_pandas(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_fit).select("vector").toPandas()).column("vector"), dim)
    index = IvfPq.fit(sample, int(min(most_lists, max(1, n**0.5))))
    lists, spaces = len(index.centres), len(index.books)
    probes = max(1, round(probed * lists))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, codes = index.encode(matrix(b.column(1), dim))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where, pa.int32()), packed], names=["vec_id", "list", "codes"])

    indexed = stored(rows.mapInArrow(tidy(place), "vec_id long, list int, codes binary"))
    sizes = {r[0]: r[1] for r in indexed.groupBy("list").count().collect()}  # one row for each list
    first, slices = laid_out([sizes.get(c, 0) for c in range(lists)])
    of_list = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("list") + 1)
    queries = stored(query_rows(rows, every))
    asking = queries.count()
    blocks = max(1, -(-asking // QUERY_BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1), dim)
            bound = q @ index.centres.T + np.linalg.norm(q, axis=1)[:, None] * index.reach
            at, parts, wanted = [], [], []
            for i, near in enumerate(np.argsort(-bound, axis=1, kind="stable")[:, :probes].tolist()):
                own: dict[int, list[int]] = {}
                for c in near:
                    for p in range(first[c], first[c] + slices[c]):
                        own.setdefault(p, []).append(c)
                at += [i] * len(own)
                parts += own
                wanted += own.values()
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(parts, pa.int32()), pa.array(wanted, pa.list_(pa.int32()))], names=["vec_id", "vector", "part", "lists"])

    asked = queries.mapInArrow(tidy(probe), "vec_id long, vector array<double>, part int, lists array<int>").withColumn("block", block_of("vec_id", blocks))
    held = indexed.withColumn("part", (of_list(first) + F.pmod(F.xxhash64("vec_id", F.lit(1)), of_list(slices))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def estimate(points: pa.Table, wanted: pa.Table) -> pa.Table:
        asks, near_ids, near_loss = [], [], []
        if points.num_rows and wanted.num_rows:
            ids, where = np.asarray(points.column("vec_id"), np.int64), np.asarray(points.column("list"), np.int64)
            codes = np.frombuffer(b"".join(points.column("codes").to_pylist()), np.uint8).reshape(-1, spaces).T.astype(np.int64)
            codes += np.arange(spaces)[:, None] * index.width
            probing = np.zeros(lists, bool)
            for q, own, near in zip(matrix(wanted.column("vector"), dim), wanted.column("vec_id").to_pylist(), wanted.column("lists").to_pylist()):
                probing[:] = False
                probing[near] = True
                use = np.flatnonzero(probing[where] & (ids != own))
                if len(use):
                    guess = (index.centres @ q)[where] + np.take(index.tables(q).reshape(-1), codes).sum(axis=0)
                    keep = use[best(guess[use], ids[use], shortlist)]
                    asks.append(own)
                    near_ids.append(ids[keep])
                    near_loss.append(-guess[keep])
        ends = pa.array(np.cumsum([0, *map(len, near_ids)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *near_loss])), pa.array(np.concatenate([np.zeros(0, np.int64), *near_ids]))], names=["loss", "vec_id"])
        return pa.table({"query_id": pa.array(asks, pa.int64()), "near": pa.ListArray.from_arrays(ends, pairs)})

    keys = ["part", "block"]
    guessed = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(estimate, "query_id long, near array<struct<loss: double, vec_id: long>>")
    # One row for each part that a query probes; the best estimates of all come first in their order.
    listed = guessed.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, shortlist).alias("near"))

    shares, blocks = -(-n // PART_ROWS), max(1, -(-asking // RERANK_BLOCK))
    share = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shares)).cast("int").alias("part")
    wanted = listed.select("query_id", F.array_distinct("near.vec_id").alias("ids")).join(queries.withColumnRenamed("vec_id", "query_id"), "query_id")
    wanted = wanted.withColumn("block", block_of("query_id", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    points = rows.select("vec_id", "vector", share, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def rerank(points: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))]
        if points.num_rows and wanted.num_rows:
            ids = np.asarray(points.column("vec_id"), np.int64)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(points.column("vector"), dim)
            q, asks = matrix(wanted.column("vector"), dim), np.asarray(wanted.column("query_id"), np.int64)
            lists = wanted.column("ids").to_pylist()
            asker, vec = np.repeat(np.arange(len(lists)), [len(v) for v in lists]), np.array([i for v in lists for i in v], np.int64)
            low = np.searchsorted(ids, vec)
            size = np.searchsorted(ids, vec, side="right") - low
            copy = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at, asker, vec = np.repeat(low, size) + copy, np.repeat(asker, size), np.repeat(vec, size)
            for s in range(0, len(at), PAIRS):
                p = slice(s, s + PAIRS)
                out.append((asks[asker[p]], vec[p], (x[order[at[p]]] * q[asker[p]]).sum(axis=1), copy[p]))
        return pa.table(dict(zip(("query_id", "vec_id", "score", "copy"), map(np.concatenate, zip(*out)))))

    return merged(points.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(rerank, schema), k)


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column, F.lit(2)), F.lit(blocks)).cast("int")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
