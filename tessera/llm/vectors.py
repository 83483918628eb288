"""What both vector searches share: which rows take part, blocks of shards and queries, the merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def taking_part(df: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: id and vector not null, at
    least one component, all finite, and not all zero unless ``zero`` allows it."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    if not zero:
        ok &= F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of several rows with one id the smallest vector."""
    return rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates (query_id, vec_id, score), ranked from 1. A query has
    at most k for each block searched; repeated rows of one vec_id are told apart by ``copy``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
