"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents are packed in falling order of length. A piece goes into the open bin with the least
room that still holds it. Where none does, the bin size of least cost for each token that it can
still gather is opened: cost(capacity) / (piece + what the shorter pieces can add), where the cost
has a fixed, a linear and a quadratic part, as a training step over a sequence has. At the end each bin shrinks to the smallest permitted length that holds its contents.

Shards of about ``shard_docs`` rows, dealt by a hash of the row's id and length, are packed side by side. That is so
at every size: a table of fewer rows is one shard. What is lost against one packing of everything is
the few part-filled bins at each shard's end (the README has measured figures).

Defined cases: a document longer than the largest length is cut into pieces of that length and a
rest; one without tokens (null or not positive) takes no room and has one row with a null bin; a text
that is null or empty has one token, the end id; repeated rows are packed as often as they occur; a
null doc_id is packed like any other, dealt by its length; ties go by doc_id; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
SHARD_DOCS = 16_384


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in falling order of length (each of 1 to the largest capacity): the bin of each and
    its start there; and the final capacity of each bin."""
    sizes = sorted(capacities)
    cost = {c: overhead + c + c * c / (4 * sizes[-1]) for c in sizes}
    largest = sizes[-1]
    held = np.bincount(lengths, minlength=largest + 1) * np.arange(largest + 1)
    up_to = np.cumsum(held).tolist()  # tokens in pieces of at most each length
    left = int(up_to[-1])
    rooms: list[list[int]] = [[] for _ in range(largest + 1)]  # open bins by their room
    mask = 0  # bit r: there is an open bin with room r
    bins, starts, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        left -= n
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: (cost[c] / (n + min(c - n, left if c - n >= n else min(left, up_to[c - n]))), c))
            b = len(used)
            used.append(0)
        bins[i], starts[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bins, starts, final


def pack(df: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, doc_id: str = "doc_id", n_tokens: str = "n_tokens", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, doc_start, n_tokens of the piece, bin_id, bin_start, bin_used, bin_capacity."""
    kind = df.schema[doc_id].dataType.simpleString()
    rows = stored(df.select(doc_id, F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("n")))
    shards = max(1, -(-rows.count() // shard_docs))
    # Null ids and repeated ones don't meet in one shard: the length and a row's own place deal them too.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col(doc_id), F.col("n"), F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())), F.lit(shards)))
    largest = max(capacities)
    names = [doc_id, "piece", "doc_start", "n_tokens", "bin_id", "bin_start", "bin_used", "bin_capacity"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(doc_id, "ascending"), ("n", "ascending")])
        n = np.maximum(np.asarray(t.column("n"), np.int64), 0)
        pieces = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(largest, n[row] - nth * largest)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        bins, starts, final = best_fit(length[order], capacities, overhead)
        used = np.bincount(bins, weights=length[order], minlength=len(final)).astype(np.int64)
        empty = length <= 0
        out = {c: np.zeros(len(row), np.int64) for c in ("bin_id", "bin_start", "bin_used", "bin_capacity")}
        shard = t.column("shard")[0].as_py() if t.num_rows else 0
        out["bin_id"][order], out["bin_start"][order] = shard << 32 | bins, starts
        out["bin_used"][order], out["bin_capacity"][order] = used[bins], final[bins]
        give_back()
        columns = [t.column(doc_id).combine_chunks().take(pa.array(row)), pa.array(nth), pa.array(nth * largest), pa.array(length)]
        return pa.table([*columns, *(pa.array(x, mask=empty) for x in out.values())], names=names)

    longs = ", ".join(f"{c} long" for c in names[1:])
    return rows.groupBy("shard").applyInArrow(run, f"`{doc_id}` {kind}, {longs}")


def pack_texts(docs: DataFrame, path: str, capacities: tuple[int, ...] = CAPACITIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack documents by their numbers of ids (with an end id) under a tokenizer file."""
    from .token_files import lengths

    return pack(lengths(docs, path), capacities, shard_docs=shard_docs)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
