"""Token ids in compact files: frequency-ranked ids, byte-aligned lengths, control bytes apart.

``encode`` tokenises whole texts with the tokenizers library; ``write`` ranks ids by their
frequency in the whole corpus, so that common ids take one byte, and writes a folder: ``blocks`` of
documents in ascending doc_id order, and ``ranks``, the table of ids by rank. ``read`` needs nothing
but that folder.

A block holds the ranks of its ids, little-endian in 1 to 4 bytes, one after the other (``data``),
and for each four ids one control byte of four 2-bit lengths (``control``). Decoding looks the
lengths up in a table of 256 rows, and the ids in the rank table.

Defined cases: a null text is an empty one (its only id is the end id); an empty table gives no
blocks and no rows; repeated doc_ids are kept, in the order of their ids' bytes; a null doc_id comes
first; other columns are not read. An id costs at most 4 bytes, so ids must be under 2**32.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, flat_text, folded, kept, n_partitions, own_path, sliced, small_batches, stored, stretches, table, tidy

#: Ids in a block before it is closed (a longer document has a block of its own).
BLOCK_IDS = 1 << 18

#: Kinds of bytes: white space, letters (ASCII and the bytes of others), digits, the rest.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(9, 14), 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What the tokenizer's own rules make one piece each (runs of letters in lower case, digits, runs
    of other characters), dictionary-encoded, and how many come before each text. That holds for ASCII
    and the letters U+00C0-U+00FF; a stretch between white space that holds anything else, or an
    apostrophe, or the beginning of a special token, is one piece as it stands."""
    flat, bounds = flat_text(column)
    low = folded(flat)
    kind = KIND[low]
    ink = kind > 0
    wide = low >= 0x80
    odd = low == 0x27
    if wide.any():
        lead, tail = np.zeros(len(low), bool), np.zeros(len(low), bool)
        lead[:-1] = (low[:-1] == 0xC3) & wide[1:] & (low[1:] != 0x97) & (low[1:] != 0xB7)
        tail[1:] = lead[:-1]
        odd |= wide & ~lead & ~tail
    odd[:-1] |= (flat[:-1] == 0x3C) & (flat[1:] == 0x7C)  # <|
    edge = np.zeros(len(flat) + 1, bool)
    edge[bounds] = True
    edge = edge[:-1]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = ~ink[:-1]
    word = ink & (fresh | edge)
    change = np.ones(len(flat), bool)
    change[1:] = kind[1:] != kind[:-1]
    start = ink & (change | edge | (kind == 2))
    if odd.any():
        nth = np.cumsum(word) - 1
        strange = np.zeros(int(nth[-1]) + 1 if len(nth) else 0, bool)
        strange[nth[odd]] = True
        whole = strange[nth] & ink
        start &= ~whole | word
        low = np.where(whole, flat, low)
    at = np.flatnonzero(start)
    return stretches(low, ink, at), np.searchsorted(at, bounds)


class PieceEncoder:
    """The library's tokenizer over pieces. For a tokenizer that drops white space, lower-cases and
    splits as ``pieces`` does, a text's ids are those of its pieces, so each different piece is encoded
    once and remembered (within a bound of bytes)."""

    def __init__(self, path: str, remembered: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.last = np.zeros(max(vocab.values(), default=-1) + 1, bool)  # ids that end a piece
        self.kind = np.dtype(id_type(path))
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known = Memory(remembered)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The bytes of each piece's ids. Many pieces go as one text, which is cut where an id ends a
        piece; if that doesn't give as many, each goes by itself."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) and ids.max() < len(self.last) else []
        if len(ends) == len(words) and len(words):
            raw, cut = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            return [raw[a:b] for a, b in zip([0, *cut], cut)]
        return self.one_by_one(words)

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def of(self, words: list[bytes]) -> list[bytes]:
        known, older = self.known, self.known.older
        found = list(map(known.get, words))
        new = []
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = older.get(w)
                if found[i] is None:
                    new.append(i)
                else:
                    known.keep(w, found[i])
        odd = [i for i in new if not words[i].isascii() or b"'" in words[i] or b"<|" in words[i]]
        plain = sorted(set(new).difference(odd))
        for some, size, way in ((plain, 4096, self.encoded), (odd, 1024, self.one_by_one)):
            for s in range(0, len(some), size):
                at = some[s : s + size]
                for i, x in zip(at, way([words[i] for i in at])):
                    found[i] = known.keep(words[i], x)
        return found

    def sizes(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        coded, before = pieces(column)
        size = np.fromiter(map(len, self.of(coded.dictionary.to_pylist())), np.int64) // self.kind.itemsize
        total = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
        return np.diff(total[before])

    def many(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each with the end id, and the number of each."""
        coded, before = pieces(column)
        words, at = self.of(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(words), self.kind)
        size = np.fromiter(map(len, words), np.int64, len(words)) // self.kind.itemsize
        first = (np.cumsum(size) - size)[at]
        size = size[at]
        stop = np.cumsum(size)
        ids = flat[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        count = np.diff(np.concatenate([[0], stop])[before])
        return np.insert(ids, np.cumsum(count), end_id) if len(count) else ids, count + 1


def id_type(path: str) -> str:
    """Little-endian unsigned numbers of 16 bits where all ids of a vocabulary file fit, else of 32."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)
    return "<u2" if most < 1 << 16 else "<u4"


def encoder(path: str) -> PieceEncoder:
    return kept(("pieces", path), lambda: PieceEncoder(path))


def encode(df: DataFrame, path: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ``ids`` (binary, of ``id_type``): the ids of the whole text, then
    ``end_id``, which must fit. Narrow."""
    source = small_batches(df).select(doc_id, F.col(text).cast("string").alias("__text"))
    kind = source.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in sliced(batches, "__text", 4 << 20):
            ids, count = e.many(b.column(1), end_id)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), binary(ids, count)], names=[doc_id, "n_tokens", "ids"])

    return source.mapInArrow(tidy(run, keeps=True), f"`{doc_id}` {kind}, n_tokens long, ids binary")


def lengths(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens, the number of ids with an end id; the ids themselves aren't put together."""
    source = small_batches(df).select(doc_id, F.col(text).cast("string").alias("__text"))
    kind = source.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in sliced(batches, "__text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.sizes(b.column(1)) + 1, pa.int64())], names=[doc_id, "n_tokens"])

    return source.mapInArrow(tidy(run, keeps=True), f"`{doc_id}` {kind}, n_tokens long")


def binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Rows of ``count`` values each as binary."""
    ends = np.concatenate([[0], np.cumsum(count)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def values_of(counts: pa.Array, column: pa.Array) -> np.ndarray:
    """All ids of the columns n_tokens and ids of ``encode``: their number says how wide they are."""
    raw, n = flat_text(column)[0], pa.compute.sum(counts).as_py() or 0
    return raw.view("<u4" if len(raw) == 4 * n else "<u2") if n else np.zeros(0, "<u4")


def ranks(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole table, ties to the smaller id. What reaches the
    driver is one count for each id of the vocabulary that occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            more = np.bincount(values_of(b.column(0), b.column(1)))
            total, less = (total, more) if len(total) >= len(more) else (more, total)
            total[: len(less)] += less
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    found = encoded.select("n_tokens", "ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of values under 2**32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[start]
    for k in (1, 2, 3):
        longer = size > k
        out[longer] |= raw[start[longer] + k] << np.uint32(8 * k)
    return out


def write(encoded: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write a table of ``encode`` to the folder ``path``: ``ranks`` (rank, id), and ``blocks`` in
    ascending doc_id order (part int, block int, first long: ids of the part before the block, doc_ids,
    counts, control, data). ``encoded`` is read twice."""
    spark = encoded.sparkSession
    by_rank = ranks(encoded)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    kind = encoded.schema[doc_id].dataType.simpleString()
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    laid = (
        encoded.repartitionByRange(n_partitions(spark), doc_id)
        .sortWithinPartitions(doc_id, "ids")
        .select(F.spark_partition_id().alias("part"), doc_id, "n_tokens", "ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block, first, part = [], 0, 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal held, size, block, first
            flat = np.concatenate([values_of(h[1], h[2]) for h in held])
            control, data = pack(rank_of[flat])
            docs, counts = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
            one = pa.array([0, len(docs)], pa.int32())
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(one, docs), pa.ListArray.from_arrays(one, counts), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            held, size, block, first = [], 0, block + 1, first + len(flat)
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "first", "doc_ids", "counts", "control", "data"])

        for b in sliced(batches, "ids"):
            part = b.column(0)[0].as_py()
            rows = b.columns[1:]
            start = 0
            for i, n in enumerate(b.column(2).to_pylist()):
                if size and size + n > BLOCK_IDS:
                    if i > start:
                        held.append([c.slice(start, i - start) for c in rows])
                    yield close()
                    start = i
                size += n
            held.append([c.slice(start) for c in rows])
        if held:
            yield close()

    schema = f"part int, block int, first long, doc_ids array<{kind}>, counts array<long>, control binary, data binary"
    laid.mapInArrow(tidy(run), schema).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """Documents from the folder ``path``: doc_id, start, n_tokens, ``ids_le`` (little-endian unsigned 32 bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    by_rank = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy(np.uint32)  # as long as the vocabulary
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ends = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row for each part: as few as the shuffle has partitions.
    before = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    source = blocks.join(F.broadcast(before), "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "counts", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column(1).slice(i, 1).flatten()
                counts = np.asarray(b.column(2).slice(i, 1).flatten())
                start = np.cumsum(counts) - counts
                ids = by_rank[unpack(b.column(3)[i].as_py(), b.column(4)[i].as_py(), int(counts.sum()))].astype("<u4")
                yield pa.RecordBatch.from_arrays([docs, pa.array(start + b.column(0)[i].as_py()), pa.array(counts), binary(ids, counts)], names=[doc_id, "start", "n_tokens", "ids_le"])

    return source.mapInArrow(tidy(run), f"`{doc_id}` {kind}, start long, n_tokens long, ids_le binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = own_path(spark)
    write(stored(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
