"""BPE encoding and decoding of whole texts with a byte-level vocabulary file.

Encoding: a pre-token's symbols form a doubly linked list; a priority queue of
(merge rank, position) yields the next merge, and entries whose symbols have changed
since are stale and skipped. Decoding concatenates the vocabulary's strings.

Defined cases: a null text is an empty one (no ids, decoded ''); strings of special
tokens inside a text are those tokens, as the tokenizers library has it by default;
other columns pass through unread; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory, flat_text, kept, sliced, small_batches, stretches, table, tidy

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for 256, 257, ... in ascending order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder over one vocabulary file; keeps a bounded memory of pieces."""

    def __init__(self, path: str, remembered: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.strings = [b""] * top
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.sizes = np.array([len(x) for x in self.strings], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.strings), np.uint8)
        self.of_byte = [vocab[c] for c in letters]
        self.rank, self.made = {}, []  # of a pair, as left << 32 | right; the id that each rank makes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split = regex.compile(PATTERN)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks, self.pieces = Memory(remembered // 3), Memory(remembered)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. An entry of the queue is rank << 32 | position."""
        ids = [*map(self.of_byte.__getitem__, piece)]
        n, rank, made = len(ids), self.rank.get, self.made
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            top = heapq.heappop(queue)
            i, best = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != best:
                continue  # stale: a neighbour was merged meanwhile
            ids[i], ids[j] = made[best], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank(ids[k] << 32 | ids[i])) is not None:
                heapq.heappush(queue, r << 32 | k)
        return tuple(x for x in ids if x >= 0)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch of text whose ends are bounds of pre-tokens."""
        out: list[int] = []
        for piece in self.split.findall(chunk):
            ids = self.pieces.recall(piece)
            if ids is None:
                ids = self.pieces.keep(piece, self.merged(piece.encode()))
            out += ids
        return tuple(out)

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number of each. A single space always begins a
        pre-token where white space doesn't stand on both sides of it, so texts without that (and without
        special tokens) fall into chunks at their spaces; each different chunk is encoded once and
        remembered. Other texts are encoded one by one."""
        flat, bounds = flat_text(column)
        space = flat == 0x20
        white = space | ((flat >= 0x09) & (flat <= 0x0D)) | ((flat >= 0x1C) & (flat <= 0x1F))
        two, three = flat == 0xC2, (flat >= 0xE1) & (flat <= 0xE3)  # other white space begins with these bytes
        before = np.zeros(len(flat), bool)  # perhaps white space ends here
        before[1:] = two[:-1]
        before[2:] |= three[:-2]
        odd = np.zeros(len(flat), bool)
        odd[1:-1] = space[1:-1] & (white | before)[:-2] & (white | two | three)[2:]
        odd[:-1] |= (flat[:-1] == 0x3C) & (flat[1:] == 0x7C)  # <|, as special tokens begin
        total = np.concatenate([[0], np.cumsum(odd)])
        single = np.flatnonzero(total[bounds[1:]] > total[bounds[:-1]])
        own = np.zeros(len(flat) + 1, np.int64)
        np.add.at(own, bounds[single], 1)
        np.add.at(own, bounds[single + 1], -1)
        alone = np.cumsum(own[:-1]) > 0
        first = space.copy()
        first[bounds[:-1][bounds[:-1] < len(flat)]] = True
        start = np.flatnonzero(first & ~alone)
        coded = stretches(flat, ~alone, start)
        known = self.chunks
        found = []
        for w in coded.dictionary.to_pylist():
            ids = known.recall(w)
            found.append(known.keep(w, self.chunk(w.decode())) if ids is None else ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        every = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        at = coded.indices.to_numpy()
        begin, size = (np.cumsum(size) - size)[at], size[at]
        stop = np.cumsum(size)
        ids = every[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.searchsorted(start, bounds)]
        count = np.diff(ends)
        if len(single):
            apart = [self.encode(column[int(i)].as_py()) for i in single]
            parts, done = [], 0
            for i, x in zip(single.tolist(), apart):
                parts += [ids[done : ends[i]], np.array(x, np.int32)]
                done = ends[i]
                count[i] = len(x)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, count

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.at_special or not self.at_special.search(text):
            return list(self.chunk(text))
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.chunk(part)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The texts that runs of ``count`` ids each stand for: the vocabulary's strings one after the other."""
        size = self.sizes[ids]
        stop = np.cumsum(size)
        raw = self.letters[np.repeat(self.begins[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])].astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that don't make up whole characters
            return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def codec(path: str) -> ByteBpe:
    """The one that this Python worker keeps."""
    return kept(("bytes", path), lambda: ByteBpe(path))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns ``keep``, the ids of ``text`` (array<int>) and, if ``decoded`` names a column,
    the text that decoding those ids gives. Narrow: no shuffle."""
    source = small_batches(df).select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*(source.schema[k] for k in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in sliced(batches, "__text", 4 << 20):
            flat, count = c.many(b.column(b.num_columns - 1))
            columns = [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32()))]
            if decoded:
                columns.append(c.decoded(flat, count))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(tidy(run, keeps=True), T.StructType(fields))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the text that ``ids`` stand for (null ids: '')."""
    source = small_batches(df).select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(tidy(run, keeps=True), schema)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
