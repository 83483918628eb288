"""Line dedup by a tree of log templates.

A line's tokens lie between white space; tokens with a digit are variable fields. The tree has fixed
depth: a line goes to the leaf of its number of tokens and its leading tokens. In a leaf, lines that
agree in enough positions share a template, whose other positions become variable fields. A template
found in ``least_docs`` documents or more recurs, and its lines are dropped everywhere but in the
document with the smallest id.

Lines travel as hashes; only the lines of leaves that hold several different ones are read as text,
once each. Counts by (template, document) are aggregated before they are dealt out, so a line that
stands in a third of all documents is one row for each task. A leaf is one task at every size, as its
lines are taken one after the other; where more than ``crowded`` different lines meet, an index finds
the templates a line may join, with the same result. That bounds the time, not the leaf: a task holds
all different lines of its leaf.

Defined cases: lines of fewer than ``least_tokens`` tokens (empty ones too) are never dropped; null
and empty texts stay as they are; a line repeated inside one document counts once, and is dropped as
often as it stands there; repeated doc_ids count as one document and lose the same lines; with a
null doc_id a row neither counts nor loses lines; all columns of the input are kept, extra ones too,
and only the text changes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored, table, tidy

DIGIT = re.compile(r"\d")
FIELD = "<*>"


def masked(line: str) -> list[str]:
    tokens = line.split()
    return [FIELD if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_key(tokens: list[str]) -> int:
    return number(*tokens)


def leaf_key(tokens: list[str], depth: int) -> int:
    return number(str(len(tokens)), *tokens[:depth])


class TemplateIndex:
    """Templates by their token at each place, apart by how many variable fields they have, so that a
    line meets every template it may join without a look at the others."""

    def __init__(self, length: int, words: int, alike: float):
        self.length, self.words, self.alike = length, words, alike
        self.held: dict[int, dict[int, list[int]]] = {}
        self.fields: dict[int, int] = {}

    def keys(self, line: np.ndarray) -> list[int]:
        places = np.flatnonzero(line)
        return (places * self.words + line[places]).tolist()

    def put(self, k: int, template: np.ndarray) -> None:
        """A new template, or one that has more variable fields now: what it left behind is passed over."""
        keys = self.keys(template)
        self.fields[k] = self.length - len(keys)
        own = self.held.setdefault(self.fields[k], {})
        for p in keys:
            own.setdefault(p, []).append(k)

    def near(self, line: np.ndarray) -> np.ndarray:
        """All templates the line may join: one with ``least`` equal tokens has one of them at any
        len(keys) - least + 1 places, so the places with the rarest tokens are enough."""
        keys, found = self.keys(line), set()
        for fields, own in self.held.items():
            least = math.ceil(self.alike * max(self.length / 2, len(keys) - fields) - 1e-9)
            for some in sorted((own.get(p, ()) for p in keys), key=len)[: max(0, len(keys) - least + 1)]:
                found.update(k for k in some if self.fields[k] == fields)
        return np.array(sorted(found), np.int64)


def templates(at: np.ndarray, order: list[int], alike: float, crowded: int) -> np.ndarray:
    """The template of each line of one leaf (a row of token numbers each, 0 for a variable field).
    Lines come by ``order``; each joins the template with most equal tokens, if these are the share
    ``alike`` at least (variable fields don't count as equal, nor as different), and else begins a
    new one. More than ``crowded`` lines are held against an index, with the same result."""
    known, of, n = np.zeros_like(at), np.zeros(len(at), np.int64), 0
    index = TemplateIndex(at.shape[1], int(at.max()) + 1, alike) if len(at) > crowded else None
    for i in order:
        line = at[i]
        which = index.near(line) if index else np.arange(n)
        if len(which):
            held = known[which] if index else known[:n]
            same = ((held == line) & (line != 0)).sum(axis=1)
            free = ((held == 0) | (line == 0)).sum(axis=1)
            share = same / np.maximum(at.shape[1] - free, 1)
            share[same < alike / 2 * at.shape[1]] = 0
            best = int(share.argmax())
            if share[best] >= alike:
                of[i] = k = int(which[best])
                other = (known[k] != line) & (known[k] != 0)
                if other.any():
                    known[k][other] = 0
                    if index:
                        index.put(k, known[k])
                continue
        known[n], of[i] = line, n
        if index:
            index.put(n, line)
        n += 1
    return of


def coded(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines of equal length as rows of token numbers (0 for a variable field), and as ranks of their tokens."""
    words = tokens.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    rank = np.empty(len(names), np.int32)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names), dtype=np.int32)
    number = np.array([0 if x == FIELD else i + 1 for i, x in enumerate(names)], np.int32)
    at = words.indices.to_numpy().reshape(len(tokens), -1)
    return number[at], rank[at]


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_docs: int = 3, least_tokens: int = 4, depth: int = 3, alike: float = 0.8, crowded: int = 2000) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped, and no other change."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    source = small_batches(docs).filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            at, leaves, keys = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                seen = set()
                for line in t.split("\n"):
                    tokens = masked(line)
                    if len(tokens) >= least_tokens and (key := line_key(tokens)) not in seen:
                        seen.add(key)
                        at.append(i)
                        leaves.append(leaf_key(tokens, depth))
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(leaves, pa.int64()), pa.array(keys, pa.int64())], names=["id", "leaf", "line"])

    held = stored(source.mapInArrow(tidy(read), f"id {id_type}, leaf long, line long"))
    lines = held.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("different"), F.sum("n").alias("n_leaf")).filter((F.col("different") > 1) & (F.col("n_leaf") >= least_docs))
    wanted = lines.join(leaves, "leaf").groupBy("first").agg(F.collect_list(F.struct("line", "n")).alias("wanted"))
    texts = source.join(wanted, source["id"] == wanted["first"]).select("text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            keys, groups, found, counts = [], [], [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                open_ = {w["line"]: w for w in want}
                for line in t.split("\n"):
                    tokens = masked(line)
                    if len(tokens) >= least_tokens and (w := open_.pop(line_key(tokens), None)):
                        keys.append(w["line"])
                        groups.append(leaf_key(tokens, depth))
                        found.append(tokens)
                        counts.append(w["n"])
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=["leaf", "line", "tokens", "n"])

    def group(t: pa.Table) -> pa.Table:
        t = t.take(np.unique(t.column("line").to_numpy(), return_index=True)[1])  # a repeated doc_id gives its lines twice
        keys = t.column("line").to_numpy()
        at, rank = coded(t.column("tokens").combine_chunks())
        order = np.lexsort([*rank.T[::-1], -t.column("n").to_numpy()]).tolist()
        of = templates(at, order, alike, crowded)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, of, keys)
        return pa.table([pa.array(keys, pa.int64()), pa.array(least[of], pa.int64())], names=["line", "template"])

    several = texts.mapInArrow(tidy(fetch), "leaf long, line long, tokens array<string>, n long").groupBy("leaf").applyInArrow(group, "line long, template long")
    several = stored(several.filter("line <> template"))
    each = held.select("id", "line").join(several, "line", "left").select("id", "line", F.coalesce("template", "line").alias("template"))
    # Stored, so that the join has a plain exchange on either side and Spark can split a common template.
    recurring = stored(each.select("template", "id").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= least_docs))
    dropped = each.join(recurring, "template").filter("id <> first").groupBy(F.col("id").alias("__id")).agg(F.collect_set("line").alias("__lines"))
    joined = docs.withColumn(text, F.col(text).cast("string")).join(dropped, docs[doc_id] == F.col("__id"), "left").drop("__id")

    columns_out, where = docs.columns, docs.columns.index(text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            new = []
            for t, drop in zip(b.column(where).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if drop and t is not None:
                    drop = set(drop)
                    t = "\n".join(x for x in t.split("\n") if len(m := masked(x)) < least_tokens or line_key(m) not in drop)
                new.append(t)
            columns = list(b.columns[:-1])
            columns[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=columns_out)

    return joined.mapInArrow(tidy(remove), docs.withColumn(text, F.col(text).cast("string")).schema)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's id with the sizes before and after and a digest of what is left."""
    docs = table(spark, sf_dir, "documents")
    out = drop_lines(docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")))
    return out.select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
