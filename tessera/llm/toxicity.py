"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words: runs of letters in lower case. A text's vector has all its terms that any example
holds, weighted by (1 + log tf) * idf * relevance: idf counts all documents, and relevance is FLOOR
plus how many standard errors a term's log odds of standing in a toxic example lie above even ones,
so that every term counts and those that labels tell apart count more. Examples are a bounded sample
of the labelled rows, by hashed id. They lie in an inverted index: postings of rarer terms are added
up; frequent terms are kept by blocks of examples with the largest weight of each block, which bounds
what a block's examples can still gain, and blocks are completed by falling bound until none can
reach the k-th similarity, so the k nearest are exact. Votes are weighted by similarity and by how
many labelled rows an example stands for, and pulled towards the labelled rows' own rate, which
calibrates the score; the nearest examples come along as evidence.

Defined cases: a text without known terms (null and empty ones too) scores the toxic rate of the
labelled rows; without labelled rows every score is 0; labels other than 0 and 1 and null ones are not
learnt from; a row with several labels is learnt from once for each; repeated rows score alike; ties
between examples go to the smaller id; other columns pass through (``score``, ``predicted`` and
``evidence`` are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, crc_mod, flat_text, folded, give_back, sliced, small_batches, stored, stretches, table, tidy

#: The relevance of a term that labels don't tell apart.
FLOOR = 0.05
#: Weight of the labelled rows' own rate against the similarities of the neighbours.
PULL = 0.2
#: Texts that go through the index together.
QUERIES = 256


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, dictionary-encoded, and how many come before each text. Bytes of other
    alphabets count as letters, those of general punctuation (U+0080-U+00BF, U+2000-U+23FF) don't."""
    flat, bounds = flat_text(column)
    low = folded(flat)
    ink = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    wide = np.flatnonzero(low == 0xC2)
    ink[wide] = False
    ink[wide + 1] = False
    wide = np.flatnonzero(low == 0xE2)
    wide = wide[low[wide + 1] < 0x90]
    for k in range(3):
        ink[wide + k] = False
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    at = bounds[:-1][bounds[:-1] < len(flat)]
    first[at] = ink[at]
    start = np.flatnonzero(first)
    return stretches(low, ink, start), np.searchsorted(start, bounds)


def counted(column: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term, times: every known term of every text once, by row and term."""
    coded, before = words_of(column)
    known = np.fromiter((vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    term = known[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    hit = term >= 0
    width = max(1, len(vocabulary))
    pair, times = np.unique(row[hit] * width + term[hit], return_counts=True)
    return pair // width, pair % width, times


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class BlockMaxIndex:
    """Exact top-k by inner product of sparse vectors with weights of 0 or more, given as (row, term,
    weight) by row and term. Terms in more than ``often`` examples are the frequent ones."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int = 64, often: int = 128):
        self.n, self.block, self.blocks = n, block, -(-n // block)
        held = np.bincount(term, minlength=terms)
        self.frequent = np.full(terms, -1, np.int64)
        common = np.flatnonzero(held > often)
        self.frequent[common] = np.arange(len(common))
        self.dense = np.zeros((self.blocks * block, len(common)))
        is_common = self.frequent[term] >= 0
        self.dense[row[is_common], self.frequent[term[is_common]]] = weight[is_common]
        self.most = self.dense.reshape(self.blocks, block, len(common)).max(axis=1)  # of each block and frequent term
        rare = ~is_common
        order = np.argsort(term[rare], kind="stable")
        self.rows, self.weights = row[rare][order], weight[rare][order]
        self.starts = np.searchsorted(term[rare][order], np.arange(terms + 1))

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries (row, term, weight) the k nearest examples and their similarities, the
        best first; fewer if other examples have none."""
        width = self.blocks * self.block
        if not n or not width:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        where = self.frequent[term]
        rare, often = where < 0, where >= 0
        start = self.starts[term[rare]]
        size = self.starts[term[rare] + 1] - start
        at = ranges(start, size)
        score = np.bincount(np.repeat(row[rare] * width, size) + self.rows[at], np.repeat(weight[rare], size) * self.weights[at], n * width).reshape(n, width)
        query = np.zeros((n, self.dense.shape[1]))
        query[row[often], where[often]] = weight[often]
        bound = (score.reshape(n, self.blocks, self.block).max(axis=2) + query @ self.most.T) * (1 + 1e-12)
        full, top = np.zeros((n, width)), np.zeros((n, k))
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            some = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= top[:, 0]))  # a full top-k isn't reached else
            if len(some):
                own = slice(b * self.block, (b + 1) * self.block)
                found = np.round(score[some, own] + query[some] @ self.dense[own].T, 12)
                full[some, own] = found
                top[some] = np.sort(np.concatenate([top[some], found], axis=1), axis=1)[:, self.block :]
        top = np.sort(top, axis=1)
        out = []
        for i in range(n):
            near = np.flatnonzero((full[i] >= top[i, 0]) & (full[i] > 0))
            near = near[np.lexsort((near, -full[i][near]))][:k]
            out.append((near, full[i][near]))
        return out


@dataclass
class ToxicityModel:
    terms: bytes  # in their order, with spaces between
    weight: np.ndarray  # of each term: idf * relevance
    ids: list
    toxic: np.ndarray
    cut: np.ndarray  # where each example's vector begins in what follows, by term
    term: np.ndarray
    value: np.ndarray
    stands_for: tuple[float, float]  # labelled rows for each example of a label, against the mean
    rate: float
    k: int = 10

    def index(self) -> BlockMaxIndex:
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.cut))
        return BlockMaxIndex(row, self.term.astype(np.int64), self.value, len(self.ids), len(self.weight))

    def vectors(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        return unit(row, (1 + np.log(times)) * self.weight[term], n)

    def score(self, found: np.ndarray, value: np.ndarray) -> float:
        toxic = self.toxic[found] == 1
        up, down = value[toxic].sum() * self.stands_for[1], value[~toxic].sum() * self.stands_for[0]
        return float(min(1.0, max(0.0, (up + PULL * self.rate) / (up + down + PULL))))


def unit(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(row, value * value, n))
    return value / np.where(norm > 0, norm, 1)[row]


def vocabulary_of(terms: bytes) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}


def document_frequencies(texts: DataFrame, terms: bytes, size: int) -> tuple[np.ndarray, int]:
    """In how many of all texts each of ``size`` terms stands, and how many texts there are. Each
    task counts its own texts; what meets is one count for each term and task, what reaches the
    driver one for each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(terms)
        total = np.zeros(size + 1, np.int64)  # the last: texts
        for b in sliced(batches, "text"):
            _, term, _ = counted(b.column(0), vocabulary)
            total[:-1] += np.bincount(term, minlength=size)
            total[-1] += b.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["term", "n"])

    found = texts.mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 1, np.int64)
    total[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return total[:-1], int(total[-1])


def fit(documents: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, most_examples: int = 1500) -> ToxicityModel | None:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic). Bound: about ``most_examples``
    labelled rows of each label, those whose hashed ids come first. idf counts all of ``corpus`` (where
    it isn't given, of ``documents``). Only the examples' rows are joined, by a broadcast of at most
    twice ``most_examples`` ids; texts are never shuffled."""
    small_batches(documents)
    said = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    said = said.groupBy("doc_id", "toxic").agg(F.count("*").alias("n"))
    held = {r[0]: r[1] for r in said.groupBy("toxic").agg(F.sum("n")).collect()}
    if not held:
        return None
    chosen = None
    for c in held:
        some = said.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = stored(chosen.select("doc_id", "toxic"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            coded, before = words_of(b.column(2))
            words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            found = [np.unique(at[s:e], return_counts=True) for s, e in zip(before, before[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[words[i] for i in u] for u, _ in found], pa.list_(pa.binary())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms", "times"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(tidy(read), f"doc_id {kind}, toxic int, terms array<binary>, times array<long>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_pandas(), kind="stable")))
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(got.num_rows), pa.compute.list_value_length(got.column("terms")).to_numpy())
    coded = pa.compute.list_flatten(got.column("terms")).combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    order = pa.compute.array_sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term, times = rank[coded.indices.to_numpy()], pa.compute.list_flatten(got.column("times")).to_numpy()
    order = np.lexsort((term, row))
    row, term, times = row[order], term[order], times[order]
    packed = b" ".join(terms.to_pylist())
    texts = (documents if corpus is None else corpus).select(F.col("text").cast("string").alias("text"))
    df, n = document_frequencies(texts, packed, len(terms))
    weight = np.log((n + 1) / (df + 0.5)) * relevance(*(np.bincount(term[toxic[row] == c], minlength=len(terms)) for c in (1, 0)), *((toxic == c).sum() for c in (1, 0)))
    each = [held.get(c, 0) / max(1, (toxic == c).sum()) for c in (0, 1)]
    mean = sum(held.values()) / got.num_rows
    rate = held.get(1, 0) / sum(held.values())
    cut = np.searchsorted(row, np.arange(got.num_rows + 1))
    model = ToxicityModel(packed, np.maximum(weight, 0), got.column("doc_id").to_pylist(), toxic, cut, term.astype(np.int32), np.zeros(0), (each[0] / mean, each[1] / mean), rate)
    model.value = model.vectors(row, term, times.astype(float), got.num_rows)
    del got, coded, row, term, times, order
    give_back()
    return model


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """From how many of n1 toxic and n0 other examples hold each term: see the module's text."""
    a, b, not_a, not_b = a + 0.5, b + 0.5, n1 - a + 0.5, n0 - b + 0.5
    return FLOOR + np.maximum(0, np.log(a * not_b / (b * not_a)) / np.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b))


def score(df: DataFrame, model: ToxicityModel | None, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if not given), ``score``, ``predicted`` and ``evidence``
    (doc_id as text, similarity and label of the nearest examples). Narrow: no shuffle."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted", "evidence")]
    source, at = beside(df, keep, text)
    kept, source_name = len(keep), source.columns[at]
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", evidence)])
    arrow = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index() if model else None
        vocabulary = vocabulary_of(model.terms) if model else {}
        for b in sliced(batches, source_name):
            said, votes = [], []
            if model:
                row, term, times = counted(b.column(at), vocabulary)
                value = model.vectors(row, term, times, b.num_rows)
                for first in range(0, b.num_rows, QUERIES):
                    n = min(QUERIES, b.num_rows - first)
                    own = slice(*np.searchsorted(row, [first, first + n]))
                    for found, near in index.nearest(row[own] - first, term[own], value[own], n, model.k):
                        said.append(model.score(found, near))
                        votes.append([{"doc_id": str(model.ids[i]), "similarity": v, "toxic": int(model.toxic[i])} for i, v in zip(found.tolist(), near.tolist())])
            else:
                said, votes = [0.0] * b.num_rows, [[]] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(said, pa.float64()), pa.array([int(x >= threshold) for x in said], pa.int32()), pa.array(votes, arrow)], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.filter(crc_mod("doc_id", 4) != 2), labels.filter(crc_mod("doc_id", 4) != 2), corpus=docs)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
