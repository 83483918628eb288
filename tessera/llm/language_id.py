"""Language of whole texts by a byte convolutional network trained in numpy.

Filters of several widths read the bytes of fixed-length windows (a filter of width w is w tables
of 256 rows: the convolution over one-hot bytes), each filter keeps its largest response in the
window, and a softmax over these gives the window's languages. A text's score is the mean over all
its windows, so whole texts are read.

Training draws windows of about ``most_docs`` labelled documents for each language, chosen by a hash of
the id (a documented bound on rows; of these all windows may be drawn); prediction reads text only.

Defined cases: a null text or one without letters is ``und`` with score 0; rows with a null label
are not learnt from; without labelled rows every text is ``und``; repeated rows are predicted alike;
ties go to the first language in alphabetical order; a null doc_id is predicted and, as its crc32
is null, never learnt from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, crc_mod, flat_text, folded, sliced, small_batches, table, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)


@dataclass
class ByteConvNet:
    languages: list[str]
    filters: int = 12
    seed: int = 7
    tables: list[np.ndarray] = field(default_factory=list)  # for each width: (width, 256, filters)
    bias: np.ndarray | None = None
    weight: np.ndarray | None = None
    offset: np.ndarray | None = None

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        f, k = self.filters, len(self.languages)
        self.tables = [r.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(f * len(WIDTHS), np.float32)
        self.weight = r.normal(0, 0.3, (f * len(WIDTHS), k)).astype(np.float32)
        self.offset = np.zeros(k, np.float32)
        self.ready = None  # tables over pairs of bytes, once trained

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width (windows, places, filters); x: uint8 (windows, WINDOW). Filters of a
        width are summed over pairs of bytes, of which a table is kept."""
        if self.ready is None:
            pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)] for t, w in zip(self.tables, WIDTHS)]
            self.ready = pairs
        two = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for t, w, pairs in zip(self.tables, WIDTHS, self.ready):
            n = x.shape[1] - w + 1
            r = np.take(pairs[0], two[:, :n], axis=0)
            for k, p in enumerate(pairs[1:], 1):
                r += np.take(p, two[:, 2 * k : 2 * k + n], axis=0)
            if w % 2:
                r += np.take(t[w - 1], x[:, w - 1 : w - 1 + n], axis=0)
            out.append(r)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([r.max(axis=1) for r in self.responses(x)], axis=1) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x), 0) @ self.weight + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.05) -> None:
        """Batches of windows (uint8) of languages ``y``, drawn by their ``share``."""
        r = np.random.default_rng(self.seed + 1)
        f = self.filters
        params = [*self.tables, self.bias, self.weight, self.offset]
        past = [np.full_like(p, 1e-3) for p in params]
        for at in r.choice(len(x), (steps, batch), p=share / share.sum()):
            xb, yb = x[at], y[at]
            h, where = self.pooled_with_places(xb)
            a = np.maximum(h, 0)
            z = a @ self.weight + self.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            grad = [np.zeros_like(t) for t in self.tables]
            dh = (p @ self.weight.T) * (h > 0)
            rows = np.arange(len(xb))[:, None]
            cols = np.broadcast_to(np.arange(f), (len(xb), f))
            for i, w in enumerate(WIDTHS):
                for j in range(w):
                    np.add.at(grad[i][j], (xb[rows, where[i] + j], cols), dh[:, i * f : (i + 1) * f])
            grad += [dh.sum(axis=0), a.T @ p, p.sum(axis=0)]
            for q, g, m in zip(params, grad, past):
                m += g * g
                q -= rate * g / np.sqrt(m)
        self.ready = None

    def pooled_with_places(self, x: np.ndarray):
        """As ``pooled``, with the place of each largest response and without the pair tables, which change at each step of training."""
        hs, where = [], []
        for t, w in zip(self.tables, WIDTHS):
            n = x.shape[1] - w + 1
            r = np.take(t[0], x[:, :n], axis=0)
            for j in range(1, w):
                r += np.take(t[j], x[:, j : j + n], axis=0)
            p = r.argmax(axis=1)
            where.append(p)
            hs.append(np.take_along_axis(r, p[:, None, :], axis=1)[:, 0])
        return np.concatenate(hs, axis=1) + self.bias, where


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a string column, zero bytes at a text's end, the row of each window and the
    share of its bytes that are text's. An empty text has none."""
    flat, bounds = flat_text(column)
    flat = folded(flat)
    size = np.diff(bounds)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, bounds[1:][row] - start)
    padded = np.concatenate([flat, np.zeros(WINDOW, np.uint8)])
    x = padded[start[:, None] + np.arange(WINDOW)] if len(row) else np.zeros((0, WINDOW), np.uint8)
    x[np.arange(WINDOW) >= length[:, None]] = 0
    return x, row, length


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_docs: int = 300, seed: int = 7) -> ByteConvNet | None:
    """Learn from rows with a label. Bound: about ``most_docs`` documents of each language, by their
    hashed ids; of these every window, some cut short so that short texts are known too. A document
    has the same weight however many windows it has. Nothing else of the texts reaches the driver."""
    rows = small_batches(labelled).filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    unit = (F.xxhash64(F.col(doc_id), F.lit(seed)) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(lang) == k, F.lit(min(1.0, most_docs / n))).otherwise(share)
    chosen = rows.filter(unit < share).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(doc_id).alias("seed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            x, row, length = windows(b.column(1))
            take, langs, share, seeds = [], [], [], b.column(2).to_pylist()
            kept = np.flatnonzero(length > 0)
            for i in np.unique(row[kept]):
                mine = kept[row[kept] == i]
                r = np.random.default_rng(seeds[i] & 0xFFFFFFFF)
                for k in mine:
                    w = x[k].copy()
                    if r.random() < 0.3:
                        w[int(r.integers(12, 120)) :] = 0
                    take.append(w.tobytes())
                    langs.append(b.column(0)[int(i)].as_py())
                    share.append(1 / len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(take, pa.binary()), pa.array(share, pa.float64())], names=["lang", "window", "share"])

    got = chosen.mapInArrow(tidy(cut), "lang string, window binary, share double").toPandas().sort_values(["lang", "window"])
    if not len(got):
        return None
    net = ByteConvNet(sorted(set(got["lang"])), seed=seed)
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    net.fit(x, np.searchsorted(net.languages, got["lang"].to_numpy().astype(str)), got["share"].to_numpy())
    return net


def predict(df: DataFrame, net: ByteConvNet | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if not given), ``lang_pred`` and ``score`` (mean probability
    of that language over all windows of the text, by their length). Columns of these two names in
    ``df`` are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if net is None:
        return df.select(*(F.col(f"`{c}`") for c in keep), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    source, at = beside(df, keep, text, letters)
    kept = len(keep)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, source_name, 1 << 20):
            x, row, length = windows(b.column(at))
            total = np.zeros((b.num_rows, len(net.languages)))
            weight = np.bincount(row, weights=length, minlength=b.num_rows)
            for s in range(0, len(x), 256):
                p = net.probabilities(x[s : s + 256]) * length[s : s + 256, None]
                for k in range(p.shape[1]):
                    total[:, k] += np.bincount(row[s : s + 256], weights=p[:, k], minlength=b.num_rows)
            total /= np.maximum(weight, 1)[:, None]
            best = total.argmax(axis=1)
            weight = weight * np.asarray(b.column(kept))
            said = [net.languages[k] if w else "und" for k, w in zip(best, weight)]
            score = np.clip(np.where(weight > 0, total[np.arange(len(best)), best], 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(said, pa.string()), pa.array(score)], names=schema.names)

    source_name = source.columns[at]
    return source.mapInArrow(tidy(run), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    net = fit(docs.filter(crc_mod("doc_id", 3) != 1))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net, keep=["doc_id", "held_out"])
