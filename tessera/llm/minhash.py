"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find groups.

A document's set holds its distinct 5-word shingles (with fewer words, the whole sequence as one).
SuperMinHash gives each element a random permutation of ranks; slot p of a signature is the least
rank-plus-fraction that any element has there, and elements stop early once no later rank can be
least. BANDS bands of ROWS slots each make candidates: documents at similarity 0.75 share no band
with a probability of 5e-6. Links are confirmed on the full sets.

Equal sets are one class from the start, so copies are never compared. In each bucket of a band the
classes are compared with its smallest one, then, where that leaves several groups, with its largest
one. Links found so far join groups, and only classes of different groups are compared after that:
those outside a bucket's largest group with that group and with each other, each pair in the first
bucket that both share, and only where bitmaps of both sets (an exact bound) allow the similarity.
So no link that could join two groups is left out, and a bucket of near copies doesn't become all its
pairs. What a bucket holds is aggregated before it is dealt out; a comparison's texts are dealt by
the other side and a salt, so that a group of them holds about SHINGLES shingles.

Defined cases: a text without words (null, empty, white space) has an empty set, no links and its own
component; a row with a null doc_id is linked with nothing, has a null component and is kept; rows
that share a doc_id have the component of their own text each, and the links of both where that id is
the smallest of both texts' classes; repeated rows are copies of each other; extra columns are not
read (``one_of_each`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, give_back, kept, mixed, n_partitions, sliced, small_batches, stored, table, tidy

SHINGLE = 5
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Words of 64 bits in the bitmap of a set.
WORDS = 16
MAPS = [f"w{k}" for k in range(WORDS)]
#: Shingles that one group of comparisons reads, about.
SHINGLES = 400_000
GOLDEN = 0x9E3779B97F4A7C15
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0xB492B66FBE98F273
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i under n; the first ones are kept by the worker."""

    def make(m: int) -> list[np.ndarray]:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out

    up, down = kept(("powers",), lambda: make(1 << 20)) if n <= 1 << 20 else make(n)
    return up[:n], down[:n]


def word_hashes(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z in lower case, and how many words come before each document."""
    lower = flat + ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[bounds[:-1][bounds[:-1] < len(flat)]] = inside[bounds[:-1][bounds[:-1] < len(flat)]]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(flat) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[lower] * up[: len(flat)], dtype=np.uint64)])
    h = mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.searchsorted(start, bounds)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    flat, bounds = flat_text(column)
    words, at = word_hashes(flat, bounds)
    n = len(words)
    rolled = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(BASE) + words[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mixed(np.array([h], np.uint64) * np.uint64(GOLDEN) + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_min_hash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (documents, SLOTS) of sets that aren't empty; a value is rank << 32 | fraction.

    Round j gives every element of the documents still open its rank j: the slot at place j of the
    element's permutation. That permutation is a Fisher-Yates shuffle made as far as needed: place j
    swaps with a random place of j or later. Early rounds find the slot by following the swaps back;
    later ones, with few elements left, keep the permutations."""
    values = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max)
    if not sets:
        return values
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets)
    swaps: list[np.ndarray] = []
    permutation = None
    for j in range(SLOTS):
        x = mixed(element + np.uint64((j + 1) * GOLDEN & (2**64 - 1)))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j) >> np.uint64(32)).astype(np.int64)
        if permutation is None:
            slot = k.copy()
            for t in range(j - 1, -1, -1):
                slot[slot == swaps[t]] = t
            swaps.append(k)
        else:
            row = np.arange(len(element))
            slot = permutation[row, k].astype(np.int64)
            permutation[row, k] = permutation[row, j]
        np.minimum.at(values.reshape(-1), doc * SLOTS + slot, np.uint64(j << 32) | (x >> np.uint64(32)))
        open_ = values.max(axis=1) >= np.uint64((j + 1) << 32)
        keep = open_[doc]
        if not keep.any():
            break
        if not keep.all():
            doc, element = doc[keep], element[keep]
            swaps = [s[keep] for s in swaps]
            permutation = None if permutation is None else permutation[keep]
        if permutation is None and (j >= 3 and len(element) < 50_000 or j >= 12):
            permutation = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
            row = np.arange(len(element))
            for t, s in enumerate(swaps):
                held = permutation[row, s]
                permutation[row, s] = permutation[row, t]
                permutation[row, t] = held
            swaps = []
    return values


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of each signature."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(BASE) + s[:, :, k])
    return key.view(np.int64)


def described(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null for an empty set), the bands and the bitmap (columns
    MAPS) of every row."""
    t = F.col(text).cast("string")
    source = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.md5(F.coalesce(t, F.lit("")).cast("binary")).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(b.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = dict(zip(full, band_keys(super_min_hash([sets[i] for i in full]))))
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bits = np.zeros((b.num_rows, 64 * WORDS), bool)
            for i in full:
                bits[i, (mixed(sets[i]) % np.uint64(64 * WORDS)).astype(np.int64)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            bands = pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), bands, *(pa.array(words[:, k].copy()) for k in range(WORDS))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands", *MAPS],
            )

    return source.mapInArrow(tidy(run, keeps=True), "doc_id long, text_key string, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{m} long" for m in MAPS))


def alike(s: np.ndarray, o: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, by sizes first."""
    if 100 * min(len(s), len(o)) < percent * max(len(s), len(o)):
        return False
    shared = len(np.intersect1d(s, o, assume_unique=True))
    return 100 * shared >= percent * (len(s) + len(o) - shared)


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, n_a, n_b) those whose texts (id, text) have sets with 100 * intersection >=
    percent * union. Pairs are dealt by b and a salt, so that a group holds about SHINGLES shingles;
    b's text goes to each of its salts."""
    spark = pairs.sparkSession
    total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b")).alias("n")).first()["n"] or 0
    groups = max(n_partitions(spark), -(-total // SHINGLES))
    size = pairs.groupBy("b").agg((F.floor(F.sum("n_a") / SHINGLES) + 1).alias("salts"))
    place = F.pmod(F.xxhash64("b", "salt"), F.lit(groups))
    left = (
        pairs.select("a", "b").join(size, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
        .join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "text", place.alias("group"))
    )
    right = (
        size.join(texts.withColumnRenamed("id", "b"), "b")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(F.col("b").alias("id"), F.col("text").alias("other"), place.alias("group"))
    )

    def check(t: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if t.num_rows and others.num_rows:
            known: dict[int, list[np.ndarray]] = {}  # several where rows share an id
            for batch in sliced(iter(others.to_batches()), "other"):
                for y, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                    known.setdefault(y, []).append(s)
            for batch in sliced(iter(t.to_batches()), "text"):
                for x, y, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2))):
                    if any(alike(s, o, percent) for o in known[y]):
                        a.append(x)
                        b.append(y)
        give_back()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stored(left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(check, "a long, b long"))


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each task replaced by those of a union-find forest over them: node to root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def out() -> pa.RecordBatch:
            nodes = [x for x in parent if parent[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:
                yield out()
                parent.clear()
        yield out()

    return edges.mapInArrow(tidy(run, keeps=True), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) reach from each node they name. Union-find in
    each task, then labels go along the remaining edges and jump to the label's own label until
    nothing changes; every round is a table in shared storage."""
    edges = stored(forest(edges).distinct())
    both = edges.union(edges.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        old = labels.select("node", F.col("label").alias("old"))
        new = stored(least.join(jump, "label", "left").join(old, "node").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return grouped(docs, text, doc_id, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def grouped(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row."""
    rows = stored(described(docs, text, doc_id))
    full = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("bands", "bands"), *((m, m) for m in MAPS)))))
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    # Stored, as below: a join then has a plain exchange on either side, of which Spark splits a hot bucket.
    shared = stored(banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"))
    buckets = stored(banded.join(shared, "key"))
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # Rows that share a doc_id may differ; the class's text is the one with its set, so the key decides.
    texts = stored(keyed_texts(source.join(wanted, "id", "left_semi"), classes.select("rep", "set_key").join(wanted, F.col("rep") == F.col("id"), "left_semi")))

    size_of = buckets.select("rep", "n").distinct()

    def sized(pairs: DataFrame) -> DataFrame:
        """Those whose sizes allow the similarity."""
        a, b = (size_of.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
        return pairs.join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b")

    pairs = stored(sized(buckets.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()))
    labels = components(verified(pairs, texts, percent))
    for step in ("high", "across"):
        members = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        several = stored(members.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 < l2").select("key"))
        members = stored(members.join(several, "key").select("key", "rep", "n", "label", "high"))
        if step == "high":
            found = members.filter("rep <> high").select(F.col("rep").alias("a"), F.col("high").alias("b")).distinct()
        else:
            found = across(members, classes, percent)
        found = stored(sized(found).join(pairs, ["a", "b"], "left_anti"))
        new = verified(found, texts, percent)
        pairs = pairs.union(found)
        if new.limit(1).count():  # components so far stand for their links
            labels = components(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(new))
    of_set = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component_id"))
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(of_set, "set_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def across(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of classes with different labels in buckets (key, rep, n, label). In each
    bucket the classes outside its commonest label meet those of it and one another; a pair comes out
    in the first bucket that both share, and only if sizes and bitmaps allow the similarity."""
    count = members.groupBy("key", "label").agg(F.count("*").alias("held"))
    main = stored(count.groupBy("key").agg(F.max_by("label", F.struct("held", "label")).alias("main")))
    rows = stored(members.select("key", "rep", "n", "label").join(main, "key").join(classes.select("rep", "bands", *MAPS), "rep"))
    one, big, rest = (rows.filter(f"label {x} main").alias(y) for x, y in (("<>", "one"), ("=", "two"), ("<>", "two")))
    both = F.col("one.n") + F.col("two.n")
    # Bits that differ are at most the shingles that do, so they bound the intersection from above.
    differ = reduce(add, (F.bit_count(F.col(f"one.{m}").bitwiseXOR(F.col(f"two.{m}"))) for m in MAPS))
    first = F.array_position(F.zip_with("one.bands", "two.bands", lambda x, y: x == y), F.lit(True)).cast("int")
    near = (
        (F.col("one.key") == F.col("two.key")) & (100 * F.least("one.n", "two.n") >= percent * F.greatest("one.n", "two.n"))
        & ((both - differ) * (100 + percent) >= 2 * percent * both) & (F.element_at("one.bands", first) == F.col("one.key"))
    )
    pairs = one.join(big, near).select("one.rep", F.col("two.rep").alias("other"))
    pairs = pairs.union(one.join(rest, near & (F.col("one.label") < F.col("two.label"))).select("one.rep", F.col("two.rep").alias("other")))
    return pairs.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()


def keyed_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id, text: for each class (rep, set_key) one text of that id whose set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            right = [bool(len(s)) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(shingle_sets(b.column(1)), b.column(2).to_pylist())]
            at = pa.array(np.flatnonzero(right), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["id", "text"])

    return texts.join(keys.select(F.col("rep").alias("id"), "set_key"), "id").select("id", "text", "set_key").mapInArrow(tidy(run, keeps=True), "id long, text string")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of its rows with the smallest doc_id the
    one with the least key of its text. Rows with a null doc_id and rows without words are in no group
    and stay. Where a row that stays is repeated (doc_id and text), its least row stays."""
    found = grouped(docs, text, doc_id, percent).filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n"))
    found = stored(found)
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    judged = stored(found.join(first, "component_id").select("doc_id", "text_key", (F.struct("doc_id", "text_key") == F.col("first")).alias("stays"), "n"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__key": F.md5(t.cast("binary"))})
    on = lambda d: (known["__id"] == d["doc_id"]) & (known["__key"] == d["text_key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = judged.filter("stays AND n > 1")
    gone = judged.filter("NOT stays OR n > 1").select("doc_id", "text_key")
    out = known.join(gone, on(gone), "left_anti").select(*columns)
    repeated = known.join(several, on(several), "left_semi").groupBy("__id", "__key").agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*")
    return out.unionByName(repeated)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: With fewer than 5 words the whole sequence is the one shingle.
OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 75 * (p.n + q.n - both_)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""
