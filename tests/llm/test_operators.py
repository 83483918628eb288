"""Operators on documents and vectors: edge cases, brute-force versions, round trips, held-out rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe_codec, catalog, common, exact_search, language_id, line_templates, minhash, packing, suffix_dedup, token_files, toxicity
from tessera.llm.common import stored
from tests.oracle import compare, connected

FOLDER = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOC = "doc_id long, text string, lang string, id long, score double, part int, vector string"
ODD = [
    (1, None, None, None, None, None, None), (2, "", "en", 1, 0.5, 1, "x"), (None, "no id at all, but words enough here", "en", 2, None, 2, None),
    (4, "same text in two rows, long enough to be found as one that repeats", "en", 3, 1.0, 3, "y"), (4, "same text in two rows, long enough to be found as one that repeats", "en", 3, 1.0, 3, "y"),
    (5, "a" * 100_000, "de", 4, 1.0, 4, "z"), (6, "... 12 ---", None, 5, 1.0, 5, "z"), (7, "café <|endoftext|> \x1c\u0085 \n\t  end", "fr", 6, None, 6, None), (8, " \n\t ", "fr", 7, None, 7, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def word(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe_is_the_library_s(spark, odd, none, docs):
    t = tokenizer(BYTE)
    for r in bpe_codec.encode(odd.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True), BYTE, keep=("doc_id", "text"), decoded="decoded").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode(none, BYTE).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(odd.filter("doc_id = 7"), BYTE), BYTE).first()
    assert back.text == ODD[7][1]


def test_bpe_on_random_white_space():
    t, c, r = tokenizer(BYTE), bpe_codec.ByteBpe(BYTE, remembered=2_000), random.Random(2)
    pieces = [" ", "  ", "\n", "\t", "a", "the", "é", "12", "'s", "!", "\x1c", "\u0085", "\xa0", "\u3000", "<|endoftext|>", "<|", "\U0001f642"]
    for _ in range(150):
        texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(20)] + [None, ""]
        wanted = [t.encode(s or "", add_special_tokens=False).ids for s in texts]
        assert [c.encode(s) for s in texts] == wanted
        ids, count = c.many(pa.array(texts))
        ends = np.cumsum(count)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, count)] == wanted
        assert c.decoded(ids, count).to_pylist() == [t.decode(x, skip_special_tokens=False) for x in wanted]
    broken = np.array(t.encode("é\U0001f642", add_special_tokens=False).ids[1:-1], np.int32)
    assert c.decoded(broken, np.array([len(broken)])).to_pylist() == [t.decode(broken.tolist(), skip_special_tokens=False)]


def test_pieces_are_the_library_s():
    t, e, r = tokenizer(WORD), token_files.PieceEncoder(WORD, remembered=5_000), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "The", "É", "é", "ß", "×", "÷", "12", "'s", "'", "''", "!", "\x1c", "\u0085", "\xa0", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "<", "\U0001f642", "e\u0301", "İ", "ΑΣ", "ﬁ", "_", "</w>", "w>", "\x00", "你好", "ªº²", "Ⅷ", "'ll", "don't", "’", "\u3000"]
    for _ in range(100):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(30)] + [None, ""]
        ids, count = e.many(pa.array(texts), 1)
        ends = np.cumsum(count)
        for text, a, b in zip(texts, ends - count, ends):
            assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids + [1], text
        assert (e.sizes(pa.array(texts)) + 1 == count).all()


def test_token_files_round_trip(spark, odd, none, docs, tmp_path):
    t = tokenizer(WORD)
    rows = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 1_000_000, "text").toDF("doc_id", "text"))
    token_files.write(token_files.encode(rows, WORD), path := f"file://{tmp_path}/ids")
    out = token_files.read(spark, path).orderBy("start").collect()
    wanted = sorted(((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (i, ids) in zip(out, wanted, strict=True):
        assert (r.doc_id, r.start, np.frombuffer(r.ids_le, "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    token_files.write(token_files.encode(none, WORD), path := f"file://{tmp_path}/none")
    assert token_files.read(spark, path).count() == 0
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    assert (token_files.unpack(*token_files.pack(v), len(v)) == v).all()
    large = spark.createDataFrame([(1, 2, np.array([70_000, 3_000_000_000], "<u4").tobytes())], "doc_id long, n_tokens long, ids binary")
    token_files.write(large, path := f"file://{tmp_path}/large")  # ids beyond any 16-bit vocabulary
    assert np.frombuffer(token_files.read(spark, path).first().ids_le, "<u4").tolist() == [70_000, 3_000_000_000]


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = catalog.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.95
    net = language_id.fit(odd)
    said = {r.doc_id: r for r in language_id.predict(odd, net).collect()}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (1, 2, 6, 8))
    assert all(0 <= r.score <= 1 for r in said.values()) and language_id.predict(odd, net).count() == len(ODD)
    assert language_id.fit(none) is None and language_id.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_language_id_of_repeated_long_and_clashing_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs)
    text = docs.filter("lang = 'de'").first().text
    rows = spark.createDataFrame([(1, text, "a", 7.0), (2, text, "b", 8.0), (3, (text + " ") * 300, "c", 9.0)], "doc_id long, text string, lang_pred string, score double")
    said = language_id.predict(rows, net).collect()
    assert len({(r.lang_pred, r.score) for r in said[:2]}) == 1 and {r.lang_pred for r in said} == {"de"}
    import corpus_pipeline

    kept = corpus_pipeline.identify_language(spark, docs.limit(100).withColumn("score", F.lit(-1)).withColumn("lang_pred", F.lit("x")), FOLDER)
    assert kept.columns == [*docs.columns, "score", "lang_pred"] and kept.filter("score <> -1 OR lang_pred <> 'x'").count() == 0


def test_block_max_index_is_exact():
    r = np.random.default_rng(0)
    n, v = 300, 40
    w = (r.random((n, v)) < 0.3) * r.random((n, v))
    w[5] = w[17]
    q = (r.random((50, v)) < 0.2) * r.random((50, v))
    q[3], q[4] = 0, w[17]
    row, term = np.nonzero(w)
    index = toxicity.BlockMaxIndex(row, term, w[row, term], n, v, block=8, often=80)
    of, t = np.nonzero(q)
    for i, (found, near) in enumerate(index.nearest(of, t, q[of, t], len(q), 10)):
        s = np.round(w @ q[i], 12)
        exact = [j for j in np.lexsort((np.arange(n), -s)) if s[j] > 0][:10]
        assert found.tolist() == exact and np.allclose(near, s[exact])  # 5 and 17 are a tie


def brute_toxicity(docs, labels, k=10):
    """Plain version: all documents are labelled rows' corpus, all labelled rows are examples."""
    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    text = dict(docs)
    said = sorted((i, y) for i, y in labels if i in text)
    n1 = sum(y for _, y in said)
    n0, of = len(said) - n1, {t for i, _ in said for t in words(text[i])}
    weight = {}
    for t in of:
        df = sum(t in words(x) for x in text.values())
        a, b = (sum(t in words(text[i]) for i, y in said if y == c) + 0.5 for c in (1, 0))
        c, d = n1 - a + 1, n0 - b + 1
        z = math.log(a * d / (b * c)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        weight[t] = max(0, math.log((len(text) + 1) / (df + 0.5)) * (0.05 + max(0, z)))

    def vector(x):
        v = {t: (1 + math.log(words(x).count(t))) * weight[t] for t in set(words(x)) & of}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {t: y / norm for t, y in v.items()} if norm else {}

    examples = [(i, y, vector(text[i])) for i, y in said]
    for i, x in docs:
        q = vector(x)
        near = sorted((-round(sum(w * e.get(t, 0) for t, w in q.items()), 12), j) for j, (_, _, e) in enumerate(examples))
        near = [(-s, j) for s, j in near if s < 0][:k]
        up, down = (sum(s for s, j in near if examples[j][1] == c) for c in (1, 0))
        yield i, (up + 0.2 * n1 / len(said)) / (up + down + 0.2), [(str(examples[j][0]), s, examples[j][1]) for s, j in near]


def test_toxicity(spark, odd, none):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["the", "of", "a", "tree", "house", "Zorb" if i % 3 else "pleb", word(r.randint(0, 30))]) for _ in range(r.randint(0, 30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "nothing known 123"), (203, docs[5][1]), (204, docs[5][1])]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(203, 0), (204, 0)]
    df, said = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score(df.withColumn("score", F.lit(9)), toxicity.fit(df, said)).collect()}
    for i, score, near in brute_toxicity(docs, labels):
        assert out[i].score == pytest.approx(score) and [(e.doc_id, e.toxic) for e in out[i].evidence] == [(a, y) for a, _, y in near]
        assert [e.similarity for e in out[i].evidence] == pytest.approx([s for _, s, _ in near]) and out[i].predicted == int(score >= 0.3)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = catalog.queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out")
    assert out.filter("(toxic = 1) = (predicted = 1)").count() / out.count() > 0.9
    assert out.filter("size(evidence) > 0").count() / out.count() > 0.95
    assert toxicity.fit(odd, none.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert [r.score for r in toxicity.score(odd, None).collect()] == [0.0] * len(ODD)
    marked = toxicity.score(odd, toxicity.fit(odd, odd.select("doc_id", F.lit(1).alias("toxic")))).collect()
    assert [x.score for x in marked] == [1.0] * len(ODD)  # all labels are 1, with neighbours or without
    assert toxicity.score(none, None).count() == 0


def test_toxicity_at_any_number_of_labels(spark):
    rows = [(i, f"some {word(i)} person is a zz{word(i % 50)}" if i < 600 else f"some {word(i)} person is here", int(i < 600)) for i in range(1200)]
    many = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.score(many, toxicity.fit(many.drop("toxic"), many.drop("text"), most_examples=300)).filter("predicted <> toxic").count() == 0
    few = many.filter("doc_id % 100 = 0")
    assert toxicity.score(few, toxicity.fit(few.drop("toxic"), few.drop("text"))).filter("predicted <> toxic").count() == 0


def brute_repeats(rows):
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        yield i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, odd, none, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_HOMES", hot)
    r = random.Random(hot)
    base = ["".join(r.choice("ab cdé") for _ in range(r.randint(40, 300))) for _ in range(8)]
    made = [(r.randint(0, 60), "".join(r.choice(base)[r.randint(0, 40) :] for _ in range(r.randint(0, 4)))) for _ in range(80)]
    rows = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text").limit(60)).unionByName(odd.select("doc_id", "text").filter("length(text) < 1000 OR text IS NULL"))
    found = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup(rows).collect()]
    wanted = list(brute_repeats([(x.doc_id, (x.text or "").encode()) for x in rows.collect()]))
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert suffix_dedup.dedup(none).count() == 0
    clash = odd.withColumns({"kept": F.col("id"), "n_removed": F.lit("r"), "home": F.lit(3), "carry_0": F.lit(4)})
    texts = suffix_dedup.dedup_texts(clash)
    assert texts.columns == clash.columns and texts.schema["doc_id"].dataType == clash.schema["doc_id"].dataType
    assert sorted(map(repr, texts.collect())) == sorted(map(repr, clash.collect()))  # equal rows share a doc_id: nothing goes
    with pytest.raises(ValueError):
        suffix_dedup.dedup(odd.withColumn("doc_id", F.lit("a")))


def shuffled_bytes(df):
    """Of all exchanges of a frame that has been collected, before they are compressed."""
    todo, total, seen = [df._jdf.queryExecution().executedPlan()], 0, set()
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.getClass().getSimpleName() != "ReusedExchangeExec":
            if node.getClass().getSimpleName() == "ShuffleExchangeExec" and node.id() not in seen:
                seen.add(node.id())
                total += node.metrics().apply("dataSize").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_pipeline_s_suffix_dedup_sends_common_passages_once(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(suffix_dedup, "HOME_BYTES", 400)
    r = random.Random(1)
    common, *bodies = (" ".join(word(r.randint(0, 10**6)) for _ in range(n)) for n in [45] + [60] * 720)
    made = [(i, b + common) for i, b in enumerate(bodies)]
    found = corpus_pipeline.drop_repeated_strings(spark, spark.createDataFrame(made, "doc_id long, text string"), "")
    left = {x.doc_id: x.text.encode() for x in found.collect()}
    assert left == {i: kept for i, *_, kept in brute_repeats([(i, t.encode()) for i, t in made])}
    assert 1 < shuffled_bytes(found) / sum(len(t) for _, t in made) < 9


def test_no_text_is_sent_for_phrases_of_20_bytes():
    r = random.Random(3)
    some = ["".join(r.choices("abcdefgh", k=20)) for _ in range(40)]
    made = ["".join(r.choice(some) + f"{r.randrange(10**12):012d}" for _ in range(40)).encode() for _ in range(100)]
    flat, bounds = np.frombuffer(b"".join(made), np.uint8), np.cumsum([0, *map(len, made)])
    h, doc, _, _ = suffix_dedup.anchors(flat, bounds)
    held = Counter(x for x, _ in set(zip(h.tolist(), doc.tolist())))
    assert len(held) > 1000 and max(held.values()) < 5  # 24 bytes with 4 digits meet by chance


def test_suffix_dedup_sends_copies_and_common_passages_once(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOME_BYTES", 600)
    r = random.Random(0)
    common, *bodies = (" ".join(word(r.randint(0, 10**6)) for _ in range(n)) for n in [45] + [140] * 700)
    made = [(i, b[:500] + common + b[500:]) for i, b in enumerate(bodies)]
    made += [(1000 + i, t) for i, t in made[:40]] + [(5, made[9][1]), (None, made[3][1])]
    found = suffix_dedup.dedup(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found.collect()]
    assert sorted(rows, key=repr) == sorted(brute_repeats([(i, t.encode()) for i, t in made]), key=repr)
    assert 1 < shuffled_bytes(found) / sum(len(t) for _, t in made) < 6


def test_suffix_dedup_s_replies_are_one_for_each_group_and_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOME_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "FINE_BYTES", 100)
    whole, seen = suffix_dedup.spans_of_repeats, []
    monkeypatch.setattr(suffix_dedup, "spans_of_repeats", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    r = random.Random(2)
    pool = [" ".join(word(r.randint(0, 10**6)) for _ in range(14)) for _ in range(90)]
    made = [(i, "".join(r.choice(pool)[r.randint(0, 9) :] + word(r.randint(0, 10**6)) for _ in range(16))) for i in range(90)]
    found = suffix_dedup.dedup(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found.collect()]
    assert sorted(rows) == sorted(brute_repeats([(i, t.encode()) for i, t in made]))
    replies = [x.home for x in seen[0].filter("part >= 0").select("home").collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(set(replies)) > 20 and len(replies) <= len(set(replies)) * (n + 1)  # one more for what a group settles by itself


def test_anchors_of_equal_strings_are_equal():
    r = np.random.default_rng(3)
    for n, cut in ((0, 1), (49, 1), (300, 7), (70000, 9), (140000, 300)):
        flat = r.integers(97, 100, n).astype(np.uint8)
        flat[n // 2 :] = flat[: n - n // 2]
        bounds = np.sort(np.concatenate([[0, n], r.integers(0, n + 1, cut)]))
        open_ = r.random(n) < 0.9
        for o in (None, open_):
            h, doc, start, size = suffix_dedup.anchors(flat, bounds, o)
            at = np.concatenate([[0], *(np.arange(a, a + k) for a, k in zip(start, size))]).astype(int)[1:]
            whole = np.concatenate([[0], *(np.arange(a, b - 49) for a, b in zip(bounds, bounds[1:]))]).astype(int)[1:]
            assert at.tolist() == [k for k in whole.tolist() if o is None or o[k]]
            owner = np.repeat(doc, size)
            assert ((bounds[owner] <= at) & (at + 50 <= bounds[owner + 1])).all()
            of = {}
            assert all(of.setdefault(flat[k : k + 50].tobytes(), x) == x for k, x in zip(at.tolist(), np.repeat(h, size).tolist()))


def test_refined_pointers_are_the_order_of_suffixes():
    r = np.random.default_rng(0)
    for _ in range(60):
        n, length = int(r.integers(1, 300)), int(r.integers(9, 60))
        t = r.integers(97, 97 + int(r.integers(1, 4)), n).astype(np.uint8)
        t[n // 2 :] = t[: n - n // 2] if r.random() < 0.5 else t[n // 2 :]
        pointer, whole = suffix_dedup.refined_pointers(t, length), range(max(0, n - length + 1))
        cut = [t[i : i + length].tobytes() for i in whole]
        assert sorted(whole, key=lambda i: (pointer[i], i)) == sorted(whole, key=lambda i: (cut[i], i))
        assert len({(pointer[i], cut[i]) for i in whole}) == len({pointer[i] for i in whole}) == len(set(cut))


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op9_minhash"])
def test_document_sql(spark, name):
    compare(catalog.queries()[name](spark, FOLDER), connected(FOLDER), catalog.oracle_sql()[name])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    """The least id reachable from each row (id, text) over links of rows; None for null ids."""
    sets = [shingles(t) for _, t in rows]
    least = [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return sets, least


def near_copies(r, n):
    """Rows (id, text) with chains of near copies, exact copies, shared ids, null ids and texts without words."""
    base = [[word(r.randint(0, 500)) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word(r.randint(0, 500))
        rows.append((i, " ".join(w)))
    rows += [(n + 1, rows[0][1]), (n + 1, rows[0][1]), (n + 2, rows[0][1].upper()), (None, rows[0][1]), (None, rows[0][1]), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "one two three"), (n + 6, ""), (n + 6, None), (n + 7, " \n"), (n + 8, "x " * 20_000), (n + 9, "x " * 30_000)]
    return rows + [(n + 10, "alone " + word(3)), (n + 10, "a text of its own with the same id as another")]


def test_minhash(spark, odd, none, docs):
    made = near_copies(random.Random(7), 150)
    rows = [(x.doc_id + 1000, x.text) for x in docs.select("doc_id", "text").collect()] + made
    sets, least = brute_groups(rows)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(i, len(s), c, i is None or i == c) for (i, _), s, c in zip(rows, sets, least)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, wanted)) and len({c for c in least if c is not None}) < 350
    said = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(odd).collect()}
    assert said == {(1, 0, 1, True), (2, 0, 2, True), (None, 4, None, True), (4, 10, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True), (8, 0, 8, True)} and minhash.near_duplicates(none).count() == 0


def test_one_of_each(spark, none):
    made = near_copies(random.Random(8), 120)
    rows = [(i, t, k, k % 2 == 0) for k, (i, t) in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, kept boolean")
    sets, least = brute_groups(made)
    wanted, best = [], {}
    for row, s, c in zip(rows, sets, least):
        if c is None or not s:
            wanted.append(row)
        else:
            key = (row[0], hashlib.md5(row[1].encode()).hexdigest())
            if c not in best or (key, row) < best[c]:
                best[c] = key, row
    out = minhash.one_of_each(df)
    assert out.columns == df.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [*wanted, *(x for _, x in best.values())]))
    assert minhash.one_of_each(none).count() == 0


def test_super_min_hash_estimates_similarity():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = minhash.super_min_hash([a, b])
    assert abs((x == y).mean() - 0.6) < 0.15
    one = minhash.super_min_hash([a[:1]])[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(minhash.SLOTS))  # a permutation of the ranks


VECTORS = "vec_id long, embedding array<float>, score long, rank int"


def vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)], 1, 2) for i in range(240)]
    rows += [(240, [0.5] * 8, 1, 2), (241, [0.5] * 8, 1, 2), (241, [0.5] * 8, 1, 2), (300, None, 1, 2), (400, [float("nan")] * 8, 1, 2), (500, [1.0, None] * 4, 1, 2), (600, [], 1, 2), (700, [0.0] * 8, 1, 2), (None, [1.0] * 8, 1, 2), (800, [1.0, 2.0], 1, 2)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "SHARD_ROWS", 50)
    rows, df = vectors(spark)
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v, *_ in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    out: dict = {}
    for x in exact_search.search(df).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.score, x.vec_id))
    for q, v in good:
        if q % 100 == 0:
            assert out[q] == [(s, i) for s, i in sorted(((int(v @ w), i) for i, w in good if i != q), key=lambda p: (-p[0], p[1]))][:10]
    assert exact_search.search(df.limit(0)).count() == 0
    near = [(i, [float(c), float(c) + i / 1e4, 0.0], 1, 2) for i, c in enumerate([-90] * 100 + [0] * 100 + [90] * 100)]  # three far places and many equal rows
    near += [(1000 + i, [5.0, 5.0, 5.0], 1, 2) for i in range(130)]
    out = {}
    for x in exact_search.search(spark.createDataFrame(near, VECTORS)).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.score, x.vec_id))
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v, *_ in near]
    for q, v in good:
        if q % 100 == 0:
            assert out[q] == [(s, i) for s, i in sorted(((int(v @ w), i) for i, w in good if i != q), key=lambda p: (-p[0], p[1]))][:10]
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    assert exact_search.search(huge).first().score == 2**63 - 1


def test_exact_search_sql(spark):
    compare(catalog.queries()["op1_exact_top_k"](spark, FOLDER), connected(FOLDER), catalog.oracle_sql()["op1_exact_top_k"])


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found: dict = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & set(ids[[i for i in np.lexsort((ids, -(x @ x[ids == q][0]))) if ids[i] != q][:20]])) for q in ids[ids % 20 == 0]]
    assert sum(hits) / (20 * len(hits)) >= 0.9
    assert ann.search(vectors(spark)[1]).filter("query_id = 700 OR vec_id = 700").count() == 0
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(df, shortlist=25)  # the estimates decide what is reranked
    assert few.count() == 20 * len(hits) and ann.search(df, shortlist=3).count() == 3 * len(hits)
    again: dict = {}
    for r in few.collect():
        again.setdefault(r.query_id, set()).add(r.vec_id)
    assert 0.6 < sum(len(again[q] & found[q]) for q in found) / (20 * len(found)) < 1


def test_ann_of_small_tables_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 40)  # lists of several parts
    rows, df = vectors(spark)
    rows += [(i, [0.5] * 8, 1, 2) for i in range(900, 960)]  # a vector that many rows have
    df = spark.createDataFrame(rows, VECTORS)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out: dict = {}
    for x in ann.search(df, probed=1.0).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.vec_id, x.score))
    asked = {i for i, _ in good if i % 20 == 0}
    assert set(out) == asked
    for q, v in good:
        if q in asked:
            best = sorted(((float(w @ v), i) for i, w in good if i != q), key=lambda p: (-round(p[0], 9), p[1]))[:20]
            assert [i for i, _ in out[q]] == [i for _, i in best] and [s for _, s in out[q]] == pytest.approx([s for s, _ in best])
    assert ann.laid_out([10, 30, 100, 5, 40]) == ([0, 0, 1, 4, 5], [1, 1, 3, 1, 1])


def plain_packing(lengths, sizes, overhead):
    """Best fit by looking at every open bin; of bins with equal room the one that got it last."""
    cost = lambda c: overhead + c + c * c / (4 * sizes[-1])
    held, bins, clock = [], [], 0
    for i, n in enumerate(lengths):
        rest = lengths[i + 1 :]
        fits = [(h["room"], -h["at"], b) for b, h in enumerate(held) if h["room"] >= n]
        if fits:
            b = min(fits)[2]
        else:
            all_of = lambda c: sum(x for x in rest if x <= c - n) if c - n < n else sum(rest)
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + min(c - n, all_of(c))), c))
            b = len(held)
            held.append({"room": size, "used": 0, "at": 0})
        clock += 1
        held[b]["room"] -= n
        held[b]["used"] += n
        held[b]["at"] = clock
        bins.append(b)
    return bins, [min(c for c in sizes if c >= h["used"]) for h in held]


def test_packing_of_texts(spark, odd, none):
    t = tokenizer(WORD)
    clash = odd.withColumns({"n": F.lit(1), "n_tokens": F.lit("x"), "shard": F.lit(2), "bin_id": F.lit(5)})
    out = packing.pack_texts(clash, WORD).collect()
    wanted = [(i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x, *_ in ODD]
    total: dict = {}
    for x in out:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
        assert x.bin_start + x.n_tokens <= x.bin_used <= x.bin_capacity and x.bin_capacity in packing.CAPACITIES
    counts: dict = {}
    for i, n in wanted:
        counts[i] = counts.get(i, 0) + n
    assert total == counts and total[1] == total[2] == total[8] == 1  # null, empty, white space: the end id
    assert packing.pack_texts(none, WORD).count() == 0
    many = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 300).alias("n_tokens"))
    assert packing.pack(many, shard_docs=50).filter("bin_id IS NOT NULL").select((F.col("bin_id") / 2**32).cast("int")).distinct().count() > 5


def test_packing(spark, none):
    r = np.random.default_rng(3)
    n = np.sort(r.integers(1, 4097, 600))[::-1]
    bins, starts, final = packing.best_fit(n)
    room = {}
    for b, s, k in zip(bins, starts, n):  # pieces lie one after the other
        assert s == room.get(b, 0)
        room[b] = s + k
    assert all(room[b] <= final[b] and final[b] == min(c for c in packing.CAPACITIES if c >= room[b]) for b in room)
    assert n.sum() / final.sum() > 0.97
    for seed in range(20):  # against a plain version
        r = np.random.default_rng(seed)
        n = np.sort(r.integers(1, 200, 80))[::-1]
        sizes = (32, 64, 128, 256)
        bins, _, final = packing.best_fit(n, sizes, 8)
        wanted, ends = plain_packing(n.tolist(), sizes, 8)
        assert bins.tolist() == wanted and final.tolist() == ends
    df = spark.createDataFrame([(1, 10_000, 0), (2, 0, 0), (3, None, 0), (None, 5, 0), (4, 7, 0), (4, 7, 0)], "doc_id long, n_tokens long, bin_id int")
    out = packing.pack(df).collect()
    assert sorted(x.n_tokens for x in out if x.doc_id == 1) == [1808, 4096, 4096] and sum(x.n_tokens for x in out) == 10_019
    assert all(x.bin_id is None for x in out if x.doc_id in (2, 3)) and sum(x.doc_id == 4 for x in out) == 2
    assert packing.pack(df.limit(0)).count() == 0


def test_line_templates(spark, odd, none):
    line = "User %d logged in from the main office today"
    rows = [(i, f"unique words of document number {'abcdefgh'[i]} stand here\n{line % i}\nshort line\nAll rights reserved by us", "keep", i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, n int")
    out = {x.doc_id: x for x in line_templates.drop_lines(df, alike=0.95).collect()}
    assert out[0].text == rows[0][1] and all("logged" not in out[i].text and "rights" not in out[i].text and "short line" in out[i].text and "unique" in out[i].text for i in range(1, 6))
    assert all(x.line == "keep" for x in out.values())
    alike = [(i, f"the quick brown fox jumps over the lazy {w} again and again") for i, w in enumerate(["dog", "cat", "cow", "hen"])]
    kept = line_templates.drop_lines(spark.createDataFrame(alike, "doc_id long, text string")).filter("text <> ''").collect()
    assert [x.doc_id for x in kept] == [0]
    out = line_templates.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and line_templates.drop_lines(none).count() == 0


def test_line_templates_in_a_crowded_leaf(spark):
    rows = [(i, f"Posted by user {word(i)} from the main office today") for i in range(2001)]
    kept = line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("text <> ''").collect()
    assert [x.doc_id for x in kept] == [0]
    for seed, length in ((1, 4), (2, 9), (3, 20)):
        r = np.random.default_rng(seed)
        base = r.integers(0, 6, (40, length), np.int32)
        at = base[r.integers(0, 40, 1500)]
        at[r.random(at.shape) < 0.12] = 0
        other = r.random(at.shape) < 0.12
        at[other] = r.integers(1, 60, other.sum())
        at = np.unique(at, axis=0)
        order = r.permutation(len(at)).tolist()
        for alike in (0.5, 0.8, 0.95):
            assert np.array_equal(line_templates.templates(at, order, alike, 0), line_templates.templates(at, order, alike, len(at)))


def plain_drop(rows, least_docs=3, least_tokens=4, depth=3, alike=0.8):
    """The line dedup in plain Python, over rows (id, text)."""
    mask = lambda line: tuple("<*>" if re.search(r"\d", t) else t for t in line.split())
    where: dict = {}
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else ():
            if len(mask(line)) >= least_tokens:
                where.setdefault(mask(line), set()).add(i)
    leaves: dict = {}
    for line in where:
        leaves.setdefault((len(line), line[:depth]), []).append(line)
    of = {}
    counted = {}
    for i, text in rows:
        for line in {mask(x) for x in (text or "").split("\n")} if i is not None else ():
            counted[line] = counted.get(line, 0) + 1
    for lines in leaves.values():
        if len(lines) < 2 or sum(counted[x] for x in lines) < least_docs:
            of.update((x, x) for x in lines)
            continue
        known: list = []
        for line in sorted(lines, key=lambda x: (-counted[x], x)):
            best, place = 0.0, -1
            for k, (template, _) in enumerate(known):
                same = sum(a == b != "<*>" for a, b in zip(line, template))
                free = sum("<*>" in (a, b) for a, b in zip(line, template))
                share = same / max(len(line) - free, 1) if same >= alike / 2 * len(line) else 0
                if share > best:
                    best, place = share, k
            if best >= alike:
                known[place][0][:] = [a if a == b else "<*>" for a, b in zip(known[place][0], line)]
                of[line] = known[place][1]
            else:
                known.append((list(line), line))
                of[line] = line
    docs: dict = {}
    for line, ids in where.items():
        docs.setdefault(of[line], set()).update(ids)
    for i, text in rows:
        if text is None or i is None:
            yield i, text
        else:
            yield i, "\n".join(x for x in text.split("\n") if len(m := mask(x)) < least_tokens or len(docs[of[m]]) < least_docs or i == min(docs[of[m]]))


def test_line_templates_against_a_plain_version(spark, odd):
    r = random.Random(3)
    shapes = [[r.choice(["the", "user", "of", "server", "went", "down"]) for _ in range(r.randint(3, 9))] for _ in range(12)]

    def line():
        w = list(r.choice(shapes))
        for k in range(len(w)):
            if r.random() < 0.12:
                w[k] = r.choice([str(r.randint(1, 99)), word(r.randint(0, 20))])
        return " ".join(w)

    rows = [(r.randint(0, 70), "\n".join(line() for _ in range(r.randint(0, 8)))) for _ in range(80)] + [(None, line()), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "leaf": F.lit(2), "id": F.lit(3), "template": F.lit("t"), "n": F.lit(0)})
    out = line_templates.drop_lines(df)
    assert out.columns == df.columns
    assert sorted(repr((x.doc_id, x.text)) for x in out.collect()) == sorted(map(repr, plain_drop(rows)))
    assert sorted(repr(tuple(x)) for x in line_templates.drop_lines(odd).collect()) == sorted(repr(x) for x in ODD)


def plain_stages(rows):
    """line_dedup, near_dedup and suffix_dedup in plain Python, over rows (id, text)."""
    rows = list(plain_drop(rows))
    yield rows
    sets, least = brute_groups(rows)
    kept, best = [], {}
    for row, s, c in zip(rows, sets, least):
        if c is None or not s:
            kept.append(row)
        else:
            key = (row[0], hashlib.md5(row[1].encode()).hexdigest())
            best[c] = min(best.get(c, (key, row)), (key, row))
    rows = kept + [x for _, x in best.values()]
    yield rows
    found = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    yield [(i, None if t is None else x[4].decode("utf-8", "ignore")) for (i, t), x in zip(rows, found)]


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    r = random.Random(5)
    boiler = ["All rights reserved by the owners of this page", "Posted by user 17 in the general forum today", "a passage that stands in many of the documents and is longer than fifty bytes in all"]
    made = [(i, "\n".join([(t or "")[:400], r.choice(boiler), " ".join(word(r.randint(0, 900)) for _ in range(12))])) for i, t in near_copies(r, 60)] + [(500, None), (501, ""), (None, None), (7, "another text under an id that is taken")]
    rows = [(i, t, "en", "web", len(t or ""), float(k)) for k, (i, t) in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").withColumn("kept", F.lit(True))
    columns = docs.columns
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[1:4], plain_stages(made)):
        docs = stage(spark, docs, FOLDER)
        got = docs.collect()
        assert docs.columns == columns, name
        assert sorted(repr((x.doc_id, x.text)) for x in got) == sorted(map(repr, wanted)), name
        assert all(x.text is None or x.n_chars == len(x.text) for x in got) or name == "near_dedup"
        docs = spark.createDataFrame(got, docs.schema)
    said = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars").limit(3)), FOLDER)
    assert said.filter(F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, FOLDER)
    assert packed.filter("n_tokens > 0").select(F.sum("n_tokens")).first()[0] == sum(len(tokenizer(WORD).encode(x.text or "", add_special_tokens=False).ids) + 1 for x in docs.collect())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and sum(x.n_tokens for x in out if x.bin_id is not None) > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "packing":
            docs = stored(docs)
    assert sorted(map(repr, out)) == sorted(map(repr, docs.collect()))  # run() chains the stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, FOLDER)
        assert new.count() == 0
        docs = new if stage is not corpus_pipeline.STAGES[-1][1] else docs


def test_shared_folder_is_never_a_local_one_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_memory_is_bounded_by_bytes():
    m = common.Memory(most_bytes=2_000, longest=20)
    for i in range(1000):
        m.keep(str(i), (i,))
    assert len(m) + len(m.older) < 25 and m.recall("999") == (999,) and m.recall("0") is None
    m.keep("x" * 21, (1,))
    assert m.recall("x" * 21) is None
