"""Dedup of byte strings that repeat across documents.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller
doc_id. The work is dealt out by content, and each part is settled by bucket-pointer refinement:

1. Every string of LENGTH bytes is represented by the least hash of the GRAM-byte strings in it (the
   leftmost of equals), so equal strings have the same representative at the same offset. Neighbouring
   strings share one: about one *anchor* stands for 14 strings.
2. Documents lie in home groups of bounded size. Each group sends the digests of the pieces that its
   documents fall into by content (of about 256 strings), and gets back which of them a document with
   a smaller id holds. Those go as they are: the piece of the smallest id stands for them from here
   on, so that copies of long passages don't travel. Of what is left each group sends its different
   anchor hashes, and gets back which of them other documents hold too.
3. Strings of such anchors travel as text to the part of their anchor. There all suffixes are put in
   buckets by their first FIRST bytes; a suffix's bucket pointer is the place where its bucket begins in
   the suffix array. Each round sorts the suffixes of buckets that aren't settled by their own pointer
   and the pointer at the suffix as many bytes further on as are sorted by now, and writes the new
   pointers back, which the next round reads: 8 bytes, then 16, 32 and LENGTH. Bytes are compared, not
   hashes: equal anchor hashes of different strings only mean that more text is sent (digests of pieces,
   of 128 bits, stand for their text). The least doc_id of each bucket says which occurrences go. A
   stretch that several documents of a home group have is sent for the smallest id alone.
4. The home groups take the spans out of their documents.

An anchor with very many different stretches (the edges of a passage in a third of all documents) isn't
one part: each of its strings is dealt by its own hash, and equal strings are sent once by each home
group. That takes about 14 times the bytes, so it is for those alone that one part can't hold.
Groups' replies are bits, so nothing here grows with the number of copies in one task.

Defined cases: doc_id is an integer column (else a ValueError); a null text is an empty one; texts
under LENGTH bytes lose nothing; rows with one doc_id lose nothing to each other; a row with a null
doc_id neither loses nor takes; repeated rows are each settled; extra columns are not read by ``dedup``
and kept by ``dedup_texts``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_text, give_back, mixed, n_partitions, small_batches, table, text_bytes, tidy

LENGTH = 50
#: A multiple of 8, over 8. Runs whose strings of so many bytes repeat travel as text, though nothing of
#: LENGTH bytes does: in a larger corpus 16 bytes often repeat by chance, 24 far less.
GRAM = 24
#: The bytes that the first buckets go by: a number of 64 bits.
FIRST = 8
#: Places that are looked at together: their numbers stay in a core's cache.
CHUNK = 1 << 16
#: Bytes of text for each home group, each part of the hashes, each part of the strings, and each slice
#: of such a part, which are settled one after the other.
HOME_BYTES = 8 << 20
PART_BYTES = 48 << 20
TEXT_BYTES = 24 << 20
FINE_BYTES = 3 << 20
#: Home groups that hold an anchor, each as often as its stretches there differ, before the anchor's
#: strings are dealt one by one: about 3 MB of text.
HOT_HOMES = 32768
#: A piece begins at one in so many places, by the 8 bytes there.
PIECE = 256


def words_at(flat: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as a little-endian number; flat is padded by 8."""
    return np.ndarray((n,), "<u8", flat.tobytes(), strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def pieces(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The document of each piece, its first string's start in ``flat``, the next piece's, and where its
    last string ends. Each string is in one piece; pieces of equal text hold equal strings."""
    at = [bounds[:-1]]
    for begin in range(0, max(len(flat) - LENGTH + 1, 0), CHUNK):
        part = np.concatenate([flat[begin : begin + CHUNK + FIRST], np.zeros(FIRST, np.uint8)])
        w = mixed(words_at(part, min(CHUNK, len(flat) - begin)))
        at.append(begin + np.flatnonzero(w % np.uint64(PIECE) == 0))
    start = np.unique(np.concatenate(at))
    doc = np.searchsorted(bounds[1:], start, side="right")
    whole = start + LENGTH <= np.append(bounds[1:], -1)[doc]  # there may be empty documents at the end
    start, doc = start[whole], doc[whole]
    end = bounds[1:][doc]
    after = np.append(start[1:], len(flat))
    after = np.minimum(after, end - LENGTH + 1)
    return doc, start, after, after + LENGTH - 1


def anchors(flat: np.ndarray, bounds: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same anchor: its hash, the document, the first string's start in
    ``flat``, the number of strings. Documents are flat[bounds[i]:bounds[i + 1]]; only strings that start
    at places under ``open_`` count, if it is given."""
    out = []
    total = len(flat) - LENGTH + 1
    ends = bounds[1:]
    reach = LENGTH - GRAM + 1
    places = np.arange(CHUNK + reach, dtype=np.uint64)
    for begin in range(0, max(total, 0), CHUNK):
        n = min(CHUNK, total - begin)
        part = np.concatenate([flat[begin : begin + n + LENGTH - 1], np.zeros(8, np.uint8)])
        grams = n + reach - 1
        w = words_at(part, grams + GRAM - 8)
        h = mixed(w[GRAM - 8 :])
        for k in range(GRAM - 16, -1, -8):
            h = mixed(w[k : grams + k] * np.uint64(0xC2B2AE3D27D4EB4F) + h)
        span, least = 1, (h & np.uint64(0xFFFFFFFFFF000000)) | places[:grams]  # CHUNK is under 2**24
        while 2 * span <= reach:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        least = least[:n]
        new = np.ones(n, bool)
        new[1:] = least[1:] != least[:-1]
        edges = ends[np.searchsorted(ends, begin) : np.searchsorted(ends, begin + n)] - begin
        new[edges] = True
        if open_ is not None:
            here = open_[begin : begin + n]
            new[1:] |= here[1:] != here[:-1]
        first = np.flatnonzero(new)
        doc = np.searchsorted(ends, begin + first, side="right")
        size = np.minimum(np.append(first[1:], n), ends[doc] - LENGTH + 1 - begin) - first
        whole = size > 0
        if open_ is not None:
            whole &= here[first]
        first = first[whole]
        at = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        out.append((mixed(h[at] + np.uint64(GRAM)), doc[whole], begin + first, size[whole]))  # least hashes are small: spread anew
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def refined_pointers(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bucket pointer of the suffix at each place of ``text``: the place in the order of suffixes,
    compared by their first ``length`` bytes (zeros beyond the end), of the first one of its bucket.
    Places where that many bytes are equal have the same pointer."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + FIRST, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    pointer = np.empty(n, np.int32)
    pointer[order] = starts_of_runs(key[order])
    depth = FIRST
    while depth < length:
        step = min(depth, length - depth)
        open_ = np.flatnonzero(np.bincount(pointer, minlength=n)[pointer] > 1)
        if not len(open_):
            break
        own, later = pointer[open_].astype(np.int64), open_ + step
        key = own << 32 | np.where(later < n, pointer[np.minimum(later, n - 1)] + 1, 0)
        order = np.argsort(key)
        own = own[order]
        pointer[open_[order]] = own + starts_of_runs(key[order]) - starts_of_runs(own)
        depth += step
    return pointer


def starts_of_runs(key: np.ndarray) -> np.ndarray:
    """For each place of sorted keys the first place with that key."""
    first = np.zeros(len(key), np.int32)
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    first[at] = at
    return np.maximum.accumulate(first)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def string_hash(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the LENGTH bytes from each start."""
    h = np.full(len(starts), LENGTH, np.uint64)
    w = words_at(np.concatenate([text, np.zeros(8, np.uint8)]), len(text))
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + w[starts + k])
    return h


def joined(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays)) + b"".join(a.tobytes() for a in arrays)


def parted(blob: bytes, *types) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}q", blob)
    at, out = 8 * len(types), []
    for t, n in zip(types, sizes):
        out.append(np.frombuffer(blob, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    """Sorted spans of documents, those that meet as one."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc)) - 1
    return joined(doc[a].astype(np.int32), start[a].astype(np.uint32), stop[b].astype(np.uint32))


def repeats_of(texts: dict[bytes, int], number: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What goes of runs, each the stretch ``number`` of ``texts`` in the document ``ids``: the run, and
    where in it bytes that a smaller id has too begin and end."""
    text, size = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    strings = size - LENGTH + 1
    first = np.cumsum(strings) - strings  # of each stretch's strings
    starts = np.repeat(np.cumsum(size) - size - first, strings) + np.arange(int(strings.sum()))
    bucket = refined_pointers(text)[starts]
    own = np.full(len(size), 2**63 - 1)
    np.minimum.at(own, number, ids)
    least = np.full(len(text), 2**63 - 1)
    np.minimum.at(least, bucket, np.repeat(own, strings))
    least = least[bucket]
    some = np.flatnonzero(np.minimum.reduceat(least, first)[number] < ids)  # other runs keep all
    number = number[some]
    count = strings[number]
    row = np.repeat(np.arange(len(some)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    goes = least[first[number][row] + nth] < ids[some][row]
    row, nth = row[goes], nth[goes]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(row))[: len(a)] - 1
    return some[row[a]], nth[a], nth[b] + LENGTH


class Home:
    """The documents of one home group, in an order that each pass finds again."""

    def __init__(self, t: pa.Table):
        self.rows = t.sort_by([("id", "ascending"), ("text", "ascending")])
        column = self.rows.column("text").combine_chunks()
        self.flat, self.bounds = flat_text(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        ids = self.rows.column("id")
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        self.home = t.column("home")[0].as_py() if t.num_rows else 0

    def settled(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of ``replies`` begin and where the next ones do."""
        _, start, after, _ = pieces(self.flat, self.bounds)
        found = [parted(b, np.uint32)[0] for p, b in zip(replies.column("part").to_pylist(), replies.column("blob").to_pylist()) if p < 0]
        at = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return start[at], after[at]

    def runs(self, replies: pa.Table):
        """Those of strings outside of the pieces that are settled."""
        edge = np.zeros(len(self.flat) + 1, np.int8)
        start, after = self.settled(replies)
        np.add.at(edge, start, 1)
        np.add.at(edge, after, -1)
        h, doc, start, size = anchors(self.flat, self.bounds, np.cumsum(edge[:-1], dtype=np.int8) == 0)
        keep = self.known[doc]
        return h[keep], doc[keep], start[keep], size[keep]


def sent_hashes(home: Home, parts: int, replies: pa.Table):
    """The different hashes of a home group, whether several doc_ids of it hold each, their parts'
    bounds, and the place of each run's hash among them."""
    h, doc, start, size = home.runs(replies)
    unique, place = np.unique(h, return_inverse=True)
    least, most = np.full(len(unique), 2**63 - 1), np.full(len(unique), -(2**63))
    np.minimum.at(least, place, home.ids[doc])
    np.maximum.at(most, place, home.ids[doc])
    cut = np.searchsorted(part_of(unique, parts), np.arange(parts + 1))
    return unique, least != most, cut, place, (doc, start, size)


def spans_of_repeats(docs: DataFrame, parts: int, text_parts: int, slices: int, hot: int) -> DataFrame:
    """home, part, blob: for each home group the pieces that go (part under 0), and the documents' places,
    starts and stops of what else goes."""
    blob = "part long, home long, blob binary"

    def rows(kind: str, found: list[tuple[int, int, bytes]]) -> pa.Table:
        names = ["home", "part", "blob"] if kind == "home" else ["part", "home", "blob"]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=names)

    def send_pieces(t: pa.Table) -> pa.Table:
        home = Home(t)
        doc, start, _, stop = pieces(home.flat, home.bounds)
        raw = home.flat.tobytes()
        texts: dict[bytes, int] = {}
        digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())]
        number = np.fromiter((texts.setdefault(d, len(texts)) for d in digest), np.int64, len(digest))
        digest = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
        ids, known = home.ids[doc], home.known[doc]
        least = np.full(len(texts), 2**63 - 1)
        np.minimum.at(least, number[known], ids[known])
        nth = np.arange(len(doc), dtype=np.uint32)
        here = known & (ids > least[number])  # those are settled here: a part hears of the least id alone
        out = [(-1 - home.home, home.home, joined(nth[here]))] if here.any() else []
        sent = np.flatnonzero(known & ~here)
        part = part_of(digest[sent, 0], parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                at = sent[order[a:b]]
                out.append((p, home.home, joined(digest[at], nth[at], ids[at])))
        return rows("part", out)

    def answer_pieces(t: pa.Table) -> pa.Table:
        part, homes, blobs = t.column("part")[0].as_py(), t.column("home").to_pylist(), t.column("blob").to_pylist()
        if part < 0:
            return rows("home", [(home, part, b) for home, b in zip(homes, blobs)])
        found = [parted(b, "<u8", np.uint32, np.int64) for b in blobs]
        digest = np.concatenate([f[0] for f in found]).reshape(-1, 2)
        ids = np.concatenate([f[2] for f in found])
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        goes, out, done = least < ids, [], 0
        for home, f in zip(homes, found):
            mine = f[1][goes[done : done + len(f[1])]]
            done += len(f[1])
            if len(mine):
                out.append((home, -1 - part, joined(mine)))
        return rows("home", out)

    def send(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return rows("part", [])
        home = Home(t)
        unique, several, cut, place, (_, start, size) = sent_hashes(home, parts, replies)
        low = unique.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        count = np.bincount(place, minlength=len(unique))
        raw, many = home.flat.tobytes(), np.flatnonzero(count[place] > 1)
        order = many[np.argsort(place[many], kind="stable")]
        different = {(p, raw[s : s + n]) for p, s, n in zip(place[order].tolist(), start[order].tolist(), (size[order] + LENGTH - 1).tolist())}
        again = np.bincount(np.fromiter((p for p, _ in different), np.int64, len(different)), minlength=len(unique)) - 1
        crowd = np.flatnonzero(again > 0)
        ends = np.searchsorted(crowd, cut)
        found = []
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                more = crowd[ends[p] : ends[p + 1]]
                found.append((p, home.home, joined(low[a:b], np.packbits(several[a:b]), (more - a).astype(np.int32), again[more].astype(np.int32))))
        return rows("part", found)

    def answer(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        home = t.column("home").to_pylist()
        values, several, size, differ = [], [], [], []
        for b in t.column("blob").to_pylist():
            low, bits, more, again = parted(b, np.uint8, np.uint8, np.int32, np.int32)
            differ.append(np.ones(len(low) // 5))
            differ[-1][more] += again
            wide = np.zeros((len(low) // 5, 8), np.uint8)
            wide[:, :5] = low.reshape(-1, 5)
            values.append(wide.reshape(-1).view("<u8"))
            several.append(np.unpackbits(bits, count=len(wide)).astype(bool))
            size.append(len(wide))
        _, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        twice = count[place] > 1
        twice |= np.bincount(place, weights=np.concatenate(several))[place] > 0
        crowded = np.bincount(place, weights=np.concatenate(differ))[place] >= hot
        ends = np.cumsum(size)
        return rows("home", [(x, part, joined(np.packbits(twice[e - n : e]), np.packbits(crowded[e - n : e]))) for x, n, e in zip(home, size, ends) if twice[e - n : e].any()])

    def send_text(t: pa.Table, replies: pa.Table) -> pa.Table:
        asked = [(p, b) for p, b in zip(replies.column("part").to_pylist(), replies.column("blob").to_pylist()) if p >= 0]
        if not t.num_rows or not asked:
            return rows("part", [])
        home = Home(t)
        unique, _, cut, place, (doc, start, size) = sent_hashes(home, parts, replies)
        twice, crowded = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
        for p, b in asked:
            x, y = parted(b, np.uint8, np.uint8)
            n = cut[p + 1] - cut[p]
            twice[cut[p] : cut[p + 1]] = np.unpackbits(x, count=n)
            crowded[cut[p] : cut[p + 1]] = np.unpackbits(y, count=n)
        use, fine = twice[place], text_parts * slices
        alike = np.bincount(place, minlength=len(unique))[place][use] > 1
        part, doc, start, size, many = part_of(unique, fine)[place][use], doc[use], start[use], size[use], crowded[place][use]
        if many.any():  # each string by itself
            n = size[many]
            row = np.repeat(np.flatnonzero(many), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own = start[row] + nth
            part = np.concatenate([part[~many], part_of(string_hash(home.flat, own), fine)])
            doc, start = np.concatenate([doc[~many], doc[row]]), np.concatenate([start[~many], own])
            size = np.concatenate([size[~many], np.ones(len(row), np.int64)])
            alike = np.concatenate([alike[~many], np.ones(len(row), bool)])
        order = np.argsort(part, kind="stable")
        part, doc, start, stop, alike = part[order], doc[order], start[order], (start + size + LENGTH - 1)[order], np.flatnonzero(alike[order])
        raw, texts = home.flat.tobytes(), {}
        number = np.arange(len(part))  # the first run with the same text
        number[alike] = np.fromiter((texts.setdefault(raw[a:b], i) for i, a, b in zip(alike.tolist(), start[alike].tolist(), stop[alike].tolist())), np.int64, len(alike))
        del texts
        own, least = home.ids[doc], np.full(len(part), 2**63 - 1)
        np.minimum.at(least, number, own)
        first, out = own == least[number], []
        sent, here = np.flatnonzero(first), np.flatnonzero(~first)
        edges = np.searchsorted(part[sent], np.arange(text_parts + 1) * slices)
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b == a:
                continue
            at = sent[a:b]
            texts, nth_text = np.unique(number[at], return_inverse=True)
            docs_here, nth_doc = np.unique(doc[at], return_inverse=True)
            text = b"".join([raw[x:y] for x, y in zip(start[texts].tolist(), stop[texts].tolist())])
            out.append((p, home.home, joined(np.frombuffer(text, np.uint8), (stop - start)[texts].astype(np.int32), (part[texts] - p * slices).astype(np.int32), nth_text.astype(np.int32), nth_doc.astype(np.int32), (start[at] - home.bounds[doc[at]]).astype(np.uint32), docs_here.astype(np.int32), home.ids[docs_here])))
        if len(here):  # those go: this group has a smaller id with that stretch
            at = here[np.argsort(start[here], kind="stable")]
            out.append((-1 - home.home, home.home, spans(doc[at], start[at] - home.bounds[doc[at]], stop[at] - home.bounds[doc[at]])))
        return rows("part", out)

    def settle(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        if part < 0:  # what a home group has settled by itself
            return rows("home", [(home, 0, b) for home, b in zip(t.column("home").to_pylist(), t.column("blob").to_pylist())])
        homes, blobs = t.column("home").to_pylist(), t.column("blob").to_pylist()
        found = [parted(b, np.uint8, np.int32, np.int32, np.int32, np.int32, np.uint32, np.int32, np.int64) for b in blobs]
        raw, size, piece = b"".join([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        ends, before = np.cumsum(size, dtype=np.int64), np.cumsum([0, *(len(f[1]) for f in found)])
        number = np.concatenate([f[3] + n for f, n in zip(found, before)])
        group = np.repeat(np.arange(len(found)), [len(f[3]) for f in found])
        doc, start, ids = np.concatenate([f[6][f[4]] for f in found]), np.concatenate([f[5] for f in found]), np.concatenate([f[7][f[4]] for f in found])
        del found, blobs
        own, runs = np.argsort(piece, kind="stable"), np.argsort(piece[number], kind="stable")
        own_at, runs_at = (np.searchsorted(x, np.arange(slices + 1)) for x in (piece[own], piece[number[runs]]))
        place, gone = np.empty(len(size), np.int64), []
        for k in range(slices):
            mine, at = own[own_at[k] : own_at[k + 1]], runs[runs_at[k] : runs_at[k + 1]]
            if not len(at):
                continue
            texts: dict[bytes, int] = {}  # home groups may send the same stretch
            place[mine] = np.fromiter((texts.setdefault(raw[a:b], len(texts)) for a, b in zip((ends[mine] - size[mine]).tolist(), ends[mine].tolist())), np.int64, len(mine))
            row, begin, stop = repeats_of(texts, place[number[at]], ids[at])
            row = at[row]
            gone.append((group[row], doc[row], start[row] + begin, start[row] + stop))
        give_back()
        if not any(len(g[0]) for g in gone):
            return rows("home", [])
        group, doc, start, stop = (np.concatenate(x) for x in zip(*gone))
        order = np.lexsort((start, doc, group))
        group, doc, start, stop = group[order], doc[order], start[order], stop[order]
        edges = np.searchsorted(group, np.arange(len(homes) + 1))
        return rows("home", [(home, part, spans(doc[a:b], start[a:b], stop[a:b])) for home, a, b in zip(homes, edges, edges[1:]) if b > a])

    back = "home long, part long, blob binary"
    settled = docs.groupBy("home").applyInArrow(send_pieces, blob).groupBy("part").applyInArrow(answer_pieces, back)
    hashes = docs.groupBy("home").cogroup(settled.groupBy("home")).applyInArrow(send, blob)
    answers = hashes.groupBy("part").applyInArrow(answer, back)
    texts = docs.groupBy("home").cogroup(settled.union(answers).groupBy("home")).applyInArrow(send_text, blob)
    return settled.union(texts.groupBy("part").applyInArrow(settle, back))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary: the bytes that stay), a row each."""
    return carried(df, text, doc_id, [])


def carried(df: DataFrame, text: str, doc_id: str, carry: list) -> DataFrame:
    """As ``dedup``, with the columns ``carry`` of each row as carry_0, carry_1, ..."""
    spark, extra = df.sparkSession, len(carry)
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must be an integer column: documents are compared by it")
    size = text_bytes(df, text)
    homes = max(n_partitions(spark), -(-size // HOME_BYTES))
    parts = max(n_partitions(spark), -(-size // PART_BYTES))
    docs = small_batches(df).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *(c.alias(f"carry_{i}") for i, c in enumerate(carry)))
    docs = docs.withColumn("home", F.pmod(F.xxhash64("id", "text"), F.lit(homes)))
    text_parts = max(n_partitions(spark), -(-size // TEXT_BYTES))
    slices = max(1, -(-size // (text_parts * FINE_BYTES)))
    gone_spans = spans_of_repeats(docs, parts, text_parts, slices, hot=HOT_HOMES)

    def remove(t: pa.Table, found: pa.Table) -> pa.Table:
        home = Home(t)
        n = np.diff(home.bounds)
        edge = np.zeros(len(home.flat) + 1, np.int32)
        start, after = home.settled(found)
        np.add.at(edge, start, 1)
        np.add.at(edge, after + LENGTH - 1, -1)
        for p, b in zip(found.column("part").to_pylist(), found.column("blob").to_pylist()):
            if p >= 0:
                doc, start, stop = parted(b, np.int32, np.uint32, np.uint32)
                np.add.at(edge, home.bounds[doc] + start, 1)
                np.add.at(edge, home.bounds[doc] + stop, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = home.bounds[:-1][n > 0]
        begins[first] = gone[first]
        gone_to, begins_to = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, begins))
        removed, spans_n = np.diff(gone_to[home.bounds]), np.diff(begins_to[home.bounds])
        kept = home.flat[~gone]
        give_back()
        offsets = np.concatenate([[0], np.cumsum(n - removed)]).astype(np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
        rest = [home.rows.column(f"carry_{i}") for i in range(extra)]
        return pa.table([home.rows.column("id"), pa.array(n), pa.array(removed), pa.array(spans_n), raw, *rest], names=out.fieldNames())

    out = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    for f in docs.schema.fields[2:-1]:
        out.add(f)
    return docs.groupBy("home").cogroup(gone_spans.groupBy("home")).applyInArrow(remove, out)


def dedup_texts(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with the repeats taken out of its texts. A character that lost some of its bytes goes
    altogether; a null text stays null; all other columns stay."""
    others = [c for c in df.columns if c not in (text, doc_id)]
    found = carried(df, text, doc_id, [F.col(f"`{c}`") for c in others] + [F.col(text).isNull()])
    source = found.select("doc_id", "kept", *(f"carry_{i}" for i in range(len(others) + 1)))

    def read(batches):
        for b in batches:
            texts = [None if null else k.decode("utf-8", "ignore") for k, null in zip(b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[2:-1]], names=out.fieldNames())

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *source.schema.fields[2:-1]])
    places = {doc_id: F.col("doc_id").cast(df.schema[doc_id].dataType), text: F.col("text"), **{c: F.col(f"carry_{i}") for i, c in enumerate(others)}}
    return source.mapInArrow(tidy(read), out).select(*(places[c].alias(c) for c in df.columns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS string FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS k FROM d)
), f AS (
  SELECT string, min(doc_id) AS first FROM s GROUP BY 1
), g AS (
  SELECT s.doc_id, s.k, lag(s.k) OVER w AS before_, lead(s.k) OVER w AS after_ FROM s JOIN f USING (string) WHERE f.first < s.doc_id
  WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.k)
), r AS (
  SELECT doc_id, sum(least(50, coalesce(after_ - k, 50)))::BIGINT AS n_removed, count(*) FILTER (before_ IS NULL OR k > before_ + 50) AS n_spans,
    string_agg(CASE WHEN after_ > k + 50 THEN substr(h, 2 * (k + 50) + 1, 2 * (after_ - k - 50)) WHEN after_ IS NULL THEN substr(h, 2 * (k + 50) + 1) ELSE '' END, '' ORDER BY k) AS rest, min(k) AS lead_
  FROM g JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE substr(h, 1, 2 * lead_) || rest END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
