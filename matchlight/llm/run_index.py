"""Exact removal of byte strings of LENGTH or more that occur earlier, with run-length indexes.

Every window of LENGTH bytes selects one of its GRAM-byte grams, the least by hash;
equal windows select equal grams. So a window can only repeat if its gram does, and
the corpus falls apart into independent groups by gram:

1. Selected grams are dealt by hash; those seen once are dropped.
2. Documents cut the context of each remaining gram (the bytes of all windows that
   select it) and deal it by the gram.
3. In each deal equal contexts collapse to their earliest place. Grams with several
   distinct contexts go into an index: the Burrows-Wheeler transform of the contexts,
   run-compressed. Longest common prefixes are compared at the ends of runs only and
   streamed through the text for all other suffixes (inside a run each is one less
   than that of the suffix before it). Suffixes that share LENGTH bytes are one class;
   all but the earliest place of a class are marked. An index holds INDEX_SYMBOLS at
   most: grams are independent, and the windows of a gram with more are parted by the
   gram's offset in them, which equal windows share.
4. Marks return to their documents, where covered bytes are cut.

Texts are UTF-8 of any length; null counts as empty; texts under LENGTH bytes keep all. Windows
never cross documents. doc_id orders documents and names a text: rows that repeat an
id and its text are one place and get equal results; rows without an id keep all and
cover nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import shingles
from .common import chunks, map_texts
from .shingles import mix

LENGTH, GRAM = 100, 32
#: Grams in a window.
WIDTH = LENGTH - GRAM + 1
_PLACE = np.uint64((1 << 24) - 1)
_SLICE = 1 << 22
#: Contexts of so many anchors are held at once, of one long text too.
ANCHORS_AT_ONCE = 200_000
#: Bytes of text for each bucket that groups are dealt in.
BUCKET_BYTES = 2 << 20
#: Symbols of an index; a group with more is indexed in parts.
INDEX_SYMBOLS = 1 << 21


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each selected gram, the first and last start of the windows that select it, and its place."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    found = []
    for first in range(0, n, _SLICE):
        part = b[first : first + _SLICE + LENGTH - 1]
        shingles._grow(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * shingles._powers[: len(part)], dtype=np.uint64)))
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * shingles._inverses[: len(part) - GRAM + 1])
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= WIDTH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < WIDTH:
            low = np.minimum(low[: len(low) - (WIDTH - width)], low[WIDTH - width :])
        at = (low & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.concatenate((starts[1:], [len(at)])) - 1
        found.append((grams[at[starts]], starts + first, ends + first, at[starts] + first))
    return tuple(np.concatenate(x) for x in zip(*found))


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bucket_of(grams: np.ndarray, n: int) -> np.ndarray:
    return (mix(grams) % np.uint64(n)).astype(np.int64)  # a selected gram's hash is a minimum, so its high bits are mostly 0


def split_by(bucket: np.ndarray):
    """(value, indexes) of each distinct bucket."""
    order = bucket.argsort(kind="stable")
    kinds, starts = np.unique(bucket[order], return_index=True)
    return zip(kinds.tolist(), np.split(order, starts[1:]))


DEALT = pa.schema([("__bucket", pa.int64()), ("__blob", pa.binary())])


def deal(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=DEALT)


def deal_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1, map side: blobs of (gram, document, number of the anchor in it) by bucket.

    A gram that a chunk holds several times is sent twice only; its anchors in the
    chunk are known to be repeated and go along by document.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in chunks(batch):
                grams, owners, numbers = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    g = anchors((text or "").encode("utf-8", "surrogatepass"))[0]
                    grams.append(g)
                    owners.append(np.full(len(g), doc, np.int64))
                    numbers.append(np.arange(len(g), dtype=np.uint32))
                g, o, k = np.concatenate(grams), np.concatenate(owners), np.concatenate(numbers)
                _, first, at, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
                again = n[at] > 1
                sent = np.sort(np.concatenate((first, first[n > 1])))  # twice in the chunk: the gram is sent twice, its anchors are certain
                rows = []
                for kind, at in split_by(bucket_of(g[sent], buckets)):
                    at = sent[at]
                    step = np.diff(o[at], prepend=np.int64(0))
                    rows.append((kind, b"G" + len(at).to_bytes(4, "little") + pack48(g[at]) + squeeze.compress(step.tobytes() + k[at].tobytes())))
                o, k = o[again], k[again]
                for kind, at in split_by(bucket_of(o.astype(np.uint64), buckets)):
                    rows.append((kind, b"R" + squeeze.compress(o[at].tobytes() + k[at].tobytes())))
                yield deal(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "__bucket long, __blob binary")


def repeated(table: pa.Table) -> pa.Table:
    """Step 1, reduce side: the anchors whose gram is seen twice or more, by document."""
    grams, owners, numbers, ready = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)], []
    for blob in table.column("__blob").to_pylist():
        if blob[:1] == b"R":
            rest = zstandard.decompress(blob[1:])
            n = len(rest) // 12
            ready.append((np.frombuffer(rest, np.int64, n), np.frombuffer(rest, np.uint32, n, 8 * n)))
            continue
        n = int.from_bytes(blob[1:5], "little")
        rest = zstandard.decompress(blob[5 + 6 * n :])
        grams.append(unpack48(blob[5 : 5 + 6 * n]))
        owners.append(np.cumsum(np.frombuffer(rest[: 8 * n], np.int64)))
        numbers.append(np.frombuffer(rest[8 * n :], np.uint32))
    g, o, k = np.concatenate(grams), np.concatenate(owners), np.concatenate(numbers)
    order = g.argsort(kind="stable")
    g = g[order]
    same = g[1:] == g[:-1]
    twice = order[(np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(order)]]
    o, k = np.concatenate([o[twice], *(r[0] for r in ready)]), np.concatenate([k[twice], *(r[1] for r in ready)])
    return by_document(o, k[:, None])


def by_document(owner: np.ndarray, values: np.ndarray) -> pa.Table:
    """doc_id and its rows of 32-bit values as one blob."""
    order = owner.argsort(kind="stable")
    docs, starts = np.unique(owner[order], return_index=True)
    values = np.ascontiguousarray(values[order].astype("<u4"))
    ends = np.concatenate((starts[1:], [len(order)]))
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "__values": pa.array([values[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})


def collapse(grams: list, docs: list, starts: list, contexts: list) -> tuple[list[int], np.ndarray]:
    """For contexts ordered by place: the numbers of the first of each kind, and the ranges (document, start, end) of the others, which those cover."""
    seen: dict[tuple[int, bytes], tuple[int, int]] = {}
    firsts, ready = [], []
    for i, (gram, doc, start, context) in enumerate(zip(grams, docs, starts, contexts)):
        first = seen.get((gram, context))
        if first is None:
            seen[gram, context] = (doc, start)
            firsts.append(i)
        elif first != (doc, start):
            ready.append((doc, start, start + len(context)))
    return firsts, np.array(ready, np.int64).reshape(-1, 3)


def deal_contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 2: docs(doc_id, __z, __values) to blobs of contexts by bucket.

    Of equal contexts in a chunk only the first is dealt; the ranges of the others are
    certain and go along by document, so a common passage makes one entry a chunk.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch, "__z"):
                held: list[tuple] = []
                size = 0
                for doc, z, values in zip(*(part.column(c).to_pylist() for c in ("doc_id", "__z", "__values"))):
                    data = zstandard.decompress(z) if z else b""
                    g, a, b, p = anchors(data)
                    k = np.unique(np.frombuffer(b"".join(values), "<u4"))
                    k = k[k < len(g)]
                    for at in np.array_split(k, len(k) // ANCHORS_AT_ONCE + 1):
                        held.append((g[at], np.full(len(at), doc, np.int64), a[at], (p - a)[at], [data[x : y + LENGTH] for x, y in zip(a[at].tolist(), b[at].tolist())]))
                        size += len(at)
                        if size >= ANCHORS_AT_ONCE:
                            yield deal(blobs(held, squeeze))
                            held, size = [], 0
                if size:
                    yield deal(blobs(held, squeeze))

    def blobs(held: list[tuple], squeeze) -> list[tuple[int, bytes]]:
        g, o, s, lead = (np.concatenate([h[i] for h in held]) for i in range(4))
        contexts = [c for h in held for c in h[4]]
        order = np.lexsort((s, o))
        firsts, ready = collapse(g[order].tolist(), o[order].tolist(), s[order].tolist(), [contexts[i] for i in order.tolist()])
        sent = order[firsts]
        rows = []
        for kind, at in split_by(bucket_of(g[sent], buckets)):
            at = sent[at]
            at = at[g[at].argsort(kind="stable")]
            own = [contexts[i] for i in at.tolist()]
            sizes = np.array([len(c) for c in own], np.uint8)
            body = pack48(g[at]) + o[at].tobytes() + s[at].astype("<u4").tobytes() + sizes.tobytes() + lead[at].astype(np.uint8).tobytes() + b"".join(own)
            rows.append((kind, squeeze.compress(b"C" + len(at).to_bytes(4, "little") + body)))
        if len(ready):
            for kind, at in split_by(bucket_of(ready[:, 0].astype(np.uint64), buckets)):
                rows.append((kind, squeeze.compress(b"M" + ready[at].tobytes())))
        return rows

    return docs.mapInArrow(run, "__bucket long, __blob binary")


def suffix_ranks(text: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of texts, each ended by a 0 of its own, and the ranks of prefixes of 7, 14, 28 ... symbols."""
    n, h = len(text), 7
    wide = np.concatenate((text, np.zeros(h, text.dtype))).astype(np.uint64)
    packed, open_, tie = np.zeros(n, np.uint64), np.ones(n, bool), np.zeros(n, np.uint64)
    for j in range(h):
        symbol = wide[j : j + n]
        packed = packed << np.uint64(9) | np.where(open_, symbol, np.uint64(0))
        open_ &= symbol != 0
    tie[~open_] = owner[~open_].astype(np.uint64) + np.uint64(1)
    order = np.lexsort((tie, packed))
    change = (packed[order][1:] != packed[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    ranks = []
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(change))).astype(np.uint64)
        ranks.append((h, rank))
        if change.all():
            return order, ranks
        key = rank << np.uint64(32)
        key[: n - h] |= rank[h:] + np.uint64(1)
        order = key.argsort(kind="stable")
        change = key[order][1:] != key[order][:-1]
        h *= 2


def common_prefixes(text: np.ndarray, ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, by the ranks and then symbol by symbol."""
    n, total = len(text), np.zeros(len(i), np.int64)
    i, j = i.copy(), j.copy()
    for h, rank in reversed(ranks):
        same = (i < n) & (j < n)
        same[same] = rank[i[same]] == rank[j[same]]
        i[same] += h
        j[same] += h
        total[same] += h
    on = np.ones(len(i), bool)
    for _ in range(ranks[0][0]):
        on &= (i < n) & (j < n)
        on[on] = (text[i[on]] == text[j[on]]) & (text[i[on]] != 0)
        i[on] += 1
        j[on] += 1
        total[on] += 1
    return total


class RunIndex:
    """Run-compressed transform of byte strings, with the prefix lengths at the ends of runs."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings])
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.first = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.uint16) + np.uint16(1)
        text[self.first + sizes - 1] = 0
        self.text = text
        self.suffixes, ranks = suffix_ranks(text, self.owner)
        before = text[self.suffixes - 1]
        #: Where a run of the transform begins; an end of string is a run of its own.
        self.heads = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
        k = self.heads[1:]
        self.sampled = np.concatenate(([0], common_prefixes(text, ranks, self.suffixes[k], self.suffixes[k - 1])))

    def matching(self) -> np.ndarray:
        """For every place of the text the length it shares with the suffix sorted before it, streamed from the runs' ends."""
        n = len(self.text)
        known = np.full(n, -(n + 1), np.int64)
        known[self.suffixes[self.heads]] = self.sampled
        place = np.arange(n)
        return np.maximum(np.maximum.accumulate(known + place) - place, 0)

    def classes(self, length: int) -> np.ndarray:
        """Number of each place's class: places share a class if they share `length` symbols."""
        new = self.matching()[self.suffixes] < length
        found = np.empty(len(new), np.int64)
        found[self.suffixes] = np.cumsum(new)
        return found


def mark(table: pa.Table) -> pa.Table:
    """Step 3: the byte ranges of documents that occur earlier, by document."""
    grams, owners, starts, leads, contexts, marks = [], [], [], [], [], []
    for blob in table.column("__blob").to_pylist():
        body = zstandard.decompress(blob)
        if body[:1] == b"M":
            marks.append(np.frombuffer(body, np.int64, offset=1).reshape(-1, 3))
            continue
        n = int.from_bytes(body[1:5], "little")
        at = 5
        grams.append(unpack48(body[at : at + 6 * n]))
        owners.append(np.frombuffer(body, np.int64, n, at + 6 * n))
        starts.append(np.frombuffer(body, "<u4", n, at + 14 * n))
        sizes = np.frombuffer(body, np.uint8, n, at + 18 * n)
        leads.append(np.frombuffer(body, np.uint8, n, at + 19 * n))
        ends = np.cumsum(sizes, dtype=np.int64) + at + 20 * n
        contexts += [body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
    if contexts:
        marks += mark_contexts(np.concatenate(grams), np.concatenate(owners), np.concatenate(starts).astype(np.int64), np.concatenate(leads).astype(np.int64), contexts)
    found = np.concatenate([np.empty((0, 3), np.int64), *marks])
    return by_document(found[:, 0], found[:, 1:])


def mark_contexts(g: np.ndarray, o: np.ndarray, s: np.ndarray, lead: np.ndarray, contexts: list[bytes]) -> list[np.ndarray]:
    """Ranges of all but the first of equal contexts, and of windows in firsts that another first has earlier."""
    order = np.lexsort((s, o))
    firsts, ready = collapse(g[order].tolist(), o[order].tolist(), s[order].tolist(), [contexts[i] for i in order.tolist()])
    first = order[firsts]
    first = first[g[first].argsort(kind="stable")]  # by gram, then by place
    found = [ready]
    group: list[int] = []
    held = 0
    for own in np.split(first, np.flatnonzero(np.diff(g[first])) + 1) if len(first) else ():
        if len(own) < 2:
            continue
        size = sum(len(contexts[i]) + 1 for i in own.tolist())
        if size > INDEX_SYMBOLS:
            found += mark_parts([contexts[i] for i in own.tolist()], o[own], s[own], lead[own], 0, WIDTH - 1)
            continue
        if held + size > INDEX_SYMBOLS:
            found.append(mark_index([contexts[i] for i in group], o[group], s[group]))
            group, held = [], 0
        group += own.tolist()
        held += size
    if group:
        found.append(mark_index([contexts[i] for i in group], o[group], s[group]))
    return found


def mark_parts(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, lead: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """As mark_contexts, for strings of one gram by place and their windows that have the gram at offsets low to high only."""
    first = np.maximum(lead - high, 0)
    last = np.minimum(lead - low + LENGTH, [len(x) for x in strings])
    some = np.flatnonzero(last - first >= LENGTH)
    own = [strings[i][a:z] for i, a, z in zip(some.tolist(), first[some].tolist(), last[some].tolist())]
    docs, starts, lead = docs[some], (starts + first)[some], (lead - first)[some]
    firsts, ready = collapse([0] * len(own), docs.tolist(), starts.tolist(), own)
    if len(firsts) < 2 or low == high:  # strings of one window that differ
        return [ready]
    own, docs, starts, lead = [own[i] for i in firsts], docs[firsts], starts[firsts], lead[firsts]
    if sum(map(len, own)) + len(own) <= INDEX_SYMBOLS:
        return [ready, mark_index(own, docs, starts)]
    middle = (low + high) // 2
    return [ready, *mark_parts(own, docs, starts, lead, low, middle), *mark_parts(own, docs, starts, lead, middle + 1, high)]


def mark_index(strings: list[bytes], docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranges of the strings' windows that an earlier window equals."""
    index = RunIndex(strings)
    number = index.classes(LENGTH)
    offset = np.arange(len(index.text)) - index.first[index.owner]
    _, doc_rank = np.unique(docs, return_inverse=True)
    place = doc_rank[index.owner].astype(np.int64) << 40 | (starts[index.owner] + offset)
    earliest = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, number, place)
    hit = np.flatnonzero(place > earliest[number])
    if not len(hit):
        return np.empty((0, 3), np.int64)
    breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(index.owner[hit]) != 0)) + 1
    a, z = hit[np.concatenate(([0], breaks))], hit[np.concatenate((breaks - 1, [len(hit) - 1]))]
    owner = index.owner[a]
    return np.stack((docs[owner], starts[owner] + offset[a], starts[owner] + offset[z] + LENGTH), axis=1)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and __z, the compressed text."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=3)
        return lambda text: (squeeze.compress(text.encode("utf-8", "surrogatepass")),)

    return map_texts(docs, make, "__z binary")


def cut_ranges(data: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs and what is left."""
    if not len(ranges):
        return 0, 0, data
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    first = ranges[new, 0]
    last = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ranges) - 1]))]
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return int((last - first).sum()), len(first), b"".join(kept)


def by_bucket(dealt: DataFrame, kernel) -> DataFrame:
    """kernel on each bucket; partitions get buckets in turn, so their numbers differ by one at most."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("__part", F.pmod(F.col("__bucket"), F.lit(n)).cast("int")).repartitionById(n, F.col("__part"))
    return dealt.groupBy("__part", "__bucket").applyInArrow(kernel, "doc_id long, __values binary")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, __z and __values: blobs of the (start, end) ranges to cut, null where there are none."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    grams = by_bucket(deal_grams(docs.where("doc_id is not null"), buckets), repeated)
    asked = grams.groupBy("doc_id").agg(F.collect_list("__values").alias("__values"))
    texts = packed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    contexts = deal_contexts(texts.join(asked, "doc_id"), buckets)
    marks = cut(by_bucket(contexts, mark))
    return texts.join(marks.groupBy("doc_id").agg(F.collect_list("__values").alias("__values")), "doc_id", "left")


def apply(docs: DataFrame, make, fields: str) -> DataFrame:
    """doc_id and what make()'s kernel returns of (text's bytes, ranges)."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"doc_id long, {fields}")
    names = schema.names

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in chunks(batch, "__z"):
                rows = []
                for doc, z, values in zip(*(part.column(c).to_pylist() for c in ("doc_id", "__z", "__values"))):
                    ranges = np.frombuffer(b"".join(values or []), "<u4").astype(np.int64).reshape(-1, 2)
                    rows.append((doc, *kernel(zstandard.decompress(z), ranges)))
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(names)}, schema=target)

    from .common import _arrow_schema

    target = _arrow_schema(schema)
    return marked(docs).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, bytes and runs removed, and the hash of what is left of every document."""

    def make():
        def kernel(data: bytes, ranges: np.ndarray) -> tuple:
            removed, runs, kept = cut_ranges(data, ranges)
            return len(data), removed, runs, hashlib.sha256(kept).hexdigest()

        return kernel

    return apply(docs, make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes left of every document (removal may cut a character)."""
    return apply(docs, lambda: lambda data, ranges: (cut_ranges(data, ranges)[2],), "kept binary")
