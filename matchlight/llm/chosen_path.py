"""Jaccard join of word shingles by the chosen-path method.

Texts with equal shingle sets are one set. Each set is embedded in T min-hash
coordinates. In each run a set goes down a tree of buckets: at a node one coordinate is
chosen by a hash of the node's path, two at a quarter of the nodes, and the set goes
into the child of each with its value there. Two sets of similarity s share a child
with probability s a coordinate, so 1 / THRESHOLD coordinates a node let pairs above the
threshold live on and groups below it die out. Runs are repeated until a pair at the
threshold is lost in all of them with probability 1 - TARGET at most, DEPTH levels down
(`loss`). Buckets of up to LIMIT sets are compared by brute force over the coordinates'
low bytes. In larger buckets all sets near a leader are linked to it, so only pairs with
a set far from it are open. Where up to FAR sets are far (a bucket of copies of one text),
these meet all others in slices of the bucket, which settles it; else all sets but those
so near that the leader stands for them go further down. Buckets that are still open
DEPTH levels down meet in pairs of blocks.

That gives candidate links, cut per bucket to a spanning forest. Their components are
then compared exactly: a component is dealt in blocks of a bounded number of sets and
bytes, each pair of blocks is one group, and intersections of the whole shingle sets are
counted there; every pair of sets in a component is compared once and no pair is emitted.
The links found give the classes.

Null texts and texts without words have no shingles: each is a class of its own
without links. Texts under five words are one shingle. doc_id names a row: rows that
repeat an id and its text are copies of each other; rows without an id have no class
and no links, and stay. Extra columns stay in ``distinct``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .common import map_texts
from .components import components
from .shingles import MinHash, mix, shingle_set

THRESHOLD, TARGET = 0.8, 0.9999
T, LIMIT, DEPTH = 128, 256, 4
#: Sets far from a large bucket's leader that may meet all its sets, and sets of it that they meet in one group.
FAR, SLICE = 1024, 1024
#: A node has two children instead of one if its hash falls in this share, so 1 / THRESHOLD on average.
SECOND = 1 / THRESHOLD - 1
#: Orders in which a bucket's leader is the first: few, so that buckets of one group share leaders.
LEADER_ORDERS = 3
#: Least number of equal low bytes of T for a candidate: five deviations under what THRESHOLD gives.
NEAR = int(T * (THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / T)))
#: From so many equal bytes on, a set rests with the leader of a large bucket: a partner of it has, but for a
#: probability of 1 - TARGET, at most 3.72 deviations fewer equal bytes than THRESHOLD gives, loses T - REST more to the leader, and is
#: still NEAR it. All other sets go further down.
REST = NEAR + T - int(T * (THRESHOLD - 3.72 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / T)))
#: Sets and bytes of text in a block of the exact comparison, on average.
BLOCK, BLOCK_BYTES = 256, 16 << 20


def loss(s: float = THRESHOLD, depth: int = DEPTH) -> float:
    """Probability that one run separates a pair of similarity s by the given depth."""
    q = 0.0
    for _ in range(depth):
        one = 1 - s + s * q
        q = (1 - SECOND) * one + SECOND * one * one
    return 1 - s * (1 - q)


RUNS = math.ceil(math.log(1 - TARGET) / math.log(loss()))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, __set (hash of the shingle set, null without words), __sk (low bytes of the coordinates), __keys (first buckets of all runs), __chars (length of the text)."""

    def make():
        minima = MinHash(T)
        path = mix(np.arange(1, RUNS + 1, dtype=np.uint64))
        chosen = (path % np.uint64(T)).astype(int)

        def kernel(text: str) -> tuple:
            s = shingle_set(text)
            if not len(s):
                return None, None, None, 0
            low = minima(s)
            keys = mix(path ^ low[chosen]).view(np.int64)
            return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (low & np.uint64(255)).astype(np.uint8).tobytes(), keys.tolist(), len(text)

        return kernel

    return map_texts(docs, make, "__set binary, __sk binary, __keys array<long>, __chars long")


def with_size(rows: DataFrame) -> DataFrame:
    """rows of buckets with two sets or more, with __n."""
    sizes = cut(rows.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1"))  # apart from the join, which can then split a large bucket
    return rows.join(sizes, "__key")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what near (a symmetric matrix) joins, each node to the least of its part."""
    label = np.arange(len(ids))
    order = ids.argsort()
    rank = np.empty(len(ids), int)
    rank[order] = label
    label = rank.copy()
    linked = near | np.eye(len(ids), dtype=bool)
    while True:
        low = np.where(linked, label, len(ids)).min(axis=1)
        if (low == label).all():
            break
        label = low
    roots = ids[order[label]]
    return [(int(a), int(b)) for a, b in zip(roots, ids) if a != b]


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x[:, None, :] == y[None, :, :]).sum(axis=2, dtype=np.int32)


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, T)


def reached(ids: np.ndarray, some: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """As forest, where near tells only for the rows `some` which ids they join."""
    order = ids.argsort()
    label = np.empty(len(ids), int)
    label[order] = np.arange(len(ids))
    while True:
        low = np.where(near, label, len(ids)).min(axis=1)
        next_ = np.minimum(label, np.where(near, low[:, None], len(ids)).min(axis=0))
        next_[some] = np.minimum(next_[some], low)
        if (next_ == label).all():
            break
        label = next_
    roots = ids[order[label]]
    return [(int(a), int(b)) for a, b in zip(roots, ids) if a != b]


def by_key(batches, links):
    """links(table) of whole keys of sorted batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table.column("__key").to_numpy()
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at:
            yield links(table.slice(0, cut_at))
        rest = table.slice(cut_at)
    if rest is not None:
        yield links(rest)


def starts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def compare_buckets(batches):
    """Candidate links of sorted buckets: pairs at once, larger ones by matrix."""

    def links(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("__rep").to_numpy()
        sk = sketches(table.column("__sk").combine_chunks())
        starts, sizes = starts_of(table.column("__key").to_numpy())
        two = starts[sizes == 2]
        found = two[(sk[two] == sk[two + 1]).sum(axis=1) >= NEAR]
        a = np.minimum(ids[found], ids[found + 1]).tolist()
        b = np.maximum(ids[found], ids[found + 1]).tolist()
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            part = sk[s : s + n]
            near = np.concatenate([equal_bytes(part[i : i + 64], part) >= NEAR for i in range(0, n, 64)])
            for x, y in forest(ids[s : s + n], near):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    yield from by_key(batches, links)


def compare_far(batches):
    """Candidate links between the far sets of sorted groups and all sets of the group."""

    def links(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("__rep").to_numpy()
        far = table.column("__far").to_numpy(zero_copy_only=False)
        sk = sketches(table.column("__sk").combine_chunks())
        pairs: list[tuple[int, int]] = []
        for s, n in zip(*starts_of(table.column("__key").to_numpy())):
            part, some = sk[s : s + n], np.flatnonzero(far[s : s + n])
            if len(some):
                near = np.concatenate([equal_bytes(part[some[i : i + 64]], part) >= NEAR for i in range(0, len(some), 64)])
                pairs += reached(ids[s : s + n], some, near)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=LINKS)

    yield from by_key(batches, links)


def compare_leaders(batches):
    """Adds __equal, the equal bytes of a set and its bucket's leader."""
    names = ["__key", "__rep", "__sk", "__leader"]
    for batch in batches:
        if batch.num_rows:
            equal = (sketches(batch.column("__sk")) == sketches(batch.column("__lsk"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(equal, pa.int32())], names=[*names, "__equal"])


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("__key").sortWithinPartitions("__key")


def compared(rows: DataFrame) -> DataFrame:
    """Candidate links of buckets that fit a task."""
    return grouped(rows.select("__key", "__rep", "__sk")).mapInArrow(compare_buckets, "a long, b long")


def settled(open_: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate links of buckets with up to FAR far sets: in each slice of a bucket all of them meet the slice's sets."""
    few = open_.join(sizes.where(F.col("__n_far").between(1, FAR)), "__key")
    n_slices = F.ceil(F.col("__n_open") / SLICE).cast("long")
    far = F.col("__equal") < NEAR
    all_slices = F.sequence(F.lit(0).cast("long"), n_slices - 1)
    dealt = few.select("__key", "__rep", "__sk", far.alias("__far"), F.explode(F.when(far, all_slices).otherwise(F.array(F.pmod(F.xxhash64("__rep"), n_slices)))).alias("__slice"))
    return grouped(dealt.select(F.xxhash64("__key", "__slice").alias("__key"), "__rep", "__sk", "__far")).mapInArrow(compare_far, "a long, b long")


def candidates(sets: DataFrame) -> DataFrame:
    """Candidate links (a, b) between sets(__rep, __sk, __keys)."""
    first = sets.select("__rep", F.explode("__keys").alias("__key"))
    rows = cut(with_size(first).join(sets.select("__rep", "__sk"), "__rep"))
    found = compared(rows.where(F.col("__n") <= LIMIT))
    for level in range(DEPTH + 1):
        large = rows.where(F.col("__n") > LIMIT)
        if large.limit(1).count() == 0:
            return found
        large = large.select("__key", "__rep", "__sk")
        leaders = large.groupBy("__key").agg(F.min(F.struct(F.xxhash64(F.pmod("__key", F.lit(LEADER_ORDERS)), "__rep").alias("h"), F.col("__rep").alias("r"), F.col("__sk").alias("k"))).alias("l"))
        leaders = cut(leaders.select("__key", F.col("l.r").alias("__leader"), F.col("l.k").alias("__lsk")))
        led = cut(large.join(leaders, "__key").mapInArrow(compare_leaders, "__key long, __rep long, __sk binary, __leader long, __equal int"))
        found = found.unionByName(led.where(F.col("__equal") >= NEAR).select(F.col("__leader").alias("a"), F.col("__rep").alias("b")))
        open_ = led.where(F.col("__equal") < REST).drop("__leader")
        sizes = cut(open_.groupBy("__key").agg(F.sum((F.col("__equal") < NEAR).cast("long")).alias("__n_far"), F.count("*").alias("__n_open")))
        found = found.unionByName(settled(open_, sizes))
        many = sizes.where(F.col("__n_far") > FAR)
        if many.limit(1).count() == 0:
            return found
        further = open_.join(many, "__key")
        if level == DEPTH:
            return found.unionByName(in_blocks(further))
        one, two = F.xxhash64("__key", F.lit(0)), F.xxhash64("__key", F.lit(1))
        twice = F.pmod(two, F.lit(1000)) < int(1000 * SECOND)
        child = further.select("__rep", "__sk", F.explode(F.when(twice, F.array(one, two)).otherwise(F.array(one))).alias("__node"))
        at = F.pmod(F.col("__node"), F.lit(T)).cast("int")
        rows = cut(with_size(child.select("__rep", "__sk", F.xxhash64("__node", F.substring(F.col("__sk"), at + 1, F.lit(1))).alias("__key"))))
        found = found.unionByName(compared(rows.where(F.col("__n") <= LIMIT)))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Candidate links of buckets whose sets meet in blocks, each pair of blocks in one group."""
    n_blocks = F.ceil(F.col("__n_open") / SLICE).cast("long")
    deep = rows.withColumn("__block", F.pmod(F.xxhash64("__rep"), n_blocks))
    deep = deep.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    return compared(deep.withColumn("__key", F.xxhash64("__key", F.least("__block", "__other"), F.greatest("__block", "__other"))))


VERIFIED = "__rep long, __root long, __links long, __whole boolean"


def verify(table: pa.Table) -> pa.Table:
    """Exact similarities of a block, or between two blocks: per set its part's least set and the documents linked to it."""
    _, once = np.unique(table.column("__rep").to_numpy(), return_index=True)  # a row that repeats an id stands in __times
    table = table.take(pa.array(once))
    ids = table.column("__rep").to_numpy()
    times = table.column("__times").to_numpy()
    side = table.column("__block").to_numpy()
    sets = [shingle_set(t or "") for t in table.column("text").to_pylist()]
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], place[at[keep]]
    across = table.column("__i")[0] != table.column("__j")[0]
    left = np.flatnonzero(side == side[0]) if across else np.arange(len(sets))
    right = np.flatnonzero(side != side[0]) if across else left
    inter = np.zeros((len(left), len(right)), np.float64)
    width = 8192
    order = at.argsort(kind="stable")
    owner, at = owner[order], at[order]
    for first in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, (first, first + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], at[lo:hi] - first] = 1
        inter += block[left] @ block[right].T
    linked = 9 * inter >= 4 * (n[left][:, None] + n[right][None, :])
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(left, right)] = linked
    if across:
        near[np.ix_(right, left)] = linked.T
    np.fill_diagonal(near, False)
    roots = {int(b): a for a, b in forest(ids, near)}
    links = near @ times
    return pa.table({"__rep": pa.array(ids, pa.int64()), "__root": pa.array([roots.get(int(i), int(i)) for i in ids], pa.int64()), "__links": pa.array(links, pa.int64()), "__whole": table.column("__nb").combine_chunks().cast(pa.int64()).to_numpy() == 1})


def exact(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Verified rows for parts(__rep, __times, __chars, __part): every pair of a part is compared once."""
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__m"), F.sum("__chars").alias("__b"))
    dealt = parts.join(sizes, "__part").withColumn("__nb", F.ceil(F.greatest(F.col("__m") / BLOCK, F.col("__b") / BLOCK_BYTES)).cast("int"))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("__rep"), F.col("__nb")).cast("int"))
    with_text = dealt.join(docs.select(F.col("doc_id").alias("__rep"), "text"), "__rep")
    pairs = with_text.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    pairs = pairs.withColumns({"__i": F.least("__block", "__other"), "__j": F.greatest("__block", "__other")})
    pairs = pairs.select("__part", "__i", "__j", "__block", "__nb", "__rep", "__times", "text")
    return pairs.groupBy("__part", "__i", "__j").applyInArrow(verify, VERIFIED)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_links (other documents of similarity THRESHOLD or more) of every document."""
    sig = cut(signatures(docs))
    worded = sig.where("__set is not null")
    sets = worded.groupBy("__set").agg(F.min("doc_id").alias("__rep"), F.count("*").alias("__times"))
    own = worded.select(F.col("doc_id").alias("__rep"), F.col("__set").alias("__own"), "__sk", "__keys", "__chars")
    sets = cut(sets.join(own, "__rep").where("__set = __own").drop("__own").dropDuplicates(["__set"]))
    parts = components(candidates(sets.select("__rep", "__sk", "__keys")))
    parts = sets.select("__rep", "__times", "__chars").join(parts.select(F.col("node").alias("__rep"), F.col("root").alias("__part")), "__rep")
    found = cut(exact(docs, parts))
    links = found.groupBy("__rep").agg(F.sum("__links").alias("__links"))
    classes = found.where("__whole").select(F.col("__rep").alias("node"), F.col("__root").alias("root"))
    parted = found.where("not __whole and __root <> __rep").select(F.col("__root").alias("a"), F.col("__rep").alias("b"))
    if parted.limit(1).count():
        classes = classes.unionByName(components(parted))
    told = sets.select("__set", "__rep", "__times").join(links, "__rep", "left").join(classes.withColumnRenamed("node", "__rep"), "__rep", "left")
    told = told.select("__set", F.coalesce("root", "__rep").alias("class_id"), (F.col("__times") - 1 + F.coalesce("__links", F.lit(0))).alias("n_links"))
    out = sig.select("doc_id", "__set").join(cut(told), "__set", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def distinct(docs: DataFrame) -> DataFrame:
    """One row for each class, that of its least id, with the columns it came with."""
    stay = join(docs.select("doc_id", "text")).where("doc_id = class_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
    stay = cut(stay)
    left = docs.join(stay, docs["doc_id"] == stay["__id"], "left_semi")
    left = left.dropDuplicates(["doc_id"]) if stay.where("__rows > 1").limit(1).count() else left
    return left.unionByName(docs.where("doc_id is null"))
