"""Similarity self-join of documents: n-gram Jaccard of at least a threshold, with Bayesian pruning of candidates.

1. Each document becomes its set of word shingles, MinHash values of it and band hashes (``signatures``). Documents with
   equal sets form a class; classes are joined, copies are counted.
2. Classes that share a band hash are candidates. A pair belongs to the first band that it shares, so it is compared
   once. There the MinHash values (a byte each) are compared step by step; a pair goes as soon as the posterior
   probability that its Jaccard reaches the threshold, given the matches so far, falls below the tolerance.
3. Classes with pairs that are left go on to the same buckets with their shingles, where these pairs, and no others, are
   verified exactly. Connected components are taken of verified links alone.

Large buckets are cut into blocks by hash; each pair of blocks is a group of bounded size and its own task's
work. No pairs are emitted: a group gives counts of links and a forest of them for each of its members, so that results
grow with documents also where a group of near copies is large. Two classes with a Jaccard of 0.8 share none of the 32
bands of 4 values with probability 4e-8; the tolerance is 1e-9.

The result has a row for each document: its class in terms of links (the least id of all documents that links connect
it with), the number of documents it is linked with, copies included, and the number of copies with the same shingles.

Defined cases: documents without words are linked with nothing; those with fewer words than a shingle have one shingle,
all their words; rows with a null id are linked with nothing and have a null class; repeated rows count as copies of each
other; other columns are ignored. Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lathe.llm import common
from lathe.llm.components import components
from lathe.llm.shingles import MinHash, shingle_set

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
HASHES, ROWS = 128, 4
#: Hashes compared in a step.
STEP = 16
#: Most members, and most shingles, of a block.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Up to so many pairs of ids and hashes, 16 bytes each, are broadcast (8 MB, some 40 in the JVM's table); more are joined by shuffle.
BROADCAST_IDS = 500_000
_BITS = 1 << 15


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float, hashes: int, step: int) -> np.ndarray:
    """For 0, step, 2 step... compared bytes: the fewest matches with which a pair stays.

    The prior of the Jaccard is uniform; a byte matches with probability j + (1 - j) / 256.
    """
    j = (np.arange(2000) + 0.5) / 2000
    p = j + (1 - j) / 256
    out = [0]
    for n in range(step, hashes + 1, step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = like[:, j >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(posterior >= tolerance)))
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, sig: np.ndarray, least: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows ``a`` and ``b`` of ``sig``) that are left after all comparisons."""
    matches = np.zeros(len(a), dtype=np.int16)
    for k in range(1, len(least)):
        if not len(a):
            break
        part = slice((k - 1) * step, k * step)
        matches = matches + (sig[a, part] == sig[b, part]).sum(axis=1, dtype=np.int16)
        left = matches >= least[k]
        a, b, matches = a[left], b[left], matches[left]
    return a, b


def pairs_of(n: int, first: np.ndarray | None):
    """Pairs of rows, in portions: all of ``n``, or, if ``first`` tells rows of a first block from a second, those across."""
    if first is None:
        for i in range(0, n, 256):
            rows = np.arange(i, min(i + 256, n))
            a, b = np.meshgrid(rows, np.arange(n), indexing="ij")
            keep = a < b
            yield a[keep], b[keep]
    else:
        one, two = np.flatnonzero(first), np.flatnonzero(~first)
        for i in range(0, len(one), 256):
            a, b = np.meshgrid(one[i : i + 256], two, indexing="ij")
            yield a.ravel(), b.ravel()


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that pairs connect each row with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose Jaccard reaches the threshold: common shingles counted on bit rows, some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    if not len(a):
        return a, b
    fit = np.minimum(sizes[a], sizes[b]) >= np.ceil(threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
    a, b = a[fit], b[fit]
    rows = np.unique(np.concatenate([a, b]))
    if not len(rows):
        return a, b
    every = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    place = np.zeros(len(sets), dtype=np.int64)
    place[rows] = np.arange(len(rows))
    common_ = np.zeros(len(a), dtype=np.int64)
    for low in range(0, int(column[-1]) + 1, _BITS):
        x, y = np.searchsorted(column, (low, low + _BITS))
        bits = np.zeros((len(rows), _BITS), dtype=bool)
        bits[owner[x:y], column[x:y] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(a), 2048):
            common_[k : k + 2048] += np.bitwise_count(words[place[a[k : k + 2048]]] & words[place[b[k : k + 2048]]]).sum(axis=1, dtype=np.int64)
    union = sizes[a] + sizes[b] - common_
    good = common_ >= threshold * union - 1e-9 * union
    return a[good], b[good]


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, hashed: bool = False) -> DataFrame:
    """A stored table (doc_id, class, n, sig, bands); n is the number of shingles, 0 without words. ``hashed`` adds text_hash."""
    more = ["text_hash"] if hashed else []

    def run(batches):
        minhash = MinHash(HASHES, ROWS)
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            some = [s for s in sets if len(s)]
            values = minhash.values(some) if some else np.zeros((0, HASHES), dtype=np.uint64)
            sig, bands = (values >> np.uint64(56)).astype(np.uint8), minhash.band_hashes(values).view(np.int64)
            rows, k = [], 0
            for s in sets:
                if len(s):
                    rows.append((xxh64_intdigest(s.tobytes()) - 2**63, len(s), sig[k].tobytes(), bands[k]))
                    k += 1
                else:
                    rows.append((None, 0, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)), *map(b.column, more)], names=["doc_id", "class", "n", "sig", "bands", *more])

    docs = common.texts(docs, id_col, text_col)
    docs = docs.withColumn("text_hash", F.xxhash64("text")) if hashed else docs
    return common.stored(common.in_batches(docs, run, "doc_id long, class long, n int, sig binary, bands array<long>" + ", text_hash long" * hashed), "signatures")


def _blocked(df: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """Rows with ``_key`` (group, i, j) for each pair of blocks that they take part in, and ``_first``: of block i; null if i = j.

    With ``blocks`` = 1 there is one group, of all pairs.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), member), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    spread = df.withColumn("_own", own).withColumn("_other", other)
    first = F.when(F.col("_own") == F.col("_other"), F.lit(None).cast("boolean")).otherwise(F.col("_own") < F.col("_other"))
    return spread.withColumn("_key", F.struct(F.col(group), F.least("_own", "_other"), F.greatest("_own", "_other"))).withColumn("_key", F.xxhash64("_key")).withColumn("_first", first).drop("_own", "_other")


def _grouped(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """Runs ``work`` on groups of equal ``_key``, whole: columns as arrays. Groups are bounded, and several share a call's overhead."""
    ordered = df.select("_key", "_first", *columns).repartition("_key").sortWithinPartitions("_key")

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def done(table: pa.Table):
            keys = table.column("_key").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            yield from work(table, [*cuts, len(keys)])

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            if keys[-1] != last and held or len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                held.append(b.slice(0, cut))
                if sum(x.num_rows for x in held):
                    yield from done(pa.Table.from_batches([x for x in held if x.num_rows]))
                held = []
                b = b.slice(cut)
            held.append(b)
            last = keys[-1]
        if sum(x.num_rows for x in held):
            yield from done(pa.Table.from_batches([x for x in held if x.num_rows]))

    return common.in_batches(ordered, run, schema)


def _first_of(table: pa.Table, x: int, y: int) -> np.ndarray | None:
    side = table.column("_first").slice(x, y - x)
    return None if side.null_count else np.array(side.to_pylist(), dtype=bool)


def owned(a: np.ndarray, b: np.ndarray, bands: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no band before the one they meet in, ``band`` of row ``a``."""
    for k in range(int(band.max(initial=0))):
        if not len(a):
            break
        left = (bands[a, k] != bands[b, k]) | (band[a] <= k)
        a, b = a[left], b[left]
    return a, b


class _Group:
    """Columns of a table of groups as arrays, and their pairs that are left after pruning."""

    def __init__(self, table: pa.Table, threshold: float, tolerance: float):
        self.table, n = table, table.num_rows
        self.least = least_matches(threshold, tolerance, HASHES, STEP)
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(n, HASHES)
        self.bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), dtype=np.int64).reshape(n, HASHES // ROWS)
        self.band = table.column("band").to_numpy()

    def left(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return survivors(*owned(a, b, self.bands, self.band), self.sig, self.least)

    def pairs(self, x: int, y: int):
        """Of the group in rows ``x`` to ``y``, in portions."""
        for a, b in pairs_of(y - x, _first_of(self.table, x, y)):
            yield self.left(a + x, b + x)


def candidates(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A stored table (_key, _first, class, band): classes with pairs that pruning leaves, by the group in which these are; from (class, n, sig, bands)."""
    keys = classes.select("class", "n", F.posexplode("bands").alias("band", "_hash")).select("class", "n", "band", F.xxhash64("band", "_hash").alias("bucket"))
    full = keys.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    full = full.select("bucket", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = keys.drop("n").join(full, "bucket").join(classes.select("class", "sig", packed_bands()), "class")

    def work(table, cuts):
        group = _Group(table, threshold, tolerance)
        some = np.zeros(table.num_rows, dtype=bool)
        small: list[int] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x == 2 and table.column("_first")[x].as_py() is None:
                small.append(x)
                continue
            for a, b in group.pairs(x, y):
                some[a] = some[b] = True
        if small:
            a, b = group.left(np.array(small), np.array(small) + 1)
            some[a] = some[b] = True
        yield from table.select(["_key", "_first", "class", "band"]).filter(pa.array(some)).to_batches()

    return common.stored(_grouped(_blocked(members, "bucket", "blocks", "class"), ["class", "band", "sig", "bands"], work, "_key long, _first boolean, class long, band int"), "candidates")


def packed_bands() -> Column:
    """The band hashes as bytes, lowest first."""
    return F.unhex(F.array_join(F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("bands")


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined on ``doc_id`` with (doc_id, class), which is broadcast while it is small."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def links(docs: DataFrame, classes: DataFrame, found: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A stored table (class, other, n_links): verified links of each class by group; ``other`` is a class it is connected with, or itself."""
    member = classes.join(found.select("class").distinct(), "class")
    read = with_ids(common.texts(docs).where("doc_id is not null"), member.select("doc_id", "class"))

    def sets(batches):
        for b in batches:
            own = [shingle_set(t or "", words) for t in b.column("text").to_pylist()]
            same = [len(s) and xxh64_intdigest(s.tobytes()) - 2**63 == c for s, c in zip(own, b.column("class").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([s.tobytes() for s in own], pa.binary())], names=["class", "shingles"]).filter(pa.array(map(bool, same)))

    own = common.in_batches(read.select("class", "text"), sets, "class long, shingles binary").dropDuplicates(["class"])
    placed = found.join(own.join(classes.select("class", "copies", "sig", packed_bands()), "class"), "class")

    def work(table, cuts):
        group = _Group(table, threshold, tolerance)
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        shingles = table.column("shingles")
        for x, y in zip(cuts, cuts[1:], strict=False):
            sets_ = [np.frombuffer(s, dtype=np.uint64) for s in shingles.slice(x, y - x).to_pylist()]
            count, pairs = np.zeros(y - x, dtype=np.int64), []
            own = copies[x:y]
            for a, b in group.pairs(x, y):
                a, b = verified(a - x, b - x, sets_, threshold)
                np.add.at(count, a, own[b])
                np.add.at(count, b, own[a])
                pairs.append((a, b))
            some = np.flatnonzero(count)
            root = forest(y - x, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x:y][some], pa.int64()), pa.array(ids[x:y][root[some]], pa.int64()), pa.array(count[some], pa.int64())], names=["class", "other", "n_links"])

    return common.stored(_grouped(placed, ["class", "band", "copies", "sig", "bands", "shingles"], work, "class long, other long, n_links long"), "links")


def similar(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashed: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row of ``docs``; ``hashed`` adds text_hash, the xxhash64 of its text."""
    docs = common.texts(docs, id_col, text_col)
    signed = signatures(docs, words=words, hashed=hashed)
    more = ["text_hash"] if hashed else []
    known = signed.where("doc_id is not null and n > 0")
    classes = common.stored(known.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    found = links(docs, classes, candidates(classes, threshold, tolerance), words, threshold, tolerance)
    linked = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")), "linked")
    root = linked.select(F.col("node").alias("class"), "root").union(linked.select(F.col("root").alias("class"), "root").distinct())
    ids = classes.select("class", "doc_id", "copies")
    # stored, so that a root of very many classes can be split in the join
    least = common.stored(root.join(ids, "class").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    count = found.groupBy("class").agg(F.sum("n_links").alias("links"))
    facts = ids.join(root.join(least, "root").select("class", "least"), "class", "left").join(count, "class", "left")
    facts = facts.select("class", F.coalesce("least", "doc_id").alias("_least"), F.coalesce("links", F.lit(0)).alias("_links"), "copies")
    # stored as well: a class of very many copies is split
    facts = common.stored(facts, "facts")
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"), *more).join(facts, "class", "left")
    return out.select("doc_id", F.coalesce("_least", "doc_id").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), *more)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without documents whose class has one with a lesser id.

    Rows with a null id stay. Of rows that repeat an id and its text one stays; of rows that repeat an id with unlike texts,
    each stays or goes by its own text.
    """
    found = common.stored(similar(docs, hashed=True), "similar")
    gone = found.where("doc_id is not null and class_id < doc_id").select(F.col("doc_id").alias("__lathe_id"), F.col("text_hash").alias("__lathe_hash")).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = (F.col("doc_id").cast("long") == F.col("__lathe_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__lathe_hash"))
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    n, ids = found.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.documents(spark, sf_dir))
