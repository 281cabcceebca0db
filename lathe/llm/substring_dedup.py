"""Removal of repeated passages: windows of words that start in an earlier document too, found by recompression.

Texts are sequences of symbols, words at first. A round names runs of equal symbols, then pairs of a left and a right
symbol (each symbol is one or the other, by its hash). Names are hashes of what they stand for, the same in every task,
so the rounds need no exchange of dictionaries; equal stretches get equal symbols inside, wherever they stand. With each
symbol goes the stretch of words that its making depends on: neighbours that a run ends at or a pair might have been
made with. Every window that contains this stretch contains the symbol, at the same place. Two levels are made: of
windows of 13 words nearly all contain all that a symbol of level 2 depends on, a third of level 3, and almost none of level 4.

1. Each window takes the least (by hash) of the symbols whose stretch it contains as its anchor; one without any is its
   own. Equal windows have equal anchors. The anchors, about one for five words, are dealt out by symbol; those that
   occur in two documents are shared.
2. Windows with shared anchors are compared themselves: the least document of each window decides.
3. Words that such windows cover are removed from the text.

Before each exchange a task settles what it can by itself (anchors that two of its documents share, windows that an earlier
document of its own has) and sends one row on, so that a passage that very many documents have is a row for each task.
What is joined with the texts is broadcast while it is small, else shuffled.

Defined cases: a null text has no words; documents of fewer words than a window keep them all; rows with a null id are
neither compared nor changed; rows of one id are compared with smaller ids, not with each other; other columns are
ignored. Windows are told apart by 96 bits of hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.llm import common
from lathe.llm.shingles import mixed, word_hashes

WINDOW, ROUNDS = 13, 2
#: Words that are parsed at once, and rows that a task gathers before it settles and sends them.
WORDS_AT_ONCE, ROWS_AT_ONCE = 250_000, 1_000_000
#: Positions, with some room for each document, up to which a table is broadcast (64 MB).
BROADCAST_BYTES = 64 << 20
_P, _Q, _MAX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(2**64 - 1)


def recompressed(words: np.ndarray, edges: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of documents that stand one after the other (``edges``: where each begins, and the end): names, first and
    last-but-one word, and the stretch that each depends on; what lies outside a document counts as a word beyond it."""
    n_docs = len(edges) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(edges))
    below, above = edges[:-1] - 1, edges[1:] + 1
    sym, begin = words, np.arange(len(words))
    end, left, right = begin + 1, begin, begin + 1

    def before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.maximum(at - 1, 0)
        return np.where((at > 0) & (doc[k] == doc[at]), values[k], below[doc[at]])

    def after(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.minimum(at + 1, len(doc) - 1)
        return np.where((at + 1 < len(doc)) & (doc[k] == doc[at]), values[k], above[doc[at]])

    with np.errstate(over="ignore"):
        for level in range(rounds):
            salt = np.uint64(2 * level + 1) * _Q
            fresh = np.ones(len(sym), dtype=bool)
            fresh[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(sym)) - 1
            size = (last - first + 1).astype(np.uint64)
            left, right = before(left, first), after(right, last)
            sym = np.where(size > 1, mixed(sym[first] * _P + size + salt), sym[first])
            begin, end, doc = begin[first], end[last], doc[first]

            salt += _Q
            rightish = mixed(sym ^ salt) >> np.uint64(63) == 1
            opens = np.zeros(len(sym), dtype=bool)
            opens[:-1] = ~rightish[:-1] & rightish[1:] & (doc[:-1] == doc[1:])
            closes = np.zeros(len(sym), dtype=bool)
            closes[1:] = opens[:-1]
            every = np.arange(len(sym))
            alone_right = np.where(~rightish & ~opens, after(right, every), right)
            alone_left = np.where(rightish & ~closes, before(left, every), left)
            kept = np.flatnonzero(~closes)
            two = opens[kept]
            mate = np.minimum(kept + 1, len(sym) - 1)
            left, right = alone_left[kept], np.where(two, right[mate], alone_right[kept])
            sym = np.where(two, mixed(sym[kept] * _P + sym[mate] * _Q + salt), sym[kept])
            begin, end, doc = begin[kept], np.where(two, end[mate], end[kept]), doc[kept]
    return sym, begin, end, left, right


def anchors(words: np.ndarray, edges: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: where it starts, the place of its anchor (its own start if it has none) and the anchor's symbol."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), words
    sym, begin, _, left, right = recompressed(words, edges, rounds)
    # a symbol goes by all that its making depends on: so anchors of texts that share only a few words differ
    sym = mixed(sym ^ _stretch_hashes(words, np.clip(left, 0, n), np.clip(right, 0, n)))
    rank = np.full(n, _MAX)
    rank[begin] = np.minimum(mixed(sym), _MAX - np.uint64(1))
    name = np.zeros(n, dtype=np.uint64)
    name[begin] = sym
    to_left, to_right = np.full(n, 99, dtype=np.int8), np.full(n, 99, dtype=np.int8)
    to_left[begin], to_right[begin] = np.minimum(begin - left, 99), np.minimum(right - begin, 99)
    best, place = np.full(n, _MAX), np.zeros(n, dtype=np.int8)
    for o in range(window):
        m = n - o
        good = (to_left[o:] <= o) & (to_right[o:] <= window - o) & (rank[o:] < best[:m])
        at = np.flatnonzero(good)
        best[at] = rank[at + o]
        place[at] = o
    inside = np.ones(n, dtype=bool)
    for e in edges[1:]:
        inside[max(0, e - window + 1) : e] = False
    start = np.flatnonzero(inside)
    own = best[start] == _MAX
    anchor = start + np.where(own, 0, place[start])
    symbol = name[anchor]
    symbol[own] = window_hashes(words, start[own], window)[0]
    return start, np.where(own, -1 - start, anchor), symbol


def _stretch_hashes(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words: sums of words times powers of an odd number, brought to the power 0."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _P)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(pow(int(_P), -1, 2**64)))]))
        sums = np.cumsum(np.concatenate([[np.uint64(0)], mixed(words) * power[:-1]]))
        return mixed((sums[right] - sums[left]) * back[left] + (right - left).astype(np.uint64))


def window_hashes(words: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each of the windows."""
    a, b = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            w = words[start + k]
            a, b = a * _P + w, b * _Q + w
        return mixed(a), (mixed(b) >> np.uint64(32)).astype(np.uint32)


def _documents(batches, columns: int):
    """Documents some words at a time: the other columns, word hashes one after the other, and where each begins."""
    rows: list[list] = [[] for _ in range(columns)]
    hashes: list[np.ndarray] = []
    held = 0
    for b in batches:
        read = [b.column(k).to_pylist() for k in range(columns + 1)]
        for text, *rest in zip(read[columns], *read[:columns], strict=True):
            h = word_hashes(text)
            hashes.append(h)
            held += len(h)
            for k, v in enumerate(rest):
                rows[k].append(v)
            if held >= WORDS_AT_ONCE:
                yield rows, np.concatenate(hashes), np.cumsum([0, *map(len, hashes)])
                rows, hashes, held = [[] for _ in range(columns)], [], 0
    if hashes:
        yield rows, np.concatenate(hashes), np.cumsum([0, *map(len, hashes)])


def _unlike(*columns: np.ndarray) -> np.ndarray:
    """Keys for rows that are settled: they go along, with keys of their own."""
    with np.errstate(over="ignore"):
        out = np.uint64(11)
        for c in columns:
            out = mixed(out * _P + c.astype(np.int64).view(np.uint64))
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, version, place): anchors that another document has too; from (doc_id, version, text)."""

    def run(batches):
        parts: list[tuple] = []
        held = 0

        def settled():
            sym, doc, version, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, sym))
            sym, doc, version, place = sym[order], doc[order], version[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            size = np.diff(np.append(head, len(sym)))
            last = head + size - 1
            many = np.repeat(doc[head] != doc[last], size)
            sent = ~many
            sent[head] = True  # one row of those that are shared here tells other tasks so
            alone = np.flatnonzero(sent)
            rest = np.flatnonzero(~sent)
            keys = np.concatenate([sym[alone], _unlike(doc[rest], version[rest], place[rest])])
            take = np.concatenate([alone, rest])
            by_text = np.argsort(order[take])  # rows of a document together shuffle smaller
            keys, take = keys[by_text], take[by_text]
            for lo in range(0, len(take), 100_000):
                t = take[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([_signed(keys[lo : lo + 100_000]), pa.array(doc[t]), pa.array(version[t]), pa.array(place[t].astype(np.int32)), pa.array(many[t])], names=["symbol", "doc_id", "version", "place", "shared"])

        for (doc_id, version), words, edges in _documents(batches, 2):
            start, place, symbol = anchors(words, edges, window)
            if not len(start):
                continue
            d = np.searchsorted(edges, start, side="right") - 1
            base = edges[:-1][d]
            local = np.where(place < 0, place + base, place - base)
            keep = np.concatenate([[True], (local[1:] != local[:-1]) | (d[1:] != d[:-1])])
            # a place can be taken again after another
            key = d[keep] * (1 << 40) + local[keep]
            _, at = np.unique(key, return_index=True)
            d, local, symbol = d[keep][at], local[keep][at], symbol[keep][at]
            parts.append((symbol, np.array(doc_id, dtype=np.int64)[d], np.array(version, dtype=np.int64)[d], local))
            held += len(local)
            if held >= ROWS_AT_ONCE:
                yield from settled()
                parts, held = [], 0
        if parts:
            yield from settled()

    found = common.in_batches(docs.where("doc_id is not null").select("doc_id", "version", "text"), run, "symbol long, doc_id long, version long, place int, shared boolean")
    same = Window.partitionBy("symbol")
    told = found.select("doc_id", "version", "place", (F.max("shared").over(same) | (F.min("doc_id").over(same) < F.max("doc_id").over(same))).alias("_shared"))
    return told.where("_shared").select("doc_id", "version", "place")


def _places(df: DataFrame, name: str) -> DataFrame:
    """A stored table (doc_id, version, places): at most as many places as a document has words."""
    return common.stored(df.groupBy("doc_id", "version").agg(F.collect_list("place").alias("places")), name)


def _runs(df: DataFrame, name: str) -> DataFrame:
    """A stored table (doc_id, version, places): first and last of each run of places, one after the other."""
    p = F.col("_sorted")
    first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
    found = df.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("_sorted"))
    return common.stored(found.select("doc_id", "version", F.flatten(F.zip_with(first, last, lambda a, b: F.array(a, b))).alias("places")), name)


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    small = (places.agg(F.sum(F.size("places") * 4 + 48)).first()[0] or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(places) if small else places, ["doc_id", "version"], how)


def repeated_windows(docs: DataFrame, shared: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, version, place): windows that start in a document with a smaller id too; ``shared``: anchors by document."""

    def run(batches):
        parts: list[tuple] = []
        held = 0

        def settled():
            a, b, doc, version, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, b, a))
            a, b, doc, version, place = a[order], b[order], doc[order], version[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            gone = doc > np.repeat(doc[head], np.diff(np.append(head, len(a))))
            keys = np.where(gone, _unlike(doc, version, place), a)
            by_text = np.argsort(order)
            keys, b, doc, version, place, gone = (x[by_text] for x in (keys, b, doc, version, place, gone))
            for lo in range(0, len(keys), 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([_signed(keys[s]), pa.array(b[s].view(np.int32)), pa.array(doc[s]), pa.array(version[s]), pa.array(place[s].astype(np.int32)), pa.array(gone[s])], names=["a", "b", "doc_id", "version", "place", "gone"])

        for (doc_id, version, places), words, edges in _documents(batches, 3):
            start, place, _ = anchors(words, edges, window)
            if not len(start):
                continue
            d = np.searchsorted(edges, start, side="right") - 1
            base = edges[:-1][d]
            wide = 1 << 40
            wanted = np.concatenate([np.asarray(p, dtype=np.int64) + k * wide for k, p in enumerate(places)])
            at = start[np.isin(np.where(place < 0, place + base, place - base) + d * wide, wanted)]
            if not len(at):
                continue
            d = np.searchsorted(edges, at, side="right") - 1
            parts.append((*window_hashes(words, at, window), np.array(doc_id, dtype=np.int64)[d], np.array(version, dtype=np.int64)[d], at - edges[:-1][d]))
            held += len(at)
            if held >= ROWS_AT_ONCE:
                yield from settled()
                parts, held = [], 0
        if parts:
            yield from settled()

    joined = _with_places(docs.where("doc_id is not null"), shared, "inner").select("doc_id", "version", "places", "text")
    found = common.in_batches(joined, run, "a long, b int, doc_id long, version long, place int, gone boolean")
    least = F.min("doc_id").over(Window.partitionBy("a", "b"))
    return found.select("doc_id", "version", "place", (F.col("gone") | (least < F.col("doc_id"))).alias("_gone")).where("_gone").select("doc_id", "version", "place")


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: the words that are left, joined by spaces."""
    return _removed(docs, text_col, id_col, window, False)


def _removed(docs: DataFrame, text_col: str, id_col: str, window: int, digest: bool) -> DataFrame:
    docs = common.texts(docs, id_col, text_col)
    n, ids = docs.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    # texts that share an id are told apart
    docs = docs.withColumn("version", F.lit(0).cast("long") if n == ids else F.xxhash64("text"))
    shared = _places(shared_anchors(docs, window), "anchors")
    gone = _runs(repeated_windows(docs, shared, window), "windows")
    last = "kept_sha256" if digest else "kept"

    def run(batches):
        for b in batches:
            rows = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = words
                if places:
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.array(places)
                    np.add.at(steps, at[::2], 1)
                    np.add.at(steps, at[1::2] + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                out = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", last])

    return common.in_batches(_with_places(docs, gone, "left").select("doc_id", "text", "places"), run, f"doc_id long, n_words long, n_removed long, {last} string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(common.documents(spark, sf_dir), "text", "doc_id", WINDOW, True)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
g AS (SELECT x.doc_id, list(i) AS gone FROM x JOIN m ON x.k = m.k WHERE least < x.doc_id GROUP BY x.doc_id),
c AS (SELECT d.doc_id, w, list_distinct(flatten(list_transform(gone, lambda i: range(i, i + 13)))) AS covered FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
k AS (SELECT doc_id, w, CASE WHEN covered IS NULL THEN w ELSE list_filter(w, lambda z, j: NOT list_contains(covered, j)) END AS kept FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
