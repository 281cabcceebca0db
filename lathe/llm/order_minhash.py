"""Document fingerprints by Order MinHash, in DataFrame functions alone.

The items of a text are its word k-mers, each with its occurrence number (how often it
stood in the text before). For each of ``entries`` hash functions the ``l`` items of the whole text with the least
hashes are selected, put back in text order, and their k-mers hashed as a tuple. A moved or replaced passage changes not
only which k-mers there are but the order of those selected, so the signature follows edit distance, not just the set
of k-mers. Likeness is the share of equal entries.

The hash functions are offsets of ``hashes`` independent ones: with H of 63 bits and c one of ``entries / hashes``
points at even distances, an item's hash is (H - c) mod 2 ** 63. Each of them alone is a uniform hash of all items, so
that an entry is equal with the probability that Order MinHash gives it. Sorted once by H, the least items from any
point on are those that follow it; two functions of one H are independent but for points with less than ``l`` items in between.
In the sorted array an item is its hash, then its place in the low bits, as many as the text's own number of items needs:
54 bits are left of a hash for texts of 500 words, and 42 for a text of two million; no text is too long.

Defined cases: a null or empty text, or one of white space only, has no items and an empty signature; texts with fewer
than k words have one item, all their words; two texts without items are alike (1.0), one with and one without unlike
(0.0); equal texts have equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.llm import common

K, L, SEED = 3, 2, 20260
ENTRIES, HASHES = 32, 4
_MAX = (1 << 63) - 1
_WHITE = " \t\n\x0b\f\r"


def ordered(df: DataFrame, text_col: str, out: str, k: int = K, l: int = L, entries: int = ENTRIES, hashes: int = HASHES, seed: int = SEED) -> DataFrame:  # noqa: E741
    """``df`` with ``out``, the signature: array<long> of ``entries`` entries, the number of each in its high bits; empty without items."""
    bits = (entries - 1).bit_length()
    if entries != 1 << bits or not 0 < bits <= 10 or hashes < 1 or entries % hashes:
        raise ValueError("entries must be a power of two, from 2 to 2 ** 10, and a multiple of hashes")
    words, kmers, low, high, packed, again, heads, codes, places, halves, *own = (f"_{out}_{x}" for x in ("words", "kmers", "low", "high", "packed", "again", "heads", "codes", "places", "halves", *range(hashes)))
    whole = F.lit(_MAX)
    none, empty = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    place = lambda x: x.bitwiseAND(F.col(low)).cast("int")
    ranked = lambda hash_, i: hash_.bitwiseAND(F.col(high)).bitwiseOR(i)
    text = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WHITE))
    df = df.withColumn(words, F.when(text != "", F.split(text, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    df = df.withColumn(kmers, F.transform(first, lambda x, i: F.xxhash64(F.lit(seed), x, *(F.get(words, i + j) for j in range(1, k))).bitwiseAND(whole))).drop(words)
    wide = F.length(F.bin(F.size(kmers).cast("long")))
    df = df.withColumn(low, F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1).withColumn(high, whole - F.col(low))
    # Of texts that repeat k-mers: sorted by k-mer, then place, equal ones stand together. The first keeps the k-mer's code, the others take their number in.
    repeats = F.size(F.array_distinct(kmers)) < F.size(kmers)
    df = df.withColumn(packed, F.when(repeats, F.sort_array(F.transform(kmers, ranked))).otherwise(none))
    same = lambda a, b: a.bitwiseXOR(b) <= F.col(low)
    df = df.withColumn(again, F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1))))
    numbers = F.when(F.size(again) > 0, F.sequence(F.lit(0), F.size(again) - 1)).otherwise(empty)
    df = df.withColumn(heads, F.filter(numbers, lambda i: (i == 0) | ~same(F.get(again, i), F.get(again, i - 1))))
    run = lambda i, j: F.slice(again, i + 1, F.coalesce(F.get(heads, j + 1), F.size(again)) - i)
    counted = F.flatten(F.transform(heads, lambda i, j: F.transform(run(i, j), lambda x, m: F.xxhash64(F.get(kmers, place(x)), m + 1).bitwiseAND(whole))))
    df = df.withColumn(places, F.when(F.size(again) > 0, F.transform(F.concat(F.array_except(packed, again), again), place)))
    once = F.transform(F.slice(places, F.lit(1), F.size(places) - F.size(again)), lambda i: F.get(kmers, i))
    df = df.withColumn(codes, F.when(F.size(again) > 0, F.concat(once, counted)).otherwise(F.col(kmers))).drop(packed, again, heads)
    df = df.withColumn(halves, F.transform(F.sequence(F.length(F.bin(F.size(codes).cast("long"))) - 1, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b)))
    df = df.withColumns({name: F.sort_array(_by_hash(codes, ranked, h)) for h, name in enumerate(own)})
    found = [_entries(name, h * (entries // hashes), entries // hashes, bits, codes, kmers, places, halves, place, l, seed) for h, name in enumerate(own)]
    return df.withColumn(out, F.when(F.size(codes) > 0, F.concat(*found)).otherwise(none)).drop(kmers, low, high, codes, places, halves, *own)


def _by_hash(codes: str, ranked: Callable, h: int) -> Column:
    return F.transform(codes, lambda x, i: ranked(F.xxhash64(x, F.lit(h)), i))


def _entries(own: str, number: int, each: int, bits: int, codes: str, kmers: str, places: str, halves: str, place: Callable, l: int, seed: int) -> Column:  # noqa: E741
    """The entries of the ``each`` offsets of a hash, numbered from ``number`` on; ``own``: the items sorted by it."""
    n = F.size(codes)
    step = (1 << 63) // each

    def entry(r: Column) -> Column:
        point = r * F.lit(step) + F.lit(step // 2)
        # how many items are below the point: by halving
        at = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(own, at + half - 1) < point, at + half).otherwise(at))
        spots = F.transform(F.sequence(at, at + F.least(F.lit(l), n) - 1), lambda i: _placed(places, place(F.get(own, i % n))))
        tupled = F.aggregate(F.sort_array(spots), F.lit(seed + 1).cast("long"), lambda acc, x: F.xxhash64(acc, F.get(kmers, x)))
        return F.shiftleft(r.cast("long") + number, 64 - bits).bitwiseOR(F.shiftrightunsigned(tupled, bits))

    return F.transform(F.array(*(F.lit(r).cast("long") for r in range(each))), entry)


def _placed(places: str, i: Column) -> Column:
    return F.coalesce(F.get(places, i), i)


def fingerprint(signature: Column) -> Column:
    """The signature as text: 16 hex digits for each entry, joined by colons."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries."""
    some = F.greatest(F.size(a), F.size(b))
    return F.when(some == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / some)


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], list[int | None]]:
    """Least keys of about ``n`` ranges of ids with like numbers of rows, and for each the least key of the range after."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cuts = docs.select(key.alias("key")).agg(F.percentile_approx("key", [i / n for i in range(n)], 10 * n).alias("cuts")).first()[0]
    if not cuts:
        return [], []
    cuts = sorted(set(cuts))
    low = docs.select(_range_of(key, cuts).alias("range"), key.alias("key")).groupBy("range").agg(F.min("key").alias("key")).orderBy("key").collect()
    return cuts, [r["key"] for r in low]


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at most ``key``: by halving, in as many steps as their number has bits."""
    halves = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    known = F.from_json(F.lit(str(cuts)), "array<bigint>")
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(known, at + step - 1) <= key), at + step).otherwise(at))


#: Bytes of text in a range.
RANGE_BYTES = 16 << 20


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``work(docs)`` (doc_id, text, ...) with ``next_<column>`` of the row with the next id, after the last of the first.

    Ids are cut into ranges of like size, as many as the texts' bytes need, each a task of its own and sorted by itself. The
    least row of a range is also sent to the end of the range before it, so that nothing has to be looked up elsewhere: the
    rows are shuffled once, before ``work``, which adds columns row by row. Rows of one id follow each other by text. Per
    range one key reaches the driver.
    """
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cuts, low = _ranges(docs, ranges)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    keyed = docs.withColumn("_key", key).withColumn("_range", _range_of(F.col("_key"), cuts))
    before = dict(zip(low, [low[-1], *low[:-1]], strict=True)) if low else {}
    # the range before is found by its least key
    table = F.from_json(F.lit(str({str(k): v for k, v in before.items()}).replace("'", '"')), "map<string, bigint>")
    earlier = F.when(F.map_contains_key(table, F.col("_key").cast("string")), _range_of(F.try_element_at(table, F.col("_key").cast("string")), cuts))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(earlier.alias("range"), F.lit(1).alias("guest"))
    placed = keyed.withColumn("_at", F.explode(F.array_compact(F.array(own, F.when(earlier.isNotNull(), guest))))).select("*", F.col("_at.range").alias("_place"), F.col("_at.guest").alias("_guest")).drop("_at", "_range")
    placed = work(placed.repartitionByRange(max(1, len(low)), "_place").sortWithinPartitions("_place", "_guest", "_key", "text"))
    order = Window.partitionBy("_place").orderBy("_guest", "_key", "text")
    led = placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("_guest = 0").drop("_key", "_place", "_guest")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters: int) -> DataFrame:
    """(doc_id, signature, fingerprint) for each row."""
    found = ordered(common.texts(docs, id_col, text_col), "text", "signature", **parameters)
    return found.select("doc_id", "signature", fingerprint(F.col("signature")).alias("fingerprint"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = with_next(common.texts(common.documents(spark, sf_dir)), ["text", "signature"], work=lambda df: ordered(df, "text", "signature"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    paired = ordered(paired.drop("next_text", "text"), "_edited", "edited_signature")
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
