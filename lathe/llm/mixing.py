"""Mixing sources to target weights: sizes per source, repetition rates, whole copies and one chance copy.

The tokens of each source are summed; a source's rate is its target over its size. Each document is emitted
floor(rate) times, and once more if a hash of its id and the seed, as a number in [0, 1), is below the fraction.
Nothing is drawn, so reruns agree, and no row depends on another beyond the sums per source.

Targets: sources share the whole by weight, none above ``most`` times its own size; what is cut off goes to the
others by weight until none is above. With c = most * size, the target is min(c, level * weight) for the one level at
which the targets sum to the whole: sources whose c is below level * weight are closed, the others share what is left by
weight, which raises the level, until no further one closes. Each of these steps is a sum over sources, and places in the
order of names come from sorted ranges, so that there may be as many sources as there are hosts.

Defined cases: a null text has size 0; a null source is a source of its own, the last; sources of size 0 have target 0
and rate 0 (their documents are not emitted by ``mix``); repeated rows share their fate; an empty table gives an empty
table; other columns are carried along by ``mix``; rows with a null id draw by their text, so that copies among them share a draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

SEED = "mix-1"
MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: Up to so many sources their rates are broadcast (well under 10 MB); more are joined by shuffle, where Spark splits hot ones.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words, counted in the JVM: stretches of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str = SEED, text: Column | None = None) -> Column:
    """A number in [0, 1) from 32 bits of a hash of the seed and the id, or, where that is null, the text."""
    other = F.lit("null") if text is None else F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), other))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def placed(sources: DataFrame, out: str = "place") -> DataFrame:
    """A stored table: ``sources`` with their place by code point from 0, null last: the place in a sorted range and the sizes of the ranges before.

    A size for each range of sources reaches the driver.
    """
    ranged = common.stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r["part"], at))
        at += r["n"]
    offsets = ranged.sparkSession.createDataFrame(before, "_part int, _before long")
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part.cast("int")).join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + inner).cast("long")).drop("_part", "_before", "_at")


def targets(sources: DataFrame, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row for each source.

    ``weight`` may use ``place``, the place of the source by code point from 0, null last; 1, 2, 3 in turn by default.
    """
    weight = F.lit(1) + F.col("place") % 3 if weight is None else weight
    known = placed(sources).withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * most).cast("double"))
    level, closed = 0.0, -1
    while True:
        shut = F.col("most") < F.lit(level) * F.col("weight")
        whole, gone, share, n = known.agg(F.sum("source_size").cast("double"), F.sum(F.when(shut, F.col("most")).otherwise(0.0)), F.sum(F.when(shut, 0.0).otherwise(F.col("weight"))), F.count_if(shut)).first()
        if not share or n == closed:
            break
        level, closed = (whole - gone) / share, n
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return known.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``targets`` of the documents' sources, stored: few rows, used by each document. Sums are partial before they are shuffled."""
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return common.stored(targets(sizes, most), "rates")


def with_rates(docs: DataFrame, found: DataFrame, source_col: str = "source") -> DataFrame:
    """``docs`` and, as ``_source_size``, ``_target`` and ``_rate``, what holds for their source."""
    few = found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = found.select(F.col("source").alias("__lathe_source"), F.col("source_size").alias("__lathe_source_size"), F.col("target").alias("__lathe_target"), F.col("rate").alias("__lathe_rate"))
    return docs.join(F.broadcast(side) if few else side, docs[source_col].cast("string").eqNullSafe(side["__lathe_source"]), "inner").drop("__lathe_source")


def copies(rate: Column, doc_id: Column, seed: str = SEED, text: Column | None = None) -> Column:
    return (F.floor(rate) + (chance(doc_id, seed, text) < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    joined = with_rates(docs, rates(docs, source_col, text_col, most), source_col)
    taken = joined.withColumn("__lathe_copies", copies(F.col("__lathe_rate"), F.col(id_col), seed, F.col(text_col))).where("__lathe_copies > 0")
    return taken.withColumn("__lathe_copy", F.explode(F.sequence(F.lit(1), F.col("__lathe_copies")))).select(*docs.columns)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    drawn = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"))
    sized = with_rates(drawn, rates(docs))
    taken = F.col("size") * copies(F.col("__lathe_rate"), F.col("doc_id"), text=F.col("text"))
    return sized.select("doc_id", "size", F.col("__lathe_source_size").alias("source_size"), F.col("__lathe_target").alias("target"), taken.alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most,
      row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - (sum(most) OVER (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING) - most))
      / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tried FROM p),
v AS (SELECT tried FROM l WHERE tried * weight <= most ORDER BY most / weight, place LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT tried FROM v) * weight, most)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN CAST('0x' || md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, ''))))[1:8] AS BIGINT) / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
