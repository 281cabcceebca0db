"""Duplicates, ranks and picks. Which row is kept is always told by explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.text import normal_form


def _columns(keys) -> list:
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def keep_first(df: DataFrame, keys, order: list, drop_blank: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; with ``drop_blank`` rows whose key is null or empty go."""
    if drop_blank:
        df = df.where(F.coalesce(F.col(drop_blank).cast("string"), F.lit("")) != "")
    w = Window.partitionBy(*_columns(keys)).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_last(df: DataFrame, keys, order: list[str]) -> DataFrame:
    """The last row of each key: later rows overwrite earlier ones."""
    return keep_first(df, keys, [F.col(o).desc() if isinstance(o, str) else o for o in order])


def top_k(df: DataFrame, group, order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*_columns(group)).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def near_key(x: Column, chars: int = 60) -> Column:
    """How near-duplicates are told: the first characters of the normal form."""
    return F.substring(normal_form(x), 1, chars)


def numbered(df: DataFrame, group, order: list, out: str = "ordinal") -> DataFrame:
    """Places from 0 within each group."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*_columns(group)).orderBy(*order)) - 1).cast("long"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(key)).cast("long").alias("duplicates"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash: the same ones in each run."""
    return df.orderBy(shuffled(F.col(key), seed), F.col(key)).limit(n)


def shuffled(key: Column, seed: int = 42) -> Column:
    """What to order by instead of a shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_in_three(df: DataFrame, order: list, out: str = "shard") -> DataFrame:
    """Contiguous thirds by position; the rest goes to the last. Positions come from counts of ranges, not from one sorted task."""
    n = df.count()
    placed = global_position(df, order)
    return placed.withColumn(out, F.least(F.floor(F.col("_position") / F.lit(max(1, n // 3))), F.lit(2)).cast("int")).drop("_position")


def global_position(df: DataFrame, order: list[str], out: str = "_position") -> DataFrame:
    """Positions from 0 by unique order columns: the rank within a range of the first column plus the rows of the ranges before."""
    first = order[0]
    cuts = [c for c in (df.agg(F.percentile_approx(F.col(first).cast("double"), [i / 64 for i in range(1, 64)], 1000)).first()[0] or [])]
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(first).cast("double"))))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(out, (F.col("_inner") + F.col("_before")).cast("long")).drop("_range", "_inner", "_before")


def union_in_order(frames: list[DataFrame], out: str = "source_ord") -> DataFrame:
    """All rows; ``out`` tells which frame they are from. Missing columns are null."""
    parts = [f.withColumn(out, F.lit(i)) for i, f in enumerate(frames)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    return found


def missing_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
