"""Means that skip nulls, summaries at several granularities, counts and medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ["invariance", "directional", "shortcut"]


def reliability(score: Column, digits: int = 4) -> Column:
    """Mean of the scores that are there; 0, not null, without any."""
    return F.coalesce(F.round(F.avg(score), digits), F.lit(0.0))


def pass_rate(passed: Column, digits: int = 4) -> Column:
    """Mean, null without rows."""
    return F.round(F.avg(passed), digits)


def of(condition: Column, score: Column) -> Column:
    return F.when(condition, score)


def summary(df: DataFrame, by: list[str], family: str, score: str, families: list[str], prefix: list[str] | None = None) -> DataFrame:
    """One pass: total, mean and number of scores per family, and overall."""
    names = prefix or families
    s = F.col(score)
    parts = [x for f, p in zip(families, names, strict=True) for x in (reliability(of(F.col(family) == f, s)).alias(p), F.count(of(F.col(family) == f, s)).alias(f"{p}_n"), F.count_if(F.col(family) == f).alias(f"{p}_total"))]
    return df.groupBy(*by).agg(F.count("*").alias("total"), *parts, reliability(s).alias("overall"), F.count(s).alias("overall_n"))


def granularities(df: DataFrame, sets: list[list[str]], score: str) -> DataFrame:
    """Mean and counts for each set of columns, in one pass (GROUPING SETS); columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(reliability(F.col(score)).alias("reliability"), F.count(score).alias("valid_n"), F.count("*").alias("total_n"), F.grouping_id(*columns).cast("long").alias("level"))


def tier_gap(df: DataFrame, by: str, family: str, families: list[str], tier: str, score: str) -> DataFrame:
    """A row for each ``by`` and family, also without rows: means of tiers 1 and 2 and their difference, of rounded values."""
    s, t = F.col(score), F.col(tier)
    known = df.groupBy(by, family).agg(reliability(of(t == 1, s)).alias("t1"), reliability(of(t == 2, s)).alias("t2"), F.count(of(t == 1, s)).alias("t1_n"), F.count(of(t == 2, s)).alias("t2_n"))
    frame = df.select(by).distinct().withColumn(family, F.explode(F.array(*map(F.lit, families))))
    found = frame.join(known, [by, family], "left").fillna({"t1": 0.0, "t2": 0.0, "t1_n": 0, "t2_n": 0})
    return found.withColumn("gap", F.round(F.col("t1") - F.col("t2"), 4))


def family_by_tier(df: DataFrame, by: str, family: str, families: list[str], tier: str, score: str, tiers: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Means and counts as a column for each family and tier: a fixed list, whatever the data have."""
    here = lambda f, t: of((F.col(family) == f) & (F.col(tier) == t), F.col(score))
    return df.groupBy(by).agg(*[x for f in families for t in tiers for x in (reliability(here(f, t)).alias(f"{f}_t{t}"), F.count(here(f, t)).alias(f"{f}_t{t}_n"))])


def pivoted(df: DataFrame, by: str, column: str, values: list[str], score: str) -> DataFrame:
    """Means as columns; 0 where there are no rows."""
    return df.groupBy(by).pivot(column, values).agg(reliability(F.col(score))).fillna(0.0)


def as_metrics(df: DataFrame) -> DataFrame:
    """(metric, value) rows from one row of numbers."""
    return df.unpivot([], df.columns, "metric", "value")


def frequency(df: DataFrame, value: Column | str, name: str = "value", explode: bool = False) -> DataFrame:
    """Counts by value, or by element of an array; a null array has none."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select((F.explode(value) if explode else value).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, order: str, k: int) -> DataFrame:
    """The k most frequent values; of equally frequent ones that which came first."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), F.asc("first_seen")).limit(k)


def upper_median(value: Column) -> Column:
    """The middle of the sorted values, the upper one of two. Values of a group are gathered: for groups that fit a task."""
    every = F.sort_array(F.collect_list(value))
    return F.get(every, F.floor(F.size(every) / 2).cast("int"))


def upper_median_table(df: DataFrame, by: list[str], value: str, out: str = "upper_median") -> DataFrame:
    """The same for groups of any size: counts by value, running sums over values, and the first value past half the rows."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum("_n").over(Window.partitionBy(*by))
    running = counts.withColumn("_run", F.sum("_n").over(w)).withColumn("_half", F.floor(total / 2))
    return running.where("_run > _half").groupBy(*by).agg(F.min(value).alias(out))


def bucketed(value: Column, bounds: list[int], above: str) -> Column:
    """The label of the first bound that isn't exceeded."""
    found = F.when(F.lit(False), "")
    for b in bounds:
        found = found.when(value <= b, f"<={b}")
    return found.otherwise(above)


def percent_floor(part: Column, whole: Column) -> Column:
    return F.floor(100 * part / F.greatest(whole, F.lit(1))).cast("long")


def split_means(df: DataFrame, rate: str, value: str, least: float = 0.5) -> DataFrame:
    """Means of ``value`` where the rate is above ``least`` and where not, their numbers and difference (null if one is empty)."""
    high, low = of(F.col(rate) > least, F.col(value)), of(~(F.col(rate) > least), F.col(value))
    found = df.agg(F.round(F.avg(high), 4).alias("pass_mean"), F.round(F.avg(low), 4).alias("fail_mean"), F.count(high).alias("n_pass"), F.count(low).alias("n_fail"))
    return found.withColumn("difference", F.round(F.col("pass_mean") - F.col("fail_mean"), 4))


def least_of(columns: list[str]) -> Column:
    """The name of the least column; of equal ones the first listed."""
    low = F.least(*map(F.col, columns))
    return F.coalesce(*(F.when(F.col(c) == low, c) for c in columns))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, failures, status): a row for each rule that no row may break."""
    counted = df.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    return counted.unpivot([], list(rules), "check", "failures").withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))
