"""Joins of outputs with probes, rule scores, judges' agreement, final scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx
from lathe.functions import metrics as M
from lathe.operators.dedup import keep_last


def with_base(probe_outputs: DataFrame, probes: DataFrame, base_outputs: DataFrame) -> DataFrame:
    """Outputs with their probe's metadata (without: dropped) and base output; families that need a base lose rows without."""
    joined = probe_outputs.join(probes, "probe_id").join(base_outputs, "base_item_id", "left")
    needs = F.col("probe_family").isin("invariance", "directional")
    return joined.where(~(needs & F.col("base_text").isNull())).withColumn("base_text", F.coalesce("base_text", F.lit("")))


def rule_scored(df: DataFrame, similarity_least: float = lx.SIMILARITY_THRESHOLD, delta_most: float = lx.READABILITY_DELTA_MAX, readability: Callable[[Column], Column] = M.mean_token_length) -> DataFrame:
    """``similarity``, ``read_delta``, ``overlap``, ``detail_share``, ``detail_exact_match``, ``rule_score``, ``scoring_method`` and ``rule_reason``
    from base_text, probe_text, probe_family, probe_subtype and critical_detail. Thresholds hold for unrounded values; semantic probes
    wait for the judge. ``readability``: a grade of a text (``metrics.grade_level`` for Flesch-Kincaid)."""
    df = df.withColumn("_f1", M.word_f1(F.col("base_text"), F.col("probe_text")))
    df = df.withColumn("_shift", readability(F.col("base_text")) - readability(F.col("probe_text"))).withColumn("_delta", F.abs("_shift"))
    df = df.withColumn("_detail", M.detail_share(F.col("critical_detail"), F.col("probe_text")))
    df = df.withColumn("_exact", M.detail_exact(F.col("critical_detail"), F.col("probe_text")))
    family = F.col("probe_family")
    semantic = (family == "invariance") & (F.coalesce(F.col("probe_subtype"), F.lit("")) == "semantic")
    one = lambda c: c.cast("int")
    score = (
        F.when(semantic, F.lit(None).cast("int"))
        .when(family == "invariance", one((F.col("_f1") >= similarity_least) & (F.col("_delta") <= delta_most)))
        .when(family == "directional", one((F.col("_delta") > lx.DIRECTIONAL_DELTA_MIN) & (F.col("_f1") < lx.DIRECTIONAL_OVERLAP_MAX)))
        .when(family == "shortcut", one(F.col("_detail") >= lx.DETAIL_SHARE_MIN))
    )
    method = F.when(semantic, "judge_only").when(family == "invariance", "rule_then_judge").otherwise("rule_only")
    df = df.withColumns({
        "similarity": F.round("_f1", 4), "read_delta": F.round("_delta", 2), "overlap": F.when(family == "directional", F.round("_f1", 4)),
        "detail_share": F.when(family == "shortcut", F.round("_detail", 3)), "detail_exact_match": F.when(family == "shortcut", one(F.col("_exact"))),
        "rule_score": score, "scoring_method": method,
    })
    return df.withColumn("rule_reason", _rule_reason(similarity_least, delta_most)).drop("_f1", "_shift", "_delta", "_detail", "_exact")


def _printed(c: Column, digits: int) -> Column:
    """Half up by the scaled value, as the SQL does it: of 14.549999999999999, one bit below a half, the tenfold is 145.5 and goes up."""
    return F.round(c * 10.0**digits) / 10.0**digits


def _rule_reason(similarity_least: float, delta_most: float) -> Column:
    """Why a rule gave its score, for people: decided by the values as they are, which are rounded in print alone."""
    mark = lambda c: F.when(c, "PASS").otherwise("FAIL")
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    return (
        F.when(F.col("scoring_method") == "judge_only", "semantic_probe:word_f1_invalid_for_paraphrase:deferred_to_judge")
        .when(F.col("probe_family") == "invariance", F.format_string("sim=%s(%.3f),read_delta=%s(%.1f)", mark(F.col("_f1") >= similarity_least), _printed(F.col("_f1"), 3), mark(F.col("_delta") <= delta_most), _printed(F.col("_delta"), 1)))
        .when(F.col("probe_family") == "directional", F.format_string("read_shift=%s(%.1f),diff=%s(%.3f)", mark(F.col("_delta") > lx.DIRECTIONAL_DELTA_MIN), F.when(_printed(F.col("_shift"), 1) == 0, 0.0).otherwise(_printed(F.col("_shift"), 1)), mark(F.col("_f1") < lx.DIRECTIONAL_OVERLAP_MAX), _printed(F.col("_f1"), 3)))
        .otherwise(F.format_string("detail_preserved=%s,exact=%s", yes(F.col("rule_score") == 1), yes(F.col("_exact"))))
    )


def judge_pairs(decisions: DataFrame, order: list[str]) -> DataFrame:
    """(probe_id, n, j1_name, j1, j2_name, j2): the last decision of each judge, the first two judges in ``order``."""
    last = keep_last(decisions, ["probe_id", "judge"], ["ordinal"])
    place = F.coalesce(*(F.when(F.col("judge") == j, i) for i, j in enumerate(order)), F.lit(len(order)))
    w = Window.partitionBy("probe_id").orderBy("_judge", "judge")
    ranked = last.withColumn("_judge", place).withColumn("_rank", F.row_number().over(w))
    at = lambda k, c: F.max(F.when(F.col("_rank") == k, F.col(c)))
    return ranked.groupBy("probe_id").agg(F.count("*").alias("n"), at(1, "judge").alias("j1_name"), at(1, "equivalent").alias("j1"), at(2, "judge").alias("j2_name"), at(2, "equivalent").alias("j2"))


def agreement_strict(pairs: DataFrame) -> DataFrame:
    """Probes with two judges at least; two nulls agree."""
    return pairs.where("n >= 2").withColumn("agreed", F.col("j1").eqNullSafe(F.col("j2")))


def agreement_merged(pairs: DataFrame) -> DataFrame:
    """A single verdict agrees with itself; pairs with a null go."""
    single = (F.col("n") == 1) & F.col("j1").isNotNull()
    both = F.col("j1").isNotNull() & F.col("j2").isNotNull()
    return pairs.where(single | ((F.col("n") >= 2) & both)).withColumn("agreed", F.when(F.col("n") == 1, True).otherwise(F.col("j1") == F.col("j2"))).withColumn("j2_name", F.coalesce("j2_name", F.lit("")))


def verdict(agreed: Column, j1: Column, j2: Column, policy: str = "agree_only") -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(agreed) & yes(j1) if policy == "agree_only" else yes(j1) | yes(j2)


def final_score(family: Column, method: Column, judged: Column, rule_score: Column) -> Column:
    """The judges' verdict on invariance, null while one is waited for, else the rule's."""
    return F.when((family == "invariance") & judged.isNotNull(), judged.cast("int")).when((family == "invariance") & (method == "judge_only"), F.lit(None).cast("int")).otherwise(rule_score)


def adjudicated(scored: DataFrame, agreement: DataFrame, policy: str = "agree_only") -> DataFrame:
    judged = agreement.select("probe_id", verdict(F.col("agreed"), F.col("j1"), F.col("j2"), policy).alias("judge_verified"))
    return scored.join(judged, "probe_id", "left").withColumn("final_score", final_score(F.col("probe_family"), F.col("scoring_method"), F.col("judge_verified"), F.col("rule_score")))


def agreement_stats(agreement: DataFrame) -> DataFrame:
    """One row: total, agreed, disagreed and the rate (0 without any)."""
    yes = F.count_if(F.col("agreed"))
    return agreement.agg(F.count("*").cast("double").alias("total_judged"), yes.cast("double").alias("agreed"), F.count_if(~F.col("agreed")).cast("double").alias("disagreed"), F.coalesce(F.round(F.try_divide(yes, F.count("*")), 4), F.lit(0.0)).alias("agreement_rate"))


def every_model(items: DataFrame, models: DataFrame) -> DataFrame:
    """Items times models: a list of models of at most some thousands, broadcast by Spark's own estimate."""
    return items.crossJoin(models)


def rewrites_of(jobs: DataFrame, outputs: DataFrame, text: str = "rewrite") -> DataFrame:
    """``jobs`` (item_id, probe_id or null, model_id) with their rewrite; what is missing, failed or blank is empty."""
    good = outputs.where((F.coalesce("run_status", F.lit("ok")) == "ok") & (F.trim(F.coalesce("rewrite", F.lit(""))) != ""))
    good = good.select(F.col("item_id").alias("_i"), F.col("probe_id").alias("_p"), F.col("model_id").alias("_m"), F.col("rewrite").alias(text))
    on = (jobs["item_id"] == good["_i"]) & jobs["probe_id"].eqNullSafe(good["_p"]) & (jobs["model_id"] == good["_m"])
    return jobs.join(good, on, "left").drop("_i", "_p", "_m").withColumn(text, F.coalesce(text, F.lit("")))


def pending(queue: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the queue whose key isn't done; null keys are equal."""
    marks = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & queue[k].eqNullSafe(marks[f"_{k}"])
    return queue.join(marks, on, "left_anti")


def directional_passed(operation: Column, base: Column, probe: Column, base_strength: Column, probe_strength: Column) -> Column:
    """Whether a rewrite moved as expected: by the operation's name, else by the texts' strengths; no move expected passes."""
    expected = F.when(operation.contains("weaken"), "weaken").when(operation.contains("strengthen"), "strengthen").when(M.modal_strength(probe) < M.modal_strength(base), "weaken").when(M.modal_strength(probe) > M.modal_strength(base), "strengthen").otherwise("neutral")
    return F.when(expected == "weaken", probe_strength <= base_strength).when(expected == "strengthen", probe_strength >= base_strength).otherwise(True)


def gold_scored(rewrites: DataFrame, rewrite: str = "rewrite", gold: str = "gold") -> DataFrame:
    """``rewrites`` with jaccard, modal, ears_kw, combined and structural; rows with a blank gold text or rewrite go."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return rewrites.where(some(gold) & some(rewrite)).withColumn("_gold", M.gold_components(F.col(rewrite), F.col(gold))).select("*", "_gold.*").drop("_gold")


def gold_alignment(scored: DataFrame, by: str) -> DataFrame:
    """Means of each component, rounded, and scores of the rounded means."""
    mean = lambda c: F.round(F.avg(c), 4)
    found = scored.groupBy(by).agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in ("jaccard", "modal", "ears_kw")))
    j, m, k = F.col("jaccard"), F.col("modal"), F.col("ears_kw")
    return found.withColumn("combined", F.round((j + m + k) / 3, 4)).withColumn("structural", F.round((m + k) / 2, 4))


def macro_mean(rates: list[Column], digits: int = 4) -> Column:
    """Mean of the rates that are there; null without any."""
    total, n = F.lit(0.0), F.lit(0)
    for r in rates:
        total, n = total + F.coalesce(r, F.lit(0.0)), n + r.isNotNull().cast("int")
    return F.round(F.try_divide(total, n), digits)
