"""Reliability summaries, judges, scoring, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import metrics as M
from lathe.operators import aggregate as A
from lathe.operators import scoring as S
from lathe.operators import stats
from lathe.operators.dedup import keep_first
from lathe.plans.base import FAMILIES, PAIRS, SCORED, Tables, pairs, query, scored

_MEAN = "coalesce(round(avg({0}), 4), 0.0)"


def _per_family(fmt: str) -> str:
    return ", ".join(fmt.format(f=f) for f in FAMILIES)


@query(
    f"WITH {SCORED} SELECT model, count(*) AS total, "
    + _per_family("coalesce(round(avg(CASE WHEN family = '{f}' THEN score END), 4), 0.0) AS {f}, count(CASE WHEN family = '{f}' THEN score END) AS {f}_n, count(CASE WHEN family = '{f}' THEN 1 END) AS {f}_total")
    + ", coalesce(round(avg(score), 4), 0.0) AS overall, count(score) AS overall_n FROM scored GROUP BY model"
)
def reliability_summary(t: Tables):
    return A.summary(scored(t), ["model"], "family", "score", FAMILIES)


@query(
    f"WITH {SCORED} SELECT model, family, tier, coalesce(round(avg(score), 4), 0.0) AS reliability, count(score) AS valid_n, count(*) AS total_n, CAST(grouping(model) * 4 + grouping(family) * 2 + grouping(tier) AS BIGINT) AS level "
    "FROM scored GROUP BY GROUPING SETS ((model, family), (model, family, tier), (model), (family))"
)
def reliability_grouping_sets(t: Tables):
    return A.granularities(scored(t), [["model", "family"], ["model", "family", "tier"], ["model"], ["family"]], "score")


@query(
    f"WITH {SCORED}, f(family) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')), m AS (SELECT DISTINCT model FROM scored), "
    "a AS (SELECT model, family, coalesce(round(avg(CASE WHEN tier = 1 THEN score END), 4), 0.0) AS t1, coalesce(round(avg(CASE WHEN tier = 2 THEN score END), 4), 0.0) AS t2, count(CASE WHEN tier = 1 THEN score END) AS t1_n, count(CASE WHEN tier = 2 THEN score END) AS t2_n FROM scored GROUP BY model, family) "
    "SELECT m.model, f.family, coalesce(t1, 0.0) AS t1, coalesce(t2, 0.0) AS t2, coalesce(t1_n, 0) AS t1_n, coalesce(t2_n, 0) AS t2_n, round(coalesce(t1, 0.0) - coalesce(t2, 0.0), 4) AS gap FROM m CROSS JOIN f LEFT JOIN a ON a.model = m.model AND a.family = f.family"
)
def tier_gap(t: Tables):
    return A.tier_gap(scored(t), "model", "family", [*FAMILIES, "xx"], "tier", "score")


@query(f"WITH {SCORED} SELECT model, " + ", ".join(f"coalesce(round(avg(CASE WHEN family = '{f}' AND tier = {k} THEN score END), 4), 0.0) AS {f}_t{k}, count(CASE WHEN family = '{f}' AND tier = {k} THEN score END) AS {f}_t{k}_n" for f in FAMILIES for k in (1, 2)) + " FROM scored GROUP BY model")
def family_by_tier(t: Tables):
    return A.family_by_tier(scored(t), "model", "family", FAMILIES, "tier", "score")


@query(f"WITH {SCORED} SELECT model, " + _per_family("coalesce(round(avg(CASE WHEN family = '{f}' THEN score END), 4), 0.0) AS {f}") + " FROM scored GROUP BY model")
def pivot_default_zero(t: Tables):
    return A.pivoted(scored(t), "model", "family", FAMILIES, "score")


@query(f"WITH {SCORED} SELECT model, arg_min(family, doc_id) AS first_family, coalesce(round(avg(score), 4), 0.0) AS reliability, count(score) AS valid_n FROM scored GROUP BY model")
def subtype_first_family(t: Tables):
    return scored(t).groupBy("model").agg(F.min_by("family", "doc_id").alias("first_family"), A.reliability(F.col("score")).alias("reliability"), F.count("score").alias("valid_n"))


@query(f"WITH {SCORED}, r AS (SELECT model, family, round(avg(score), 4) AS rate FROM scored GROUP BY model, family) SELECT model, round(sum(coalesce(rate, 0.0)) / nullif(count(rate), 0), 4) AS macro, count(rate) AS families FROM r GROUP BY model")
def macro_mean_of_rates(t: Tables):
    rates = scored(t).groupBy("model").agg(*(A.pass_rate(F.when(F.col("family") == f, F.col("score"))).alias(f) for f in FAMILIES))
    some = sum((F.col(f).isNotNull().cast("long") for f in FAMILIES), F.lit(0).cast("long"))
    return rates.select("model", S.macro_mean([F.col(f) for f in FAMILIES]).alias("macro"), some.alias("families"))


@query(f"WITH {SCORED}, r AS (SELECT model, family, round(avg(score), 4) AS rate FROM scored GROUP BY model, family), p AS (SELECT model, {_per_family("coalesce(max(CASE WHEN family = '{f}' THEN rate END), 0.0) AS {f}")} FROM r GROUP BY model) SELECT model, least(en, de, fr, es) AS lowest, CASE least(en, de, fr, es) WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END AS weakest FROM p")
def weakest_family(t: Tables):
    wide = A.pivoted(scored(t), "model", "family", FAMILIES, "score")
    return wide.select("model", F.least(*FAMILIES).alias("lowest"), A.least_of(FAMILIES).alias("weakest"))


@query(f"WITH {SCORED}, a AS (SELECT model, round(avg(score), 4) AS rate, avg(n_chars) AS v FROM scored GROUP BY model, family) SELECT round(avg(CASE WHEN rate > 0.85 THEN v END), 4) AS pass_mean, round(avg(CASE WHEN NOT rate > 0.85 THEN v END), 4) AS fail_mean, count(CASE WHEN rate > 0.85 THEN v END) AS n_pass, count(CASE WHEN NOT rate > 0.85 THEN v END) AS n_fail, round(round(avg(CASE WHEN rate > 0.85 THEN v END), 4) - round(avg(CASE WHEN NOT rate > 0.85 THEN v END), 4), 4) AS difference FROM a")
def pass_fail_split(t: Tables):
    return A.split_means(scored(t).groupBy("model", "family").agg(A.pass_rate(F.col("score")).alias("rate"), F.avg("n_chars").alias("v")), "rate", "v", 0.85)


# Judges: quality and its opposite from toxicity; some verdicts missing, some judges absent.
_DECISIONS = (
    "dec AS (SELECT doc_id AS probe_id, 'a' AS judge, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS equivalent FROM labels "
    "UNION ALL SELECT doc_id, 'b', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic = 0 END FROM labels WHERE doc_id % 7 <> 1), "
    "p AS (SELECT probe_id, count(*) AS n, min(judge) AS j1_name, max(CASE WHEN judge = 'a' THEN CAST(equivalent AS INTEGER) END) AS x1, CASE WHEN count(*) > 1 THEN 'b' END AS j2_name, max(CASE WHEN judge = 'b' THEN CAST(equivalent AS INTEGER) END) AS x2 FROM dec GROUP BY probe_id), "
    "pairs AS (SELECT probe_id, n, j1_name, x1 = 1 AS j1, j2_name, x2 = 1 AS j2 FROM p)"
)


def decisions(t: Tables):
    a = t.labels.select(F.col("doc_id").alias("probe_id"), F.lit("a").alias("judge"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("equivalent"), F.lit(1).alias("ordinal"))
    b = t.labels.where("doc_id % 7 <> 1").select(F.col("doc_id").alias("probe_id"), F.lit("b").alias("judge"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 0).alias("equivalent"), F.lit(2).alias("ordinal"))
    return a.union(b)


def judged(t: Tables):
    return S.judge_pairs(decisions(t), ["a", "b"])


@query(f"WITH {_DECISIONS} SELECT *, j1 IS NOT DISTINCT FROM j2 AS agreed FROM pairs WHERE n >= 2")
def judge_agreement_strict(t: Tables):
    return S.agreement_strict(judged(t))


@query(f"WITH {_DECISIONS} SELECT probe_id, n, j1_name, j1, coalesce(j2_name, '') AS j2_name, j2, CASE WHEN n = 1 THEN true ELSE j1 = j2 END AS agreed FROM pairs WHERE (n = 1 AND j1 IS NOT NULL) OR (n >= 2 AND j1 IS NOT NULL AND j2 IS NOT NULL)")
def judge_agreement_merged(t: Tables):
    return S.agreement_merged(judged(t))


@query(f"WITH {_DECISIONS}, g AS (SELECT j1 IS NOT DISTINCT FROM j2 AS agreed FROM pairs WHERE n >= 2), s AS (SELECT CAST(count(*) AS DOUBLE) AS total_judged, CAST(count(CASE WHEN agreed THEN 1 END) AS DOUBLE) AS agreed, CAST(count(CASE WHEN NOT agreed THEN 1 END) AS DOUBLE) AS disagreed, coalesce(round(CAST(count(CASE WHEN agreed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 4), 0.0) AS agreement_rate FROM g) UNPIVOT s ON total_judged, agreed, disagreed, agreement_rate INTO NAME metric VALUE value")
def agreement_stats(t: Tables):
    return A.as_metrics(S.agreement_stats(S.agreement_strict(judged(t))))


@query(f"WITH {_DECISIONS} SELECT pairs.probe_id, j1_name, j1, j2_name, j2, d.source, d.lang FROM pairs LEFT JOIN documents d ON d.doc_id = pairs.probe_id WHERE n >= 2 AND j1 IS DISTINCT FROM j2")
def disagreement_detail(t: Tables):
    split = S.agreement_strict(judged(t)).where(~F.col("agreed")).drop("agreed", "n")
    return split.join(t.documents.select(F.col("doc_id").alias("probe_id"), "source", "lang"), "probe_id", "left")


@query("SELECT source || '/' || w AS value, count(*) AS n FROM (SELECT source, unnest(CASE WHEN quality = 0 AND toxic = 1 THEN ['CONTENT', 'AGENTS'] WHEN quality = 0 THEN ['CONTENT'] WHEN toxic = 1 THEN ['MODALS'] END) AS w FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def failure_frequency(t: Tables):
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    failures = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.array(F.lit("CONTENT"), F.lit("AGENTS"))).when(F.col("quality") == 0, F.array(F.lit("CONTENT"))).when(F.col("toxic") == 1, F.array(F.lit("MODALS")))
    return A.frequency(joined, F.transform(failures, lambda w: F.concat(F.col("source"), F.lit("/"), w)), explode=True)


@query("SELECT count(CASE WHEN quality = 1 THEN 1 END) AS yes, count(CASE WHEN quality = 0 THEN 1 END) AS no, count(CASE WHEN d.doc_id IS NOT NULL AND quality IS NULL THEN 1 END) AS open FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verdict_counts(t: Tables):
    v = F.col("score") == 1
    return scored(t).agg(F.count_if(v).alias("yes"), F.count_if(~v).alias("no"), F.count_if(v.isNull()).alias("open"))


# A probe of each kind for each pair of turns.
_F1 = "len(list_intersect(list_distinct(x), list_distinct(y)))"
_TOKENS = "tok AS (SELECT id, base, probe, list_distinct(list_filter(regexp_split_to_array(lower(base), '\\s+'), lambda z: z <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(probe), '\\s+'), lambda z: z <> '')) AS y FROM pairs)"
_SETF1 = f"CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0 * {_F1} / (len(x) + len(y)) ELSE 0.0 END"


@query(f"WITH {PAIRS}, {_TOKENS} SELECT id, round(CAST({_SETF1} AS DOUBLE), 4) AS f1 FROM tok")
def word_f1_pairs(t: Tables):
    return pairs(t).select("id", F.round(M.word_f1(F.col("base"), F.col("probe")), 4).alias("f1"))


_BOILER = "['when','if','while','where','shall','should','must','may','will','can','the','system','a','an','is','are','be','to','of','and','or','in','that','it','this','for','with','by','not','no','then','ubiquitous','event','driven','unwanted','behavior','state','optional','feature']"


@query(
    f"WITH {PAIRS}, c AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(base), '[.,!?#$%&*|:;\"()@+-]', ' ', 'g'), '\\s+'), lambda z: len(z) > 2 AND NOT list_contains({_BOILER}, z))) AS x, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(probe), '[.,!?#$%&*|:;\"()@+-]', ' ', 'g'), '\\s+'), lambda z: len(z) > 2 AND NOT list_contains({_BOILER}, z))) AS y FROM pairs) "
    "SELECT id, CAST(len(x) AS BIGINT) AS n_base, CAST(len(y) AS BIGINT) AS n_probe, CAST(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 4) END AS DOUBLE) AS jaccard FROM c"
)
def jaccard_pairs(t: Tables):
    x, y = F.regexp_replace("base", r'[.,!?#$%&*|:;"()@+-]', " "), F.regexp_replace("probe", r'[.,!?#$%&*|:;"()@+-]', " ")
    found = pairs(t).select("id", M.content_tokens(x).alias("x"), M.content_tokens(y).alias("y"))
    return found.select("id", F.size("x").cast("long").alias("n_base"), F.size("y").cast("long").alias("n_probe"), M.set_jaccard(F.col("x"), F.col("y")).alias("jaccard"))


_DETAIL = "detail AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(base), '[a-z]+')), lambda z: NOT list_contains(['the','a','an','of','in','on','at','to','for','and','or','is','are'], z)) AS d, list_distinct(regexp_extract_all(lower(probe), '[a-z]+')) AS w FROM pairs)"


@query(f"WITH {PAIRS}, {_DETAIL} SELECT id, CAST(round(CASE WHEN len(d) > 0 THEN len(list_intersect(d, w)) / CAST(len(d) AS DOUBLE) ELSE 1.0 END, 3) AS DOUBLE) AS share, CASE WHEN len(d) = 0 OR len(list_intersect(d, w)) / CAST(len(d) AS DOUBLE) >= 0.7 THEN 1 ELSE 0 END AS preserved FROM detail")
def detail_overlap(t: Tables):
    share = M.detail_share(F.col("base"), F.col("probe"))
    return pairs(t).select("id", F.round(share, 3).alias("share"), (share >= 0.7).cast("int").alias("preserved"))


_READ = "CASE WHEN {0} = '' THEN 0.0 ELSE list_sum(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda z: z <> ''), lambda z: len(z))) / CAST(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda z: z <> '')) AS DOUBLE) END"


@query(f"SELECT doc_id, round({_READ.format('text')}, 4) AS readability FROM documents")
def readability_mean_token_length(t: Tables):
    return t.documents.select("doc_id", F.round(M.mean_token_length(F.col("text")), 4).alias("readability"))


@query(
    f"WITH {PAIRS}, {_TOKENS}, {_DETAIL}, fam(probe_family, probe_subtype) AS (VALUES ('invariance', 'lexical'), ('invariance', 'semantic'), ('directional', 'ose'), ('shortcut', 'detail')), "
    f"m AS (SELECT tok.id, {_SETF1} AS f1, abs({_READ.format('base')} - {_READ.format('probe')}) AS delta, CASE WHEN len(d) > 0 THEN len(list_intersect(d, w)) / CAST(len(d) AS DOUBLE) ELSE 1.0 END AS share FROM tok JOIN detail ON tok.id = detail.id), "
    "r AS (SELECT id * 4 + CASE probe_subtype WHEN 'lexical' THEN 0 WHEN 'semantic' THEN 1 WHEN 'ose' THEN 2 ELSE 3 END AS probe_id, probe_family, CASE WHEN probe_subtype = 'semantic' THEN 'judge_only' WHEN probe_family = 'invariance' THEN 'rule_then_judge' ELSE 'rule_only' END AS scoring_method, "
    "CASE WHEN probe_subtype = 'semantic' THEN NULL WHEN probe_family = 'invariance' THEN CAST(f1 >= 0.05 AND delta <= 3.0 AS INTEGER) WHEN probe_family = 'directional' THEN CAST(delta > 0.5 AND f1 < 0.95 AS INTEGER) ELSE CAST(share >= 0.7 AS INTEGER) END AS rule_score, round(CAST(f1 AS DOUBLE), 4) AS similarity FROM m CROSS JOIN fam), "
    f"{_DECISIONS.replace('pairs AS', 'jp AS')}, g AS (SELECT probe_id, coalesce(j1 IS NOT DISTINCT FROM j2, false) AND coalesce(j1, false) AS v FROM jp WHERE n >= 2) "
    "SELECT r.probe_id, probe_family, scoring_method, rule_score, similarity, v AS judge_verified, CASE WHEN probe_family = 'invariance' AND v IS NOT NULL THEN CAST(v AS INTEGER) WHEN scoring_method = 'judge_only' THEN NULL ELSE rule_score END AS final_score FROM r LEFT JOIN g ON r.probe_id = g.probe_id"
)
def rule_score_final(t: Tables):
    kinds = t.spark.createDataFrame([(0, "invariance", "lexical"), (1, "invariance", "semantic"), (2, "directional", "ose"), (3, "shortcut", "detail")], "k int, probe_family string, probe_subtype string")
    both = pairs(t)
    outputs = both.crossJoin(kinds.select("k")).select((F.col("id") * 4 + F.col("k")).alias("probe_id"), F.col("probe").alias("probe_text"))
    base = both.select(F.col("id").alias("base_item_id"), F.col("base").alias("base_text"))
    probes = base.crossJoin(kinds).select((F.col("base_item_id") * 4 + F.col("k")).alias("probe_id"), "base_item_id", "probe_family", "probe_subtype", F.col("base_text").alias("critical_detail"))
    ruled = S.rule_scored(S.with_base(outputs, probes, base), similarity_least=0.05)
    return S.adjudicated(ruled, S.agreement_strict(judged(t))).select("probe_id", "probe_family", "scoring_method", "rule_score", "similarity", "judge_verified", "final_score")


# Outputs of models: some missing, some failed, some of probes.
_OUT = "o AS (SELECT o_custkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey % 4 AS VARCHAR) END AS probe_id, 'm' || CAST(o_orderkey % 3 AS VARCHAR) AS model_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS rewrite, CASE WHEN o_orderkey % 11 = 0 THEN 'empty' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'ok' END AS run_status, o_orderkey FROM orders), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, probe_id, model_id ORDER BY o_orderkey) AS k FROM o) WHERE k = 1)"


def outputs(t: Tables):
    o = t.orders.selectExpr("o_custkey AS item_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey % 4 AS STRING) END AS probe_id", "'m' || CAST(o_orderkey % 3 AS STRING) AS model_id", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS rewrite", "CASE WHEN o_orderkey % 11 = 0 THEN 'empty' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'ok' END AS run_status", "o_orderkey")
    return keep_first(o, ["item_id", "probe_id", "model_id"], ["o_orderkey"]).drop("o_orderkey")


_QUEUE = "q AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'P1' END AS probe_id, m.model_id FROM part CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) m(model_id))"


#: Reasons, with numbers as printed: half up, on values that are decided before they are rounded.
_GRADE = "CASE WHEN len({1}) > 0 THEN 0.39e0 * len({1}) / greatest(len(regexp_extract_all({0}, '[.!?]+')), 1) + 11.8e0 * greatest(len(regexp_extract_all(lower({0}), '[aeiouy]+')), len({1})) / len({1}) - 15.59e0 ELSE 0.0 END"
_TOK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda z: z <> '')"


@query(
    f"WITH {PAIRS}, {_TOKENS}, {_DETAIL}, t AS (SELECT id, base, probe, {_TOK.format('base')} AS tb, {_TOK.format('probe')} AS tp FROM pairs), fam(probe_family, probe_subtype) AS (VALUES ('invariance', 'lexical'), ('invariance', 'semantic'), ('directional', 'ose'), ('shortcut', 'detail')), "
    f"m AS (SELECT tok.id, CAST({_SETF1} AS DOUBLE) AS f1, CAST({_GRADE.format('t.base', 'tb')} - ({_GRADE.format('t.probe', 'tp')}) AS DOUBLE) AS shift, CASE WHEN len(d) > 0 THEN len(list_intersect(d, w)) / CAST(len(d) AS DOUBLE) ELSE 1.0 END AS share, contains(lower(t.probe), lower(t.base)) AS exact FROM tok JOIN detail ON tok.id = detail.id JOIN t ON t.id = tok.id) "
    "SELECT id, probe_family, probe_subtype, CASE WHEN probe_subtype = 'semantic' THEN NULL WHEN probe_family = 'invariance' THEN CAST(f1 >= 0.05 AND abs(shift) <= 3.0 AS INTEGER) WHEN probe_family = 'directional' THEN CAST(abs(shift) > 0.5 AND f1 < 0.95 AS INTEGER) ELSE CAST(share >= 0.7 AS INTEGER) END AS rule_score, "
    "CASE WHEN probe_family = 'shortcut' THEN CAST(exact AS INTEGER) END AS detail_exact_match, "
    "CASE WHEN probe_subtype = 'semantic' THEN 'semantic_probe:word_f1_invalid_for_paraphrase:deferred_to_judge' "
    "WHEN probe_family = 'invariance' THEN 'sim=' || CASE WHEN f1 >= 0.05 THEN 'PASS' ELSE 'FAIL' END || printf('(%.3f)', round(f1, 3)) || ',read_delta=' || CASE WHEN abs(shift) <= 3.0 THEN 'PASS' ELSE 'FAIL' END || printf('(%.1f)', round(abs(shift), 1)) "
    "WHEN probe_family = 'directional' THEN 'read_shift=' || CASE WHEN abs(shift) > 0.5 THEN 'PASS' ELSE 'FAIL' END || printf('(%.1f)', CASE WHEN round(shift, 1) = 0 THEN 0.0 ELSE round(shift, 1) END) || ',diff=' || CASE WHEN f1 < 0.95 THEN 'PASS' ELSE 'FAIL' END || printf('(%.3f)', round(f1, 3)) "
    "ELSE 'detail_preserved=' || CASE WHEN share >= 0.7 THEN 'YES' ELSE 'NO' END || ',exact=' || CASE WHEN exact THEN 'YES' ELSE 'NO' END END AS rule_reason FROM m CROSS JOIN fam"
)
def rule_reasons(t: Tables):
    """Scores by Flesch-Kincaid grades, and why."""
    kinds = t.spark.createDataFrame([("invariance", "lexical"), ("invariance", "semantic"), ("directional", "ose"), ("shortcut", "detail")], "probe_family string, probe_subtype string")
    made = pairs(t).crossJoin(kinds).select("id", "probe_family", "probe_subtype", F.col("base").alias("base_text"), F.col("probe").alias("probe_text"), F.col("base").alias("critical_detail"))
    return S.rule_scored(made, similarity_least=0.05, readability=M.grade_level).select("id", "probe_family", "probe_subtype", "rule_score", "detail_exact_match", "rule_reason")


@query(f"WITH {PAIRS}, t AS (SELECT id, {_TOK.format('probe')} AS w, probe FROM pairs) SELECT id, round(CAST({_GRADE.format('probe', 'w')} AS DOUBLE), 6) AS grade FROM t")
def grade_levels(t: Tables):
    return pairs(t).select("id", F.round(M.grade_level(F.col("probe")), 6).alias("grade"))


@query(f"WITH {PAIRS}, {_TOKENS} SELECT id, {_SETF1} >= 0.85 AS same FROM tok")
def semantic_matches(t: Tables):
    """Pairs whose similarity, by the stand-in for a model, reaches the threshold."""
    from lathe.functions import lexicon as lx
    from lathe.functions.models import similarity

    return pairs(t).select("id", (similarity(F.col("base"), F.col("probe")) >= lx.SEMANTIC_F1_MIN).alias("same"))


def queue(t: Tables):
    models = t.spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model_id string")
    return S.every_model(t.part.selectExpr("p_partkey AS item_id", "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'P1' END AS probe_id"), models)


@query(f"WITH {_OUT}, {_QUEUE} SELECT q.item_id, q.probe_id, q.model_id, coalesce(u.rewrite, '') AS rewrite FROM q LEFT JOIN u ON q.item_id = u.item_id AND q.probe_id IS NOT DISTINCT FROM u.probe_id AND q.model_id = u.model_id AND coalesce(u.run_status, 'ok') = 'ok' AND trim(u.rewrite) <> ''")
def rewrites_null_safe(t: Tables):
    return S.rewrites_of(queue(t), outputs(t))


@query(f"WITH {_OUT}, {_QUEUE} SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM u WHERE q.item_id = u.item_id AND q.probe_id IS NOT DISTINCT FROM u.probe_id AND q.model_id = u.model_id AND coalesce(u.run_status, 'ok') = 'ok' AND trim(u.rewrite) <> '')")
def pending_null_safe(t: Tables):
    from lathe.streaming.incremental import resumed

    return resumed(queue(t), outputs(t))


@query(f"WITH {_OUT}, {_QUEUE}, j AS (SELECT q.model_id, q.probe_id IS NULL AS is_base, coalesce(u.rewrite, '') AS rewrite FROM q LEFT JOIN u ON q.item_id = u.item_id AND q.probe_id IS NOT DISTINCT FROM u.probe_id AND q.model_id = u.model_id AND coalesce(u.run_status, 'ok') = 'ok' AND trim(u.rewrite) <> '') SELECT model_id, count(*) AS items, round(avg(CASE WHEN rewrite <> '' THEN 1.0 ELSE 0.0 END), 4) AS answered FROM j WHERE is_base GROUP BY model_id")
def mean_over_all_items(t: Tables):
    found = S.rewrites_of(queue(t).where("probe_id is null"), outputs(t))
    return found.groupBy("model_id").agg(F.count("*").alias("items"), F.round(F.avg(F.when(F.col("rewrite") != "", 1.0).otherwise(0.0)), 4).alias("answered"))


@query(f"WITH {_OUT}, h AS (SELECT model_id, count(DISTINCT item_id) AS have FROM u WHERE coalesce(run_status, 'ok') = 'ok' AND trim(rewrite) <> '' GROUP BY model_id) SELECT m.model_id, coalesce(have, 0) AS have, greatest((SELECT count(*) FROM part) - coalesce(have, 0), 0) AS gap FROM (VALUES ('m0'), ('m1'), ('m2'), ('m9')) m(model_id) LEFT JOIN h ON m.model_id = h.model_id")
def coverage_gap(t: Tables):
    from lathe.streaming.incremental import done

    models = t.spark.createDataFrame([("m0",), ("m1",), ("m2",), ("m9",)], "model_id string")
    have = done(outputs(t)).groupBy("model_id").agg(F.count_distinct("item_id").alias("have"))
    have = models.join(have, "model_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return have.withColumn("gap", F.greatest(F.lit(t.part.count()) - F.col("have"), F.lit(0)))


@query("WITH p AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e, avg(l_discount) AS d, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey), u AS (SELECT * FROM p UNPIVOT (x FOR score IN (q, e, d))), g AS (SELECT u.l_suppkey, u.score, u.x, p.n AS y FROM u JOIN p ON u.l_suppkey = p.l_suppkey), r AS (SELECT score, rank() OVER (PARTITION BY score ORDER BY x) + (count(*) OVER (PARTITION BY score, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY score ORDER BY y) + (count(*) OVER (PARTITION BY score, y) - 1) / 2.0 AS ry FROM g) SELECT score, round(corr(rx, ry), 4) AS rho, count(*) AS n FROM r GROUP BY score")
def spearman_grid(t: Tables):
    p = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.count("*").cast("double").alias("y"))
    return stats.spearman(p.unpivot(["l_suppkey", "y"], ["q", "e", "d"], "score", "x"), "x", "y", ["score"])


@query("WITH a AS (SELECT p_brand, round(avg(p_retailprice), 4) AS v FROM part GROUP BY p_brand) SELECT p_brand, v, row_number() OVER (ORDER BY v DESC, p_brand) AS place FROM a")
def ordinal_ranks(t: Tables):
    return stats.ordinal_rank(t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("v")), "v", "p_brand", "place")


@query("SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS place FROM part")
def average_ranks(t: Tables):
    return stats.average_rank(t.part.select("p_partkey", "p_type", "p_size"), "p_size", "place", ["p_type"]).drop("p_size")


#: Two-sided p-value of a correlation of n rows, n even: the closed form of the t distribution for even degrees of freedom.
_P = "CASE WHEN rho IS NULL OR n < 3 THEN NULL WHEN abs(rho) >= 1 THEN 0.0 ELSE abs(round(1 - abs(rho) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - rho * rho, k))), 4)) END"
_SPEARMAN = "p AS (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e, avg(l_discount) AS d, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey), u AS (SELECT * FROM p UNPIVOT (x FOR score IN (q, e, d))), g AS (SELECT u.l_suppkey, u.score, u.x, p.n AS y FROM u JOIN p ON u.l_suppkey = p.l_suppkey), r AS (SELECT score, rank() OVER (PARTITION BY score ORDER BY x) + (count(*) OVER (PARTITION BY score, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY score ORDER BY y) + (count(*) OVER (PARTITION BY score, y) - 1) / 2.0 AS ry FROM g), sp AS (SELECT score, round(corr(rx, ry), 4) AS rho, count(*) AS n FROM r GROUP BY score)"
_WITH_P = f"{_SPEARMAN}, pv AS (SELECT *, CAST({_P} AS DOUBLE) AS p_value FROM sp)"


@query(f"WITH {_WITH_P} SELECT *, CASE WHEN p_value IS NULL OR p_value = 0 THEN '' WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS stars FROM pv")
def correlation_p_values(t: Tables):
    found = stats.with_p(spearman_grid(t))
    return found.withColumn("stars", M.stars(F.col("p_value")))


@query(f"WITH {_WITH_P} SELECT * FROM pv WHERE p_value < 1.01 ORDER BY rho DESC, score, rho, n, p_value LIMIT 1")
def best_correlation(t: Tables):
    return stats.best_significant(stats.with_p(spearman_grid(t)), level=1.01)


@query("WITH a AS (SELECT n_nationkey, n_regionkey, n_name FROM nation), x AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS rx, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS ry FROM a) SELECT round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1)), 4) AS rho, count(*) AS n FROM x")
def ordinal_spearman(t: Tables):
    """The formula for places without ties."""
    placed = stats.ordinal_rank(stats.ordinal_rank(t.nation, "n_name", "n_nationkey", "rx", descending=False), "n_regionkey", "n_nationkey", "ry", descending=False)
    return placed.agg(stats.ordinal_spearman(F.col("rx"), F.col("ry")).alias("rho"), F.count("*").alias("n"))


@query("WITH a AS (SELECT o_orderpriority AS model, o_orderstatus AS family, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY ALL) SELECT model, " + ", ".join(f"coalesce(max(CASE WHEN family = '{f}' THEN score END), 0.0) AS {f}" for f in "FOP") + " FROM a GROUP BY model")
def figure_bars(t: Tables):
    """The input of grouped bars: a row for each model, a column for each family."""
    scores = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("family")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))
    return A.pivoted(scores, "model", "family", list("FOP"), "score")


@query("SELECT n_name AS label, round(avg(s_acctbal), 4) AS x, round(avg(c_acctbal), 4) AS y FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name HAVING avg(s_acctbal) IS NOT NULL AND avg(c_acctbal) IS NOT NULL")
def figure_scatter(t: Tables):
    """The input of a scatter plot: labelled points, none with a missing coordinate."""
    x = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("x"))
    y = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("y"))
    return t.nation.join(x, "n_nationkey").join(y, "n_nationkey").select(F.col("n_name").alias("label"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("WITH a AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS r, avg(p_size) AS s FROM part GROUP BY p_brand) SELECT p_brand, round(r, 4) AS r, round(coalesce(s, 0), 4) AS s, n FROM a WHERE r IS NOT NULL AND s IS NOT NULL")
def figure_input(t: Tables):
    a = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("r"), F.avg("p_size").alias("s"))
    return a.where("r is not null and s is not null").select("p_brand", F.round("r", 4).alias("r"), F.round(F.coalesce("s", F.lit(0)), 4).alias("s"), "n")


@query("WITH b AS (SELECT p_brand, round(round((round(avg(p_size), 4) + round(avg(p_retailprice), 4)) / 2, 4), 4) AS gold FROM part GROUP BY p_brand) SELECT p_brand, gold FROM b")
def nested_rounding(t: Tables):
    return t.part.groupBy("p_brand").agg(F.round((F.round(F.avg("p_size"), 4) + F.round(F.avg("p_retailprice"), 4)) / 2, 4).alias("gold"))


@query("SELECT p_brand, CASE WHEN count(CASE WHEN p_size > 10 THEN 1 END) = 0 THEN NULL ELSE (avg(p_size) + avg(CASE WHEN p_size > 10 THEN p_retailprice END)) / 2 END AS ordinary FROM part GROUP BY p_brand")
def ordinary_score(t: Tables):
    return t.part.groupBy("p_brand").agg(((F.avg("p_size") + F.avg(F.when(F.col("p_size") > 10, F.col("p_retailprice")))) / 2).alias("ordinary"))


@query("WITH s AS (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS b FROM supplier GROUP BY 1) SELECT s.k, a, coalesce(b, 0) AS b FROM s JOIN t ON s.k = t.k")
def cross_domain_join(t: Tables):
    s = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"))
    u = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("b"))
    return s.join(u, "k").withColumn("b", F.coalesce("b", F.lit(0.0)))
