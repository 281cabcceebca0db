"""Functions on small tables: each branch, nulls, empty texts, ties."""

import pytest
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx
from lathe.functions import metrics as M
from lathe.functions import probes as P
from lathe.functions import rules as R
from lathe.functions import text as X
from lathe.functions.models import Retry, TooManyRequests, call_models, judged, similarity, stub, verified
from lathe.operators.stats import spearman_p


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_tokens_and_strip(spark):
    assert values(spark, [" a b\tc\n", "", None, "."], X.tokens(F.col("x"))) == [["a", "b", "c"], [], [], ["."]]
    assert values(spark, [" \t a b \n"], X.strip(F.col("x"))) == ["a b"]


def test_replace_first_only(spark):
    assert values(spark, ["You SHALL and shall\nshall", "no"], X.replace_first(F.col("x"), r"\bshall\b", "must")) == ["You must and shall\nshall", "no"]


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [
        ("“Quoted” text shall stay", '"Quoted" text shall stay'),
        ("The system shall log. ~ meta ~", "The system shall log."),
        ("The system shall log. Then, it stops.", "The system shall log."),
        ("• the system shall log", "The system shall log"),
        ("Therefore, the system shall log", "The system shall log"),
        ("2.5.1 Incoming calls shall ring", "Coming calls shall ring"),
        ("Real-time data shall flow", "Data shall flow"),
        ("The system (see 4.2) shall log", "The system shall log"),
        ("The system shall log (4.3.4).", "The system shall log ."),
        ("The system (M) shall log", "The system shall log"),
        ("The unit shall keep a log of all calls made.12 Another", "The unit shall keep a log of all calls made.12 Another"),
        ("A first rule is here. The unit shall keep a log of calls.12 Another", "A first rule is here."),
    ],
)
def test_repairs(spark, raw, fixed):
    df = X.with_repairs(spark.createDataFrame([(raw,)], "x string"), "x", "y", least_words=5)
    assert df.first()["y"] == fixed


def test_repaired_id_prefix_keeps_words(spark):
    df = X.with_repairs(spark.createDataFrame([("2.5.1 Incoming calls shall ring",), ("Real-time data",)], "x string"), "x", "y", compat=False)
    assert [r["y"] for r in df.collect()] == ["Incoming calls shall ring", "Real-time data"]


def test_sentences_and_article(spark):
    assert values(spark, ["One two. Three four! five. Six"], X.sentences(F.col("x"))) == [["One two.", "Three four! five.", "Six"]]
    assert values(spark, ["12 A title\nBody\n\ntext"], X.clean_article(F.col("x"))) == ["Body text"]


def test_parsed_verdict(spark):
    rows = ['```json\n{"equivalent": true, "confidence": "high", "failures": ["A"], "reason": "r"}\n```', "{}", '{"equiv', "[1]", None]
    got = values(spark, rows, X.parsed_verdict(F.col("x")))
    assert [(g["equivalent"], g["confidence"], g["failures"], g["status"]) for g in got[:4]] == [(True, "high", ["A"], "ok"), (False, "low", [], "ok"), (None, "parse_error", ["JSON_PARSE"], "parse_error"), (None, "error", ["API_ERROR"], "error")]


def test_word_f1_and_jaccard(spark):
    rows = [("a b c", "A b d"), ("", "a"), ("a", None), ("x", "x")]
    assert values(spark, rows, F.round(M.word_f1(F.col("x"), F.col("y")), 4), "x string, y string") == [0.6667, 0.0, 0.0, 1.0]
    j = M.set_jaccard(M.content_tokens(F.col("x")), M.content_tokens(F.col("y")))
    assert values(spark, [("alpha beta", "beta gamma"), ("", ""), ("alpha", ""), ("the system", "shall be")], j, "x string, y string") == [0.3333, 1.0, 0.0, 1.0]


def test_conformance_levels(spark):
    rows = ["The system shall log.", "When on, the unit may stop.", "log it", "abc", None, "Devices shall beep"]
    assert values(spark, rows, M.conformance(F.col("x"))) == [1.0, 1.0, 0.0, 0.0, 0.0, 0.4]


def test_modals_and_types(spark):
    rows = ["He may or should", "MUST and shall", "nothing", "cannot"]
    assert values(spark, rows, M.modal_strength(F.col("x"))) == [2, 3, 0, 0]
    assert values(spark, rows, M.strongest_modal(F.col("x"))) == ["should", "shall", "none", "none"]
    assert values(spark, ["when x shall", "If a", "mustard", "other"], M.ears_type(F.col("x"))) == ["EventDriven", "UnwantedBehavior", "Ubiquitous", "unknown"]
    assert values(spark, ["go if when", "the x", "x"], M.ears_keyword(F.col("x"))) == ["WHEN", "UBIQUITOUS", "NONE"]


def test_details_and_distractors(spark):
    assert values(spark, [("the red fox", "a red dog"), (None, "x"), ("of the", "x")], F.round(M.detail_share(F.col("x"), F.col("y")), 2), "x string, y string") == [0.5, 1.0, 1.0]
    assert values(spark, [("and log the event", "it logs events"), ("of the", "x"), ("log", "none")], M.distractor_passed(F.col("x"), F.col("y")), "x string, y string") == [False, True, True]


def test_reject_precedence(spark):
    words = X.word_count(F.col("x"))
    rows = ["too short", "For example the system shall keep it for ten years", "The system keeps a log of all the calls", "Actors and post conditions of the unit shall be stated", "The system shall keep a log of all calls made", "The system shall keep a log [REF 1] of all calls"]
    assert values(spark, rows, R.reason(F.col("x"), words, external=True)) == ["word_count", "context_opener", "no_modal_verb", "metadata_template_dump", None, "external_reference"]
    assert values(spark, ["key: value", "3.1 Overview", "plain text"], R.noisy(F.col("x"))) == [True, True, False]


def test_each_reject_rule_is_a_java_pattern(spark):
    for name, pattern in lx.REJECT_RULES:
        assert values(spark, [""], R.rule(F.col("x"), name, pattern)) == [False]


def test_probe_operations(spark):
    m = F.lit("shall")
    assert values(spark, ["The unit shall log", "The unit shall be off", "Units shall log"], P.modal_synonym(F.col("x"), m)) == ["The unit is required to log", "The unit must be off", "Units must log"]
    assert values(spark, ["When on, stop", "Stop"], P.condition_synonym(F.col("x"))) == ["Once on, stop", None]
    assert values(spark, ["The user and the system", "the user"], P.clause_expand(F.col("x"))) == ["The end user and the system", None]
    assert values(spark, ["The unit shall keep a log.", "If so it shall keep a log.", "It shall."], P.subject_rephrase(F.col("x"), m)) == ["It is required that The unit keep a log.", None, None]
    got = values(spark, [("it may stop", "may"), ("it can stop", "can"), ("it stops", "shall")], P.directional_modal(F.col("x"), F.col("y")), "x string, y string")
    assert [g and (g["direction"], g["text"]) for g in got] == [("strengthen", "it should stop"), ("weaken", "it may stop"), None]
    scope = values(spark, ["if it fails it shall stop all", "call it"], P.directional_scope(F.col("x")))
    assert scope[0]["text"] == "if it fails twice it shall stop all" and scope[1] is None


def test_shortcuts(spark):
    rows = ["If the link fails, it shall stop.", "Login shall be safe.", "Send it.", "Users stop"]
    got = values(spark, rows, P.shortcut(F.col("x")))
    assert [g["category"] for g in got] == ["retry_trigger", "escalation_trigger", "response_trigger", "scope_trigger"]
    assert [g["text"] for g in got] == ["If the link fails temporarily, it shall stop.", "Login shall unexpectedly be safe.", "Send it, and log the event.", "Users stop under all circumstances."]


def test_neighbourhood_injection_and_fill(spark):
    df = spark.createDataFrame([(1, "When it fails, the system shall keep a log.")], "id long, x string")
    probes = P.neighbourhood(F.col("x"), F.lit("shall"), F.col("id"))
    got = df.select(probes.alias("p")).first()["p"]
    assert [p["probe_family"] for p in got] == ["invariance", "invariance", "directional", "shortcut"]
    extra = F.struct(*(F.lit("own" if n == "probe_id" else None).cast("string").alias(n) for n in got[0].asDict()))
    injected = df.select(P.fill_method(P.inject(probes, extra, F.lit(True)), {"invariance": "rule"}).alias("p")).first()["p"]
    assert injected[0]["probe_id"] == "own" and len(injected) == 5


def test_operations_are_a_parameter(spark):
    own = {"shout": lambda x, modal, key: F.upper(x), "same": lambda x, modal, key: x, "clause_expand": P.OPERATIONS["clause_expand"]}
    got = values(spark, ["The user shall stop"], P.candidates(F.col("x"), F.lit("shall"), operations=own))
    assert [(c["operation"], c["text"]) for c in got[0]] == [("clause_expand", "The end user shall stop")]
    got = values(spark, ["The user shall stop"], P.candidates(F.col("x"), F.lit("shall"), operations={"loud": lambda x, modal, key: F.concat(x, F.lit("!"))}))
    assert [(c["operation"], c["text"]) for c in got[0]] == [("loud", "The user shall stop!")]


def test_lexical_substitution(spark):
    made = P.lexical_substitution(F.col("x"), {"show": ["display"], "all": ["each"]}, ["all"], F.lit(1))
    assert values(spark, ["show all now"], made) == ["display all now"]
    assert values(spark, ["Go on."], P.appended_template(F.col("x"), [", if well"], F.lit(1))) == ["Go on, if well."]


def test_rewrites_and_tier(spark):
    assert values(spark, ["When on, the unit should stop.", "it must log"], M.rule_rewrite(F.col("x"))) == ["WHEN on, When on, the unit SHOULD stop.", "It SHALL log."]
    assert values(spark, ["It runs", "A unit, this was", "A unit"], M.tier(F.col("x"))) == [2, 2, 1]
    assert values(spark, [("shall", "is required to go"), ("may", "it must"), ("may", "none")], M.strength_preserved(F.col("x"), F.col("y")), "x string, y string") == [True, False, False]


def test_models(spark):
    df = spark.createDataFrame([("m", "a b c"), ("m", None)], "model_id string, prompt string")
    assert [r["output"] for r in call_models(df).collect()] == [stub("m", "a b c"), ""]
    assert [r["output"] for r in call_models(df, client=lambda: lambda m, p: 1 / 0, threads=2).collect()] == ["ERROR: division by zero"] * 2
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TooManyRequests
        return "ok"

    assert Retry(5, 0).call(flaky) == "ok"
    assert values(spark, ["ERROR: x", "PASS"], judged(F.col("x"))) == [False, True]
    assert values(spark, ["ERROR: x", "no"], verified(F.col("x"))) == [True, False]
    assert values(spark, [("a", "a"), ("", "a")], similarity(F.col("x"), F.col("y"), lambda a, b: [0.9] * len(a)), "x string, y string") == [0.9, 0.0]


def test_spearman_p():
    assert spearman_p(0.0476, 8) == pytest.approx(0.9108, abs=2e-4)
    assert spearman_p(0.9286, 8) == pytest.approx(0.0009, abs=2e-4)
    assert spearman_p(None, 8) is None and spearman_p(1.0, 8) == 0.0


def test_probes_in_steps_are_those_of_the_expression(spark):
    texts = [
        "When it fails, the user shall call  all desks.", " If access is denied\u00a0the system must be off ", "Units can FAILS every\ttime", "The system may\nstop",
        "While on, The user should keep a long log of every error, then stop.", "The unit shall keep a log of all that it did.\n", "", "ſhall K é \\d $1 shall.", None,
    ]
    rows = [(i, t, m) for i, t in enumerate(texts) for m in ("shall", "must", "may", "none", None)]
    df = spark.createDataFrame(rows, "id int, x string, m string")
    want = df.select("id", "x", "m", P.neighbourhood(F.col("x"), F.col("m"), F.col("id")).alias("probes")).collect()
    assert sorted(map(repr, P.with_neighbourhood(df, "x", "m", "id").select("id", "x", "m", "probes").collect())) == sorted(map(repr, want))
    assert {p["probe_id"] for r in want for p in r["probes"]} == {"INV_1", "INV_2", "DIR_1", "SHC_1"}


def test_tokens_and_plain_texts(spark):
    texts = ["a b", "a  b", " a", "a ", "", "a", "a\u00a0b c", "a\nb"]
    assert values(spark, texts, X.has_tokens(F.col("x"), 2)) == [True, True, False, False, False, False, True, True]
    assert values(spark, texts, X.is_plain(F.col("x"))) == [True, False, False, False, False, True, False, False]
