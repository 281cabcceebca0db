"""Operators on small tables: keys, nulls, ties, empty inputs; sources and sinks; streams."""

import json

import pytest
from pyspark.sql import functions as F

from lathe.operators import aggregate as A
from lathe.operators import dedup as D
from lathe.operators import scoring as S
from lathe.operators import stats
from lathe.sources import readers, writers
from lathe.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keep_first_does_not_depend_on_partitions(spark):
    data = [(i % 7, i, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(data, "k int, i int, o int")
    want = rows(D.keep_first(df, "k", ["o", "i"]))
    for n in (1, 3, 8):
        assert rows(D.keep_first(df.repartition(n), "k", ["o", "i"])) == want
    assert rows(D.keep_last(df, "k", ["i"]))[0][1] == max(i for k, i, _ in data if k == 0)


def test_blank_keys(spark):
    df = spark.createDataFrame([("", 1), (None, 2), ("a", 3), ("a", 4)], "k string, o int")
    assert rows(D.keep_first(df, "k", ["o"], drop_blank="k")) == [("a", 3)]
    assert len(rows(D.keep_first(df, "k", ["o"]))) == 3


@pytest.mark.parametrize(("n", "want"), [(10, [3, 3, 4]), (2, [1, 1]), (0, [])])
def test_thirds(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "k")
    assert [r[1] for r in sorted(D.split_in_three(df, ["k"]).groupBy("shard").count().collect())] == want


def test_reliability_skips_nulls(spark):
    df = spark.createDataFrame([("m", "a", 1), ("m", "a", None), ("m", "b", None), ("n", "a", 0)], "m string, f string, s int")
    got = {r["m"]: r for r in A.summary(df, ["m"], "f", "s", ["a", "b"]).collect()}
    assert (got["m"]["a"], got["m"]["a_n"], got["m"]["a_total"], got["m"]["b"], got["m"]["b_n"]) == (1.0, 1, 2, 0.0, 0)


def test_upper_median(spark):
    df = spark.createDataFrame([("e", 1), ("e", 2), ("e", 3), ("e", 4), ("o", 5), ("o", 1), ("o", 9)], "g string, v int")
    assert dict(rows(A.upper_median_table(df, ["g"], "v"))) == {"e": 3, "o": 5}
    assert dict(rows(df.groupBy("g").agg(A.upper_median(F.col("v"))))) == {"e": 3, "o": 5}


def test_least_of_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 2.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(A.least_of(["a", "b", "c"])).collect()] == ["a", "b"]


JUDGED = [("tt", "a", True), ("tt", "b", True), ("tf", "a", True), ("tf", "b", False), ("ff", "a", False), ("ff", "b", False), ("tn", "a", True), ("tn", "b", None), ("nn", "a", None), ("nn", "b", None), ("t", "a", True), ("n", "a", None), ("dup", "a", False), ("dup", "a", True), ("dup", "b", True)]


def test_agreement_variants(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(JUDGED)], "probe_id string, judge string, equivalent boolean, ordinal int")
    pairs = S.judge_pairs(df, ["a", "b"])
    strict = {r["probe_id"]: r["agreed"] for r in S.agreement_strict(pairs).collect()}
    assert strict == {"tt": True, "tf": False, "ff": True, "tn": False, "nn": True, "dup": True}
    merged = {r["probe_id"]: r["agreed"] for r in S.agreement_merged(pairs).collect()}
    assert merged == {"tt": True, "tf": False, "ff": True, "t": True, "dup": True}
    stats_row = S.agreement_stats(S.agreement_strict(pairs)).first()
    assert (stats_row["total_judged"], stats_row["agreed"], stats_row["agreement_rate"]) == (6, 4, 0.6667)
    assert S.agreement_stats(S.agreement_strict(pairs.limit(0))).first()["agreement_rate"] == 0.0


@pytest.mark.parametrize("agreed", [True, False, None])
@pytest.mark.parametrize("j1", [True, False, None])
@pytest.mark.parametrize("j2", [True, False, None])
def test_verdict_policy(spark, agreed, j1, j2):
    df = spark.createDataFrame([(agreed, j1, j2)], "g boolean, a boolean, b boolean")
    got = df.select(S.verdict(F.col("g"), F.col("a"), F.col("b")), S.verdict(F.col("g"), F.col("a"), F.col("b"), "either")).first()
    assert tuple(got) == (bool(agreed) and bool(j1), bool(j1) or bool(j2))


def test_final_score(spark):
    data = [("invariance", "judge_only", None, None), ("invariance", "judge_only", True, None), ("invariance", "rule_then_judge", None, 1), ("invariance", "rule_then_judge", False, 1), ("directional", "rule_only", False, 1)]
    df = spark.createDataFrame(data, "f string, m string, j boolean, r int")
    assert [r[0] for r in df.select(S.final_score(*map(F.col, "fmjr"))).collect()] == [None, 1, 1, 0, 1]


def test_missing_base_and_probe(spark):
    out = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (9, "w")], "probe_id int, probe_text string")
    probes = spark.createDataFrame([(1, 10, "invariance"), (2, 11, "shortcut"), (3, 10, "directional")], "probe_id int, base_item_id int, probe_family string")
    base = spark.createDataFrame([(12, "b")], "base_item_id int, base_text string")
    assert [(r["probe_id"], r["base_text"]) for r in S.with_base(out, probes, base).collect()] == [(2, "")]


def test_pending_with_null_keys(spark):
    queue = spark.createDataFrame([(1, None, "m"), (1, "p", "m"), (2, None, "m")], "item_id int, probe_id string, model_id string")
    outs = spark.createDataFrame([(1, None, "m", "ok", "text"), (1, "p", "m", "ok", " "), (2, None, "m", "failed", "text")], "item_id int, probe_id string, model_id string, run_status string, rewrite string")
    assert [tuple(r) for r in sorted(incremental.resumed(queue, outs).collect(), key=repr)] == [(1, "p", "m"), (2, None, "m")]
    assert incremental.resumed(queue, outs, retry_failed=False).count() == 0


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (3.0, 7.0)], "x double, y double")
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(0.9487)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert stats.spearman(flat, "x", "y").first()["rho"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.json_array(spark, str(tmp_path / "b.json"), "x int").count() == 2
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "one.json").write_text(json.dumps({"pages": [{"content": [{"text": "12"}, {"text": "The unit shall\nrun"}, {"text": "a b"}]}]}))
    (docs / "bad.json").write_text("{oops")
    good, errors = readers.documents(spark, str(docs / "*.json"))
    assert [(r["document_id"], r["block"], r["text"]) for r in readers.blocks(good).collect()] == [("one", 1, "The unit shall run")]
    assert [r["document_id"] for r in errors.collect()] == ["bad"]
    (tmp_path / "p.arff").write_text("% c\n@RELATION r\n1,'early',F\n@DATA\n1,'The a, b shall',F\n2, 'it''s' , pe\nnothing\n")
    ok, bad = readers.arff(spark, str(tmp_path / "p.arff"))
    assert [(r["project_id"], r["requirement_text"], r["class"], r["class_family"]) for r in ok.orderBy("line").collect()] == [("1", "The a, b shall", "F", "FR"), ("2", "it''s", "PE", "NFR")]
    assert bad.count() == 1


def test_workbook(spark):
    cells = [(None, None)] * 15 + [(1, "The unit shall run", "U"), (2, "=A1+B1 x y", None), (None, None), (3, "short", None)]
    got = readers.workbook(spark, {"ALPHA boilerplates (DODT)": cells, "Summary": cells})
    assert [(r["project"], r["template"], r["req_id"]) for r in got.collect()] == [("ALPHA", "boilerplates (DODT)", "1")]


def test_ids(spark):
    df = spark.createDataFrame([("d", "In 2005: 0100 The unit shall run at once. Priority 2 0110 The unit shall stop when told to do so 4999 x")], "document_id string, text string")
    assert df.select(readers.requirement_ids(F.col("text"))).first()[0] == [100, 110, 4999]
    got = readers.id_segments(df).orderBy("ordinal").collect()
    assert [(r["requirement_id"], r["priority"]) for r in got] == [("d_0100", 2), ("d_0110", None)]
    flags = spark.createDataFrame([([10, 20],), ([10, 20, 30],), ([10, 200, 400],), ([1, 2, 3, 4, 6],), ([1, 3, 5],)], "ids array<long>")
    assert [r[0] for r in flags.select(readers.id_based(F.col("ids"))).collect()] == [False, True, False, True, False]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert writers.csv(df, str(tmp_path / "c"), ["a", "b", "z"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b", "z"]
    assert not writers.csv(df.limit(0), str(tmp_path / "d")) and not (tmp_path / "d").exists()
    writers.swapped(df, str(tmp_path / "s"))
    writers.swapped(df.union(df), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2 and spark.read.json(str(tmp_path / "s.bak")).count() == 1
    writers.json_lines(df.withColumn("m", F.lit("x")), str(tmp_path / "k"), by=["m"])
    assert json.loads(writers.report({"r": df.selectExpr("a", "'v' b")}).first()[0]) == {"r": {"1": "v"}}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).withColumn("k", F.col("id") % 10).repartition(5).write.parquet(str(src))
    read = incremental.stream(spark, str(src), "id long, k long", files_at_once=2)
    incremental.append(incremental.first_seen(read, "k"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("k").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_windowed_counts_are_a_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "timestamp_seconds(id * 1800) ts").write.parquet(str(tmp_path / "e"))
    read = incremental.stream(spark, str(tmp_path / "e"), "id long, ts timestamp")
    q = incremental.windowed_counts(read, "ts", []).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("windowed").collect()) == 10


def test_reasons_print_what_the_sql_prints(spark):
    """One bit below a half: the tenfold of 14.549999999999999 is 145.5."""
    df = spark.createDataFrame([("directional",), ("invariance",)], "probe_family string").selectExpr("*", "'ose' probe_subtype", "'a b' base_text", "'b c' probe_text", "'a' critical_detail")
    made = S.rule_scored(df, readability=lambda x: F.when(x == "b c", 14.549999999999999).otherwise(0.0))
    assert [r["rule_reason"] for r in made.orderBy("probe_family").collect()] == ["read_shift=PASS(-14.6),diff=PASS(0.500)", "sim=FAIL(0.500),read_delta=FAIL(14.6)"]
