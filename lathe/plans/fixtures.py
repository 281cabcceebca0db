"""Queries over small inline texts, one for each rule or repair with what is expected, and over files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions import rules as R
from lathe.functions.text import join_hyphens, with_repairs, word_count
from lathe.functions.models import judged, verified
from lathe.plans.base import Tables, query
from lathe.sources import readers, writers
from lathe.streaming import incremental

#: A text that fires each rule, and why it is rejected; then one like it that is kept.
REJECTED = [
    ("The system shall log it.", "word_count", "The system shall log each call of every user."),
    ("The system keeps a log of every call made today.", "no_modal_verb", "The system will keep a log of every call made today."),
    ("Consequently, the system shall keep a log of every call.", "context_opener", "The system shall consequently keep a log of every call."),
    ("They shall keep a log of every call made today.", "pronoun_subject", "The clerks shall keep a log of every call made today."),
    ("You must keep a log of every call made today.", "second_person_subject", "The clerk must keep a log you made of every call."),
    ("The rule shall apply as this page intentionally left blank.", "deleted_marker", "The rule shall apply as the page was left blank."),
    ("Call Log - The list that shall hold every call made.", "glossary_definition", "The call-log list shall hold every call made today."),
    ("The unit shall follow version 2.10 of the call protocol.", "doc_header_noise", "The unit shall follow the last version of the protocol."),
    ("The unit shall keep a log of the following calls:", "truncated_list", "The unit shall keep a log: of calls, and of users."),
    ("Users are expected to have a badge and shall wear it.", "non_system_statement", "Users of the system shall have a badge and wear it."),
    ("The unit shall list actors and the post conditions of calls.", "metadata_template_dump", "The unit shall list actors and the end of all calls."),
    ("Assumptions: the unit shall be on at all times here.", "assumption_entry", "The unit shall be on under all assumptions made here."),
    ("The unit shall store the log at ••• each and every day.", "ocr_corruption", "The unit shall store the log at • each and every day."),
    ("The unit shall call log.write() at the end of the day.", "source_code_block", "The unit shall call the log at the end of the day."),
    ("The use case of a call shall be listed with its req id.", "table_row_dump", "The use of a call shall be listed with its own id."),
    ("Fill in the form that the clerk shall keep each day.", "doc_authoring_instruction", "The clerk shall fill in the form and keep it each day."),
    ("The manual states that the unit shall keep a log.", "citation_prose", "The manual (part two) states that the unit shall keep a log."),
    ("The unit shall stop after somebody presses the red button.", "use_case_scenario", "The unit shall stop after the red button has been pressed."),
    ("The unit shall show description: and below that the name: too.", "db_record_dump", "The unit shall show description: and nothing else below that."),
    ("The call codes will be numbered in order of their time.", "versioning_statement", "The call codes will have numbers in order of their time."),
    ("A clerk may want to see a list of all calls.", "user_intention_not_req", "A clerk may see a list of all calls on demand."),
    ("The unit shall keep a log. 3.1 Calls are kept too.", "section_tag_merge", "The unit shall keep a log. 3 calls are kept too."),
    ("The module is responsible for logs and shall keep them.", "architectural_description", "The module shall be responsible for logs and keep them."),
    ("Note: requirements shall be reviewed by the board each and every year.", "doc_management_statement", "Note: calls shall be reviewed by the board each and every year."),
    ("The unit shall keep a log as told in appendix B.", "external_reference", "The unit shall keep a log as told in the appendix."),
]
NOISY = [
    ("2.1 Overview of calls", True), ("Table of calls", True), ("Revision history of it", True), ("key: value", True), ("a | b | c", True), ("Warning: hot", True),
    ("[SRSreq 12] The unit", True), ("Overview 2.1 of calls", False), ("A table of calls", False), ("key and value", False), ("a | b", False),
]
#: A text for each repair step, in order, and what it becomes; then one that the step leaves alone.
REPAIRED = [
    ("The “red” unit’s log shall be kept", "The \"red\" unit's log shall be kept"),
    ("The unit shall keep a log. ~ owner: me ~", "The unit shall keep a log."),
    (f"The unit shall keep a log ~ of {'calls and ' * 9}users", f"The unit shall keep a log ~ of {'calls and ' * 9}users"),
    ("The unit shall keep a log. Then, it shall stop.", "The unit shall keep a log."),
    ("The unit shall keep a log, then it shall stop.", "The unit shall keep a log, then it shall stop."),
    ("▪ the unit shall keep a log", "The unit shall keep a log"),
    ("-the unit shall keep a log", "-the unit shall keep a log"),
    ("Furthermore, the unit shall keep a log", "The unit shall keep a log"),
    ("Further, the unit shall keep a log", "Further, the unit shall keep a log"),
    ("REQ-AB12 the unit shall keep a log", "The unit shall keep a log"),
    ("REQ the unit shall keep a log", "REQ the unit shall keep a log"),
    ("3 call log: the unit shall keep a log of all calls made", "The unit shall keep a log of all calls made"),
    ("3 call log: keep it", "3 call log: keep it"),
    ("call table req id AB12 the unit shall keep a log of all calls", "The unit shall keep a log of all calls"),
    ("call table req id AB12 keep it", "Call table req id AB12 keep it"),
    ("The unit (see 3.1) shall keep a log", "The unit shall keep a log"),
    ("The unit (see below) shall keep a log", "The unit (see below) shall keep a log"),
    ("The unit shall keep a log (3.1.4)", "The unit shall keep a log"),
    ("The unit (O) shall keep a log", "The unit shall keep a log"),
    ("The unit (X) shall keep a log", "The unit (X) shall keep a log"),
    ("The unit shall keep a log of all calls. It shall stop.4 Calls are kept", "The unit shall keep a log of all calls."),
    ("It shall stop.4 Calls are kept", "It shall stop.4 Calls are kept"),
    ("The  unit\tshall\n keep   a log", "The unit shall keep a log"),
    ("the unit shall keep a log", "The unit shall keep a log"),
    (" The unit shall keep a log ", "The unit shall keep a log"),
]
HYPHENS = [("a re-\nport of calls", "a report of calls"), ("a re- \n port", "a report"), ("well-known calls", "well-known calls"), ("a - b\nc", "a - b c")]
ANSWERS = [("YES, they are", True, False), (" pass: fine", False, True), ("ERROR: 429", True, False), ("no", False, False), ("", False, False)]


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    """SQL for rows as they are: what is expected of texts that are as few."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({names})"


def _frame(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


@query(_values([(i, x, r) for i, (a, why, b) in enumerate(REJECTED) for x, r in ((a, why), (b, None))], "id, text, reason"))
def reject_rules(t: Tables):
    """Each rule with a text that it rejects, by that reason and none before it, and one that stays."""
    rows = _frame(t, [(i, x) for i, (a, _, b) in enumerate(REJECTED) for x in (a, b)], "id int, text string")
    return rows.select("id", "text", R.reason(F.col("text"), word_count(F.col("text")), external=True).alias("reason"))


@query(_values(NOISY, "text, noisy"))
def early_noise(t: Tables):
    return _frame(t, [r[:1] for r in NOISY], "text string").select("text", R.noisy(F.col("text")).alias("noisy"))


@query(_values(REPAIRED, "raw, fixed"))
def repair_steps(t: Tables):
    return with_repairs(_frame(t, [r[:1] for r in REPAIRED], "raw string"), "raw", "fixed").select("raw", "fixed")


@query(_values(HYPHENS, "raw, joined"))
def hyphens_joined(t: Tables):
    return _frame(t, [r[:1] for r in HYPHENS], "raw string").select("raw", join_hyphens(F.col("raw")).alias("joined"))


@query(_values(ANSWERS, "answer, verified, judged"))
def verdicts_of_models(t: Tables):
    """A paraphrase check takes an error as a pass, a judge as a fail."""
    return _frame(t, [r[:1] for r in ANSWERS], "answer string").select("answer", verified(F.col("answer")).alias("verified"), judged(F.col("answer")).alias("judged"))


# Files: written below the shared folder, and read back by the readers.


@query("SELECT item_id, text, 1 AS part FROM benchmark UNION ALL SELECT item_id, text, 2 FROM benchmark WHERE item_id % 2 = 0")
def json_lines_appended(t: Tables):
    """JSON lines written, appended to, and read by schema."""
    path, rows = writers.shared_path(t.spark, "lines"), t.benchmark.select("item_id", "text")
    writers.json_lines(rows.withColumn("part", F.lit(1)), path)
    writers.json_lines(rows.where("item_id % 2 = 0").withColumn("part", F.lit(2)), path, append=True)
    return readers.json_lines(t.spark, path, "item_id long, text string, part int")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def json_array_elements(t: Tables):
    """An array in a file; a file that isn't there has no elements."""
    path = writers.shared_path(t.spark, "array")
    one = t.nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))).alias("value"))
    one.coalesce(1).write.text(path)
    schema = "name string, region long"
    return readers.json_array(t.spark, path, schema).union(readers.json_array(t.spark, path + "-none", schema, missing_ok=True))


@query("SELECT r_name AS document_id, CAST(1 AS INTEGER) AS block, 'The unit of ' || r_name || ' runs' AS text, CAST(NULL AS VARCHAR) AS error FROM region UNION ALL SELECT 'BROKEN', NULL, NULL, 'malformed JSON'")
def nested_documents(t: Tables):
    """A JSON file for each document, its name the id; a malformed one is an error."""
    path = writers.shared_path(t.spark, "documents")
    body = F.concat(F.lit('{"pages": [{"content": [{"text": "12"}, {"text": "The unit of '), "r_name", F.lit(' runs"}]}]}'))
    bodies = t.region.select(F.col("r_name").alias("name"), body.alias("value")).union(t.spark.createDataFrame([("BROKEN", '{"pages": [')], "name string, value string"))
    bodies.repartition(1).write.partitionBy("name").text(path)
    # one file in each folder: named by its key
    named = _renamed(t, path, ".json")
    good, errors = readers.documents(t.spark, f"{named}/*.json")
    found = readers.blocks(good).select("document_id", "block", "text", F.lit(None).cast("string").alias("error"))
    return found.union(errors.select("document_id", F.lit(None).cast("int"), F.lit(None).cast("string"), "error"))


@query("SELECT o_orderpriority AS model, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def keyed_outputs(t: Tables):
    """Files by key: a file of lines for each model, its name the model's."""
    path = writers.shared_path(t.spark, "outputs")
    writers.json_lines(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("name")).repartition(1), path, by=["name"])
    named = _renamed(t, path, "_scores.jsonl")
    return readers.keyed_files(t.spark, f"{named}/*.jsonl", "o_orderkey long", r"_scores\.jsonl").groupBy("model").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _renamed(t: Tables, path: str, suffix: str) -> str:
    """A folder with the files of ``path/name=<key>/`` as ``<key><suffix>``: a handful, moved by the store."""
    jvm = t.spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path + "-named"))
    for folder in fs.listStatus(at(path)):
        name = folder.getPath().getName()
        if name.startswith("name="):
            for f in fs.globStatus(at(f"{path}/{name}/part-*")):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(at(path + "-named"), name.removeprefix("name=") + suffix))
    return path + "-named"


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(NULL AS VARCHAR) AS note FROM part")
def csv_written(t: Tables):
    """A summary as CSV with fixed columns; a column that is missing is blank."""
    path = writers.shared_path(t.spark, "csv")
    writers.csv(t.part.select("p_partkey", "p_brand"), path, ["p_partkey", "p_brand", "note"])
    return t.spark.read.option("header", True).csv(path)


@query("SELECT n_nationkey, 'new' AS version FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'old' FROM nation")
def swapped_files(t: Tables):
    """A table replaced by a new version, which leaves the old one beside it."""
    path = writers.shared_path(t.spark, "swapped")
    writers.swapped(t.nation.select("n_nationkey"), path)
    writers.swapped(t.nation.where("n_nationkey % 2 = 0").select("n_nationkey"), path)
    read = lambda at, version: t.spark.read.schema("n_nationkey long").json(at).withColumn("version", F.lit(version))
    return read(path, "new").union(read(path + ".bak", "old"))


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) > (SELECT count(*) FROM part) // 2 AS late FROM part")
def streaming_rewritten(t: Tables):
    """A stream that is stopped after the first half of its files and started again: the checkpoint goes on where it was, and no row comes twice."""
    path = writers.shared_path(t.spark, "resumed")
    half = t.part.count() // 2
    late = F.col("place") > half
    placed = t.part.select("p_partkey", "p_brand", F.row_number().over(_in_order("p_partkey")).alias("place")).select("p_partkey", "p_brand", late.alias("late"))
    for part in (False, True):
        placed.where(F.col("late") == part).write.mode("append").parquet(f"{path}/in")
        incremental.append(incremental.stream(t.spark, f"{path}/in", "p_partkey long, p_brand string, late boolean", files_at_once=2), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("p_partkey", "p_brand", "late")


def _in_order(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


@query("SELECT p_partkey AS item_id, CAST(NULL AS VARCHAR) AS probe_id, 'm0' AS model_id FROM part WHERE p_partkey % 3 <> 0")
def pending_without_retry(t: Tables):
    """A queue without what has any output, failed ones too."""
    jobs = t.part.selectExpr("p_partkey AS item_id", "CAST(NULL AS STRING) AS probe_id", "'m0' AS model_id")
    outputs = jobs.where("item_id % 3 = 0").selectExpr("*", "'' AS rewrite", "'empty' AS run_status")
    return incremental.resumed(jobs, outputs, retry_failed=False)
