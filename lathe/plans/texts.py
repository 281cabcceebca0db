"""Sentences, ids, JSON verdicts, references, model calls, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions.models import call_models
from lathe.functions.text import clean_article, first_line_verdict, parsed_verdict, sentences, strip, tokens
from lathe.operators import aggregate as A
from lathe.operators import dedup as D
from lathe.plans.base import REQ, Tables, query, requirements
from lathe.sources.readers import blocks, id_based, id_segments, parsed_arff, requirement_ids
from lathe.sources.writers import report


@query(
    "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> '') AS parts FROM documents), "
    "u AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM s), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(left(sentence, 80)) ORDER BY place) AS r FROM u WHERE len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda z: z <> '')) BETWEEN 5 AND 80) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ordinal, sentence FROM k WHERE r = 1"
)
def sentence_split(t: Tables):
    """Sentences of each document in order, those of 5 to 80 words, the first of those that start alike."""
    s = t.documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    s = s.where(F.size(tokens(F.col("sentence"))).between(5, 80)).withColumn("key", F.lower(F.substring("sentence", 1, 80)))
    kept = D.keep_first(s, ["doc_id", "key"], ["place"])
    return D.numbered(kept, "doc_id", ["place"]).select("doc_id", "ordinal", "sentence")


@query("WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\n'), 1) - 1 AS place FROM documents), w AS (SELECT doc_id, place, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM l) SELECT doc_id, CAST(place AS INTEGER) AS place, text FROM w WHERE NOT regexp_matches(text, '^\\d{1,3}$') AND len(list_filter(string_split(text, ' '), lambda z: z <> '')) >= 3")
def block_flatten(t: Tables):
    """Lines of documents as the blocks of one page."""
    page = F.array(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"))).alias("content")))
    docs = t.documents.select(F.col("doc_id").alias("document_id"), page.alias("pages"))
    return blocks(docs).select(F.col("document_id").alias("doc_id"), F.col("block").alias("place"), "text")


_NUMBERED = "CAST(1000 + o_orderkey % 900 AS VARCHAR)"


#: Numbers below 5000 that aren't years, without a look ahead.
_ID = "\\b(0\\d{3}|1[0-8]\\d{2}|2[1-9]\\d{2}|[34]\\d{3})\\b"


@query(
    f"WITH {REQ}, d AS (SELECT doc_id, string_agg(lpad(CAST(100 + item_id % 1700 AS VARCHAR), 4, '0') || ' - ' || text, ' ' ORDER BY item_id) AS x FROM req GROUP BY doc_id), "
    f"p AS (SELECT doc_id, string_split(regexp_replace(x, '{_ID}', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS parts FROM d), "
    "u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ordinal FROM p), "
    "c AS (SELECT doc_id, ordinal, string_split(part, chr(2))[1] AS raw, trim(string_split(part, chr(2))[2]) AS chunk FROM u), "
    "b AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(chunk, '^[A-Z][A-Za-z\\s/-]+?(\\s+[A-Z][a-z]|\\s+The\\s|\\s+If\\s|\\s+When\\s|\\s+WHEN|\\s+WHERE)', '\\1')), '^[-–—]\\s*', ''), '\\s+', ' ', 'g')) AS body FROM c WHERE chunk <> ''), "
    "w AS (SELECT *, len(list_filter(string_split(body, ' '), lambda z: z <> '')) AS n FROM b) SELECT doc_id AS document_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(doc_id AS VARCHAR) || '_' || raw AS requirement_id, body AS requirement_text, n AS word_count FROM w WHERE n BETWEEN 5 AND 80"
)
def requirement_segments(t: Tables):
    """Sentences of a customer's orders in one text, each after a number; parted again at the numbers."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: F.concat(F.lpad((100 + x["item_id"] % 1700).cast("string"), 4, "0"), F.lit(" - "), x["text"])), " ")
    docs = requirements(t).groupBy(F.col("doc_id").alias("document_id")).agg(text.alias("text"))
    return id_segments(docs).select("document_id", "ordinal", "requirement_id", "requirement_text", "word_count")


@query(
    "WITH i AS (SELECT DISTINCT o_custkey, (o_orderkey % 130) * 10 AS v FROM orders), g AS (SELECT o_custkey, v, v - lag(v) OVER (PARTITION BY o_custkey ORDER BY v) AS gap FROM i), "
    "a AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN gap > 100 THEN 1 END) AS far, count(CASE WHEN v % 10 = 0 THEN 1 END) AS tens, count(gap) AS gaps, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY o_custkey) "
    "SELECT o_custkey, CAST(n AS INTEGER) AS n, CASE WHEN n < 3 OR far > gaps * 0.4 THEN false WHEN tens > n * 0.5 THEN true ELSE l[gaps // 2 + 1] <= 50 AND n >= 5 END AS by_id FROM a"
)
def numbered_documents(t: Tables):
    text = F.array_join(F.sort_array(F.collect_list(F.lpad(((F.col("o_orderkey") % 130) * 10).cast("string"), 4, "0"))), " ")
    ids = t.orders.groupBy("o_custkey").agg(text.alias("text")).select("o_custkey", requirement_ids(F.col("text")).alias("ids"))
    return ids.select("o_custkey", F.size("ids").alias("n"), id_based(F.col("ids")).alias("by_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS equivalent, 'high' AS confidence, 'ok' AS status FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, NULL, 'parse_error', 'parse_error' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, NULL, 'error', 'error' FROM events WHERE event_id % 3 = 2")
def verdict_json_parse(t: Tables):
    k = F.from_json("props", "k bigint")["k"]
    good = F.concat(F.lit('```json\n{"equivalent": '), (k % 2 == 0).cast("string"), F.lit(', "confidence": "high"}\n```'))
    raw = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.lit('{"equivalent": tr')).otherwise(F.lit("[1, 2]"))
    v = t.events.select("event_id", parsed_verdict(raw).alias("v"))
    return v.select("event_id", "v.equivalent", "v.confidence", "v.status")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS passed, o_orderpriority AS explanation FROM orders")
def first_line_verdicts(t: Tables):
    answer = F.concat(F.when(F.col("o_orderstatus") == "F", " pass - fine").otherwise("FAIL"), F.lit("\n "), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", first_line_verdict(answer).alias("v")).select("o_orderkey", "v.passed", "v.explanation")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('12 Some Title' || chr(10) || text, '^\\d+\\s+[^\\n]+\\n', ''), '\\s+', ' ', 'g')) AS clean FROM documents")
def article_clean(t: Tables):
    return t.documents.select("doc_id", clean_article(F.concat(F.lit("12 Some Title\n"), "text")).alias("clean"))


@query("WITH r AS (SELECT conv_id, list(trim(role) ORDER BY turn) AS refs FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, list_filter(refs, lambda z: z <> '')[1:10] AS refs FROM r) SELECT conv_id, CAST(len(refs) AS BIGINT) AS n, array_to_string(refs, '|') AS refs FROM c WHERE len(list_filter(refs, lambda z: z <> 'user')) > 0")
def reference_lists(t: Tables):
    """References of an item, stripped, without blanks, ten at most; items whose references all equal the original go."""
    r = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: strip(x["role"])).alias("refs"))
    r = r.withColumn("refs", F.slice(F.filter("refs", lambda z: z != ""), 1, 10)).where(~F.forall("refs", lambda z: z == "user"))
    return r.select("conv_id", F.size("refs").cast("long").alias("n"), F.array_join("refs", "|").alias("refs"))


@query("SELECT role AS value, count(*) AS n FROM conversations GROUP BY role")
def array_frequency(t: Tables):
    r = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return A.frequency(r, "roles", explode=True)


@query(f"WITH {REQ} SELECT CAST(item_id AS INTEGER) AS line, CAST(item_id AS VARCHAR) AS project_id, trim(text) AS requirement_text, 'PE' AS class, 'Performance' AS class_full, 'NFR' AS class_family, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS word_count FROM req WHERE item_id % 10 <> 9")
def arff_rows(t: Tables):
    raw = F.when(F.col("item_id") % 10 == 9, F.lit("no fields here")).when(F.col("item_id") % 2 == 0, F.concat(F.col("item_id").cast("string"), F.lit(",'"), "text", F.lit("',PE"))).otherwise(F.concat(F.col("item_id").cast("string"), F.lit(", '"), "text", F.lit("' , pe")))
    rows, _ = parsed_arff(requirements(t).select(F.col("item_id").cast("int").alias("line"), raw.alias("raw")))
    return rows


@query("WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '') AS l FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(l, lambda z: sha256('stub:' || text || ':' || z) || z)), lambda z: z[65:]), ' ') AS output FROM w")
def model_stub_map(t: Tables):
    """Answers of the offline stub to every turn."""
    asked = t.conversations.select("conv_id", "turn", F.lit("stub").alias("model_id"), F.col("text").alias("prompt"))
    return call_models(asked).select("conv_id", "turn", "output")


@query("WITH l AS (SELECT '{' || string_agg('\"' || lang || '\":\"' || n || '\"', ',' ORDER BY lang) || '}' AS j FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), s AS (SELECT '{' || string_agg('\"' || source || '\":\"' || n || '\"', ',' ORDER BY source) || '}' AS j FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) SELECT '{\"lang\":' || l.j || ',\"source\":' || s.j || '}' AS report FROM l, s")
def data_card(t: Tables):
    """One JSON document: documents by language and by source."""
    by = lambda c: t.documents.groupBy(c).agg(F.count("*").alias("n"))
    return report({"lang": by("lang"), "source": by("source")})
