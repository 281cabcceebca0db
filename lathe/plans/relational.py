"""Duplicates, ranks, picks, set operations, counts and joins by place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.operators import aggregate as A
from lathe.operators import dedup as D
from lathe.operators import stats
from lathe.plans.base import Tables, query
from lathe.sources.writers import padded
from lathe.streaming import incremental

_NEAR = "left(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 60)"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_NEAR} ORDER BY source, doc_id) AS k FROM documents) WHERE k = 1")
def near_dup_keep_first(t: Tables):
    keyed = t.documents.select("doc_id", "source", D.near_key(F.col("text")).alias("key"))
    return D.keep_first(keyed, "key", ["source", "doc_id"]).select("doc_id")


@query(f"WITH a AS (SELECT doc_id, source, {_NEAR} AS k FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS r FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, doc_id) AS r2 FROM b WHERE r = 1) SELECT doc_id FROM c WHERE r2 = 1")
def near_dup_two_passes(t: Tables):
    keyed = t.documents.select("doc_id", "source", D.near_key(F.col("text")).alias("key"))
    own = D.keep_first(keyed, ["source", "key"], ["doc_id"])
    return D.keep_first(own, "key", ["source", "doc_id"]).select("doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_keep_last(t: Tables):
    return D.keep_last(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 250000), o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_per_group(t: Tables):
    return D.top_k(t.orders, "o_custkey", [F.abs(F.col("o_totalprice") - 250000), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT count(*) - count(DISTINCT user_id) AS duplicates FROM events")
def duplicate_count(t: Tables):
    return D.duplicate_count(t.events, "user_id")


@query("WITH u AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, 0 AS source_ord FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier) SELECT id, name, bal, source_ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_ord) AS k FROM u) WHERE k = 1")
def union_then_keep_first(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return D.keep_first(D.union_in_order([a, b]), "id", ["source_ord"])


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n FROM orders) SELECT o_orderkey, CAST(least(i // greatest(n // 3, 1), 2) AS INTEGER) AS shard FROM p")
def shard_split(t: Tables):
    return D.split_in_three(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 AS BIGINT) AS worker FROM orders")
def round_robin(t: Tables):
    return D.numbered(t.orders, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", (F.col("ordinal") % 4).alias("worker"))


@query("WITH p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey FROM p WHERE i IN (0, n // 4, 2 * n // 4, n - 1)")
def quartile_picks(t: Tables):
    p = D.numbered(t.customer, "c_nationkey", ["c_acctbal", "c_custkey"]).withColumn("n", F.count("*").over(Window.partitionBy("c_nationkey")))
    i, n = F.col("ordinal"), F.col("n")
    return p.where((i == 0) | (i == F.floor(n / 4)) | (i == F.floor(2 * n / 4)) | (i == n - 1)).select("c_nationkey", "c_custkey")


@query("WITH d AS (SELECT DISTINCT user_id, CAST(floor(value * 10) AS BIGINT) AS v FROM events WHERE event_type = 'purchase'), g AS (SELECT user_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY v) AS gap FROM d), a AS (SELECT user_id, count(gap) AS n, count(CASE WHEN gap > 100 THEN 1 END) AS large, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY user_id) SELECT user_id, n, large, l[n // 2 + 1] AS middle FROM a")
def id_gap_stats(t: Tables):
    ids = t.events.where("event_type = 'purchase'").select("user_id", F.floor(F.col("value") * 10).cast("long").alias("v")).distinct()
    gaps = stats.id_gaps(ids, "user_id", "v")
    return gaps.groupBy("user_id").agg(F.count("gap").alias("n"), F.count_if(F.col("gap") > 100).alias("large"), A.upper_median(F.col("gap")).alias("middle"))


@query("SELECT lang, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 2) AS mean, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY lang")
def upper_median_stats(t: Tables):
    facts = t.documents.groupBy("lang").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 2).alias("mean"))
    return facts.join(A.upper_median_table(t.documents, ["lang"], "n_chars"), "lang")


@query("SELECT CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 2000 THEN '<=2000' WHEN n_chars <= 8000 THEN '<=8000' ELSE 'more' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def bucket_histogram(t: Tables):
    return t.documents.groupBy(A.bucketed(F.col("n_chars"), [500, 2000, 8000], "more").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_join_pending(t: Tables):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_eligible(t: Tables):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def key_intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def key_except(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, 'left_only' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'right_only' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def missing_key_audit(t: Tables):
    return D.missing_both_ways(t.labels.select("doc_id"), t.documents.where("doc_id % 3 <> 0").select("doc_id"), "doc_id")


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def distinct_sorted(t: Tables):
    return t.events.select("event_type").distinct().orderBy("event_type")


@query("WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents) SELECT a.i AS ordinal, a.doc_id AS en, b.doc_id AS de, c.doc_id AS fr FROM n a JOIN n b ON a.i = b.i JOIN n c ON a.i = c.i WHERE a.lang = 'en' AND b.lang = 'de' AND c.lang = 'fr'")
def positional_alignment(t: Tables):
    n = D.numbered(t.documents.select("doc_id", "lang"), "lang", ["doc_id"])
    part = lambda v: n.where(F.col("lang") == v).select("ordinal", F.col("doc_id").alias(v))
    return part("en").join(part("de"), "ordinal").join(part("fr"), "ordinal")


@query("WITH n AS (SELECT source, lang, min(doc_id) AS d FROM documents GROUP BY ALL), f AS (SELECT source, d FROM n WHERE lang = 'en') SELECT f.source, f.d AS free, e.d AS ears, m.d AS master, e.d IS NOT NULL AS has_ears, m.d IS NOT NULL AS has_master, e.d IS NOT NULL AND m.d IS NOT NULL AS fully_aligned FROM f LEFT JOIN n e ON e.source = f.source AND e.lang = 'de' LEFT JOIN n m ON m.source = f.source AND m.lang = 'es'")
def aligned_triples(t: Tables):
    n = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("d"))
    part = lambda v, name: n.where(F.col("lang") == v).select("source", F.col("d").alias(name))
    found = part("en", "free").join(part("de", "ears"), "source", "left").join(part("es", "master"), "source", "left")
    e, m = F.col("ears").isNotNull(), F.col("master").isNotNull()
    return found.withColumns({"has_ears": e, "has_master": m, "fully_aligned": e & m})


@query("SELECT o_orderkey || '_a' AS id, o_orderstatus AS target FROM orders UNION ALL SELECT o_orderkey || '_b', o_orderpriority FROM orders")
def fan_out(t: Tables):
    two = F.array(F.struct(F.concat("o_orderkey", F.lit("_a")).alias("id"), F.col("o_orderstatus").alias("target")), F.struct(F.concat("o_orderkey", F.lit("_b")).alias("id"), F.col("o_orderpriority").alias("target")))
    return t.orders.select(F.explode(two).alias("x")).select("x.*")


@query("WITH k AS (SELECT left(p_name, 6) AS key, count(*) AS n, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY 1) SELECT key, a, b FROM k WHERE n = (SELECT min(n) FROM k) ORDER BY key LIMIT 1")
def paired_by_prefix(t: Tables):
    k = t.part.groupBy(F.substring("p_name", 1, 6).alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    return k.join(k.agg(F.min("n").alias("n")), "n").orderBy("key").limit(1).select("key", "a", "b")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def global_top_n(t: Tables):
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_type ORDER BY n DESC, first_seen LIMIT 3")
def most_common(t: Tables):
    return A.most_common(t.part, "p_type", "p_partkey", 3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 1")
def first_match(t: Tables):
    return t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42 LIMIT 1")
def point_lookup(t: Tables):
    return t.customer.where("c_custkey = 42").select("c_custkey", "c_name").limit(1)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def frequency_histogram(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT o_custkey, count(*) AS per FROM orders GROUP BY 1) SELECT per, count(*) AS items FROM i GROUP BY 1")
def count_of_counts(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("per")).groupBy("per").agg(F.count("*").alias("items"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(floor(100.0 * count(CASE WHEN n_chars > 2000 THEN 1 END) / greatest(count(*), 1)) AS BIGINT) AS long_percent, round(100.0 * count(CASE WHEN n_chars > 2000 THEN 1 END) / count(*), 1) AS long_exact FROM documents GROUP BY lang")
def group_summary(t: Tables):
    long = F.count_if(F.col("n_chars") > 2000)
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), A.percent_floor(long, F.count("*")).alias("long_percent"), F.round(100.0 * long / F.count("*"), 1).alias("long_exact"))


@query("SELECT c_custkey, c_name, coalesce(CAST(c_acctbal AS VARCHAR), '') AS c_acctbal, '' AS detail_found FROM customer")
def column_padding(t: Tables):
    return padded(t.customer, ["c_custkey", "c_name", "c_acctbal", "detail_found"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders")
def default_on_missing(t: Tables):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("priority"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1 OR lang <> 'en'")
def nullable_membership(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.where(F.col("quality").isNull() | (F.col("quality") == 1) | (F.col("lang") != "en")).select("doc_id")


@query("SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view')")
def json_field(t: Tables):
    return t.events.where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "value", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def lag_delta(t: Tables):
    return t.events.select("user_id", "event_id", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta"))


@query("SELECT * FROM (VALUES ('price', (SELECT count(*) FROM orders WHERE NOT (o_totalprice > 0))), ('status', (SELECT count(*) FROM orders WHERE NOT (o_orderstatus IN ('F', 'O')))), ('key', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL))) v(\"check\", failures), LATERAL (SELECT CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status)")
def integrity_checks(t: Tables):
    return A.checks(t.orders, {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("F", "O"), "key": F.col("o_orderkey").isNotNull()})


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(t: Tables):
    return D.hash_sample(t.documents.select("doc_id", "source"), "doc_id", 50)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def first_k_after_shuffle(t: Tables):
    return D.top_k(t.documents.select("doc_id", "source"), "source", [D.shuffled(F.col("doc_id")), "doc_id"], 5)


@query("SELECT DISTINCT user_id, 'new' AS state FROM events")
def streaming_first_seen(t: Tables):
    """Events as a stream of files: each user once, appended by micro-batch below the shared folder and read back."""
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]").select("user_id", F.lit("new").alias("state"))
    return incremental.finished(incremental.first_seen(rows, "user_id"), "first-seen")
