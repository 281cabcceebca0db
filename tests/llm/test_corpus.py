"""Deduplication, joins, mixing, fingerprints, the classifier and the pipeline against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from lathe.llm import bpe, common, components, cotrain, jaccard_join, mixing, order_minhash, registry, substring_dedup
from lathe.llm.shingles import shingle_set
from tests.llm.test_tokens import plain_redact


# --- repeated passages


def repeats(rows, width=13):
    words = [(d, (x or "").encode().split()) for d, x in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                least[k] = min(d, least.get(k, d))
    out = Counter()
    for d, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1 if d is not None else 0):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = b"\1" * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def removed(df):
    return Counter(map(tuple, substring_dedup._removed(df, "text", "doc_id", 13, True).collect()))


def test_repeats_in_runs_and_periods(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        if rnd.random() < 0.4 and rows:
            b = rnd.choice(rows)[1].split()
            k = rnd.randrange(len(b) + 1)
            x = " ".join([*(rnd.choice("abc") for _ in range(rnd.randint(0, 6))), *b[k : k + rnd.randint(5, 40)], *(rnd.choice("abcd") for _ in range(rnd.randint(0, 6)))])
        else:
            x = " ".join(rnd.choice(["a", "b", "c", "ab", "a a a a a a", "a b a b a b", " ".join("x%d" % rnd.randrange(30) for _ in range(9))]) for _ in range(rnd.randint(0, 30)))
        rows.append((i, x))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        assert removed(df.repartition(n)) == repeats(rows)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    passage[20:26] = passage[20]
    docs = [np.concatenate([rng.integers(0, 2**63, a).astype(np.uint64), passage, rng.integers(0, 2**63, b).astype(np.uint64)]) for a, b in ((0, 0), (3, 40), (17, 5))]
    edges = np.cumsum([0, *map(len, docs)])
    start, place, symbol = substring_dedup.anchors(np.concatenate(docs), edges)
    seen = [{int(s - o): (int(p - s) if p >= 0 else None, int(y)) for s, p, y in zip(start, place, symbol, strict=True) if o <= s <= o + 47} for o in (edges[:-1] + np.array([0, 3, 17]))]
    assert len(seen[0]) == 48 and seen[0] == seen[1] == seen[2]


def test_repeats_in_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert removed(odd) == repeats(rows)
    assert substring_dedup.without_repeats(empty).count() == 0


def test_places_by_shuffle(spark, sf_dir, docs, monkeypatch):
    """The plan beyond the bound of broadcasts gives the same rows."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, substring_dedup.op3_substring_dedup(spark, sf_dir).collect())) == repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_op3_query(spark, sf_dir, docs):
    assert Counter(map(tuple, substring_dedup.op3_substring_dedup(spark, sf_dir).collect())) == repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


# --- similarity join


def linked(rows):
    sets = [(d, frozenset(shingle_set(x or "").tolist())) for d, x in rows if d is not None]
    inverted = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for h in s:
            inverted[h].append(i)
    n, parent = Counter(), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j, k in Counter(j for h in s for j in inverted[h] if j < i).items():
            if k >= 0.8 * (len(s) + len(sets[j][1]) - k) - 1e-9:
                n[i] += 1
                n[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return Counter([(d, least[root(i)], n[i]) for i, (d, _) in enumerate(sets)])


def joined(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar(df).where("doc_id is not null").collect())


def near_copies(n, seed=1, words=60):
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(words)] = f"n{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_join_counts_each_link(spark, monkeypatch):
    rows = near_copies(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows)
    assert joined(df) == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)  # the same through many blocks
    assert joined(df) == want


def test_chains_are_compared_with_their_neighbours_alone(spark):
    """Neighbours in a chain are too unlike to be linked and alike enough to be compared: work grows with the chain, not with its square."""
    rnd = random.Random(8)

    def compared(n):
        words = [f"w{rnd.randrange(10**7)}" for _ in range(200 + 50 * n)]
        rows = [(i, " ".join(words[50 * i : 50 * i + 200])) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        signed = jaccard_join.signatures(df).where("n > 0").withColumn("copies", F.lit(1).cast("long"))
        found = jaccard_join.candidates(signed)
        assert jaccard_join.links(df, signed, found).count() == 0
        return sum(r["count"] ** 2 for r in found.groupBy("_key").count().collect())

    few, many = compared(60), compared(240)
    assert 0 < many < 8 * max(few, 30)


def test_joins_by_shuffle(spark, sf_dir, docs, monkeypatch):
    """The plans beyond the bounds of broadcasts give the same rows."""
    want = linked([(r["doc_id"], r["text"]) for r in docs.collect()])
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar(docs).collect()) == want
    ids = {d for d, c, _ in want if c != d}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()} == {d for d, _, _ in want} - ids


def test_join_on_odd_rows(odd, empty):
    assert joined(odd) == linked([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = {r["doc_id"]: r for r in jaccard_join.similar(odd).collect()}
    assert got[None]["class_id"] is None and got[None]["n_links"] == 0 and got[7]["class_id"] == 6 and got[6]["n_copies"] == 3
    assert jaccard_join.similar(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns[0] == "doc_id" and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_op7_query(spark, sf_dir, docs):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.op7_jaccard_join(spark, sf_dir).collect())
    assert got == linked([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-9, 128, 16)
    assert list(least) == sorted(least) and 40 < least[-1] < 102
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 256, (3, 128)).astype(np.uint8)
    sig[1] = np.where(rng.random(128) < 0.85, sig[0], sig[1])
    a, b = jaccard_join.survivors(np.array([0, 0]), np.array([1, 2]), sig, least)
    assert (a.tolist(), b.tolist()) == ([0], [1])


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).where("node <> root").collect()))
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


def test_mix(spark, odd, empty):
    rates = {r["source"]: r for r in mixing.rates(odd).collect()}
    assert set(rates) == {None, "", "a", "b", "c"} and rates["a"]["source_size"] == 0 and rates["a"]["rate"] == 0
    assert sum(r["target"] for r in rates.values()) == pytest.approx(sum(r["source_size"] for r in rates.values()))
    assert all(r["target"] <= 3 * r["source_size"] + 1e-6 for r in rates.values())
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and sorted(map(repr, taken.collect())) == sorted(map(repr, mixing.mix(odd).collect()))
    assert mixing.mix(empty).count() == 0


def test_targets_reshare_until_none_is_above(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert (got["a"], got["b"]) == (30, 3) and got[None] == pytest.approx(1078 / 4) and got["c"] == pytest.approx(1078 * 3 / 4)


def water_filled(sizes, most=3):
    """Targets by resharing the excess, source by source."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while True:
        left = sum(sizes.values()) - sum(target[n] for n in names if n not in open_)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > most * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = most * sizes[n]
        open_ -= over


def test_targets_of_many_sources(spark):
    rnd = random.Random(11)
    sizes = {**{f"host{rnd.randrange(10**6)}": int(rnd.paretovariate(0.6)) for _ in range(700)}, None: 50, "": 9}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    want = water_filled(sizes)
    assert set(got) == set(want) and all(got[n] == pytest.approx(want[n]) for n in want)


def test_null_ids_draw_by_text(spark):
    rows = [(None, f"w{i} x", s) for i in range(400) for s in "ab"] + [(None, "y", "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = {r["source"]: r["rate"] for r in mixing.rates(df).collect()}
    taken = Counter(r["source"] for r in mixing.mix(df).collect())
    assert all(abs(taken[s] - 400 * rate[s]) < 60 for s in "ab")


def test_mix_comes_near_its_targets(spark):
    rows = [(i, f"s{i % 3}", "w " * (1 + i % 50)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    rates = {r["source"]: r for r in mixing.rates(df).collect()}
    took = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    for s, r in rates.items():
        assert took[s] == pytest.approx(r["target"], rel=0.05)


# --- Order MinHash


def spark_hash(*values):
    """Spark's xxhash64: ints of four bytes, ("long", x) of eight, strings; nulls are left out."""
    seed = 42
    for v in values:
        if v is not None:
            data = v[1].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else v.to_bytes(4, "little")
            seed = xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_signature(text, k=order_minhash.K, l=order_minhash.L, entries=order_minhash.ENTRIES, hashes=order_minhash.HASHES, seed=order_minhash.SEED):  # noqa: E741
    """Of the pairs (k-mer, occurrence), for each hash function the l least, in text order."""
    words = [w.decode() for w in text.encode().split()]
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    kmers = [spark_hash(seed, *g, *[None] * (k - len(g))) % 2**63 for g in grams]
    seen, codes = Counter(), []
    for x in kmers:
        codes.append(spark_hash(("long", x), seen[x]) % 2**63 if seen[x] else x)
        seen[x] += 1
    out, each = [], entries // hashes
    for e in range(entries if grams else 0):
        h, r = divmod(e, each)
        point = 2**63 // each * r + 2**63 // each // 2
        least = sorted(range(len(codes)), key=lambda i: (spark_hash(("long", codes[i]), h) - point) % 2**63)[:l]
        acc = seed + 1
        for i in sorted(least):
            acc = signed(spark_hash(("long", acc), ("long", kmers[i])))
        out.append(signed(e << 59 | acc % 2**64 >> 5))
    return out


def plain_likeness(a, b):
    return len(set(a) & set(b)) / max(len(a), len(b)) if a or b else 1.0


def test_signature_entries(spark):
    rnd = random.Random(3)
    texts = ["", "one", "a b", "a b c d", " ".join(rnd.choice("abc") for _ in range(200)), " ".join(f"w{rnd.randrange(500)}" for _ in range(400)), "und " * 300, "x y z " * 40 + "end"]
    texts += [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 90))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in order_minhash.ordered(df, "text", "s").collect():
        assert r["s"] == plain_signature(r["text"]), r["text"]


def test_order_counts(spark):
    words = [f"w{i}" for i in range(300)]
    turned = words[150:] + words[:150]
    rnd = random.Random(1)
    mixed = list(words)
    rnd.shuffle(mixed)
    rows = [(" ".join(words), " ".join(words)), (" ".join(words), " ".join(turned)), (" ".join(words), " ".join(mixed)), ("", ""), ("", "a")]
    df = order_minhash.ordered(order_minhash.ordered(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    same, moved, shuffled, none, one = [r[0] for r in df.select(order_minhash.likeness(F.col("x"), F.col("y"))).collect()]
    assert same == 1 and shuffled < moved < 1 and none == 1 and one == 0


def test_offsets_estimate_like_independent_hashes():
    """The mean over many texts is what 32 hashes of their own give; the spread on short texts is wider."""
    rnd = random.Random(9)
    few, many = [], []
    for _ in range(60):
        x = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((12, 40, 120)))]
        y = x[: len(x) * 3 // 4] + [f"w{rnd.randrange(10**6)}" for _ in range(len(x) // 4)]
        for hashes, found in ((order_minhash.HASHES, few), (order_minhash.ENTRIES, many)):
            found.append(plain_likeness(plain_signature(" ".join(x), hashes=hashes), plain_signature(" ".join(y), hashes=hashes)))
    assert abs(np.mean(few) - np.mean(many)) < 0.04 and np.std(few) < 1.6 * np.std(many)


def test_next_documents(spark, odd, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (1, 3, 50, None):
        got = order_minhash.with_next(common.texts(odd), ["text"], ranges=n).collect()
        assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in got) == Counter((d, x, rows[(i + 1) % len(rows)][1]) for i, (d, x) in enumerate(rows))
    assert order_minhash.with_next(common.texts(empty), ["text"]).count() == 0


def test_op9_query(spark, sf_dir, docs):
    """Every column is what brute force gives."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in order_minhash.op9_order_minhash(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    signatures = [plain_signature(x) for _, x in rows]
    shown = lambda s: ":".join(f"{x % 2**64:016x}" for x in s)
    for i, (d, x) in enumerate(rows):
        j = (i + 1) % len(rows)
        c = len(x) // 4
        edited = x[: len(x) - c] + rows[j][1][:c]
        own, s = got[d], plain_signature(edited)
        assert (own["n_chars"], own["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (own["fingerprint"], own["edited_fingerprint"]) == (shown(signatures[i]), shown(s))
        assert (own["near_edited"], own["near_next"]) == (plain_likeness(signatures[i], s), plain_likeness(signatures[i], signatures[j]))


# --- classifier and pipeline


def accuracy(table, model, labels, used):
    held = cotrain.scored(table, model).join(labels.join(used, "doc_id", "left_anti"), "doc_id").collect()
    assert len(held) > 150
    return np.mean([(r["score"] >= cotrain.KEEP) == (r["quality"] == 1) for r in held])


def test_held_out_accuracy(spark):
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = cotrain.figured(docs)
    used = labels.orderBy(F.xxhash64(F.lit("some"), "doc_id"), "doc_id").limit(150)
    model = cotrain.fit(table, used)
    assert accuracy(table, model, labels, used) > 0.97
    # each view teaches the other, in each round
    assert len(model.history) == cotrain.ROUNDS and all(a and b for a, b in model.history)


def test_rounds_gain_with_few_labels(spark):
    docs, labels = common.documents(spark, "/root/testdata/sf0.1").repartition(4), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    table = cotrain.figured(docs)
    used = labels.orderBy(F.xxhash64(F.lit("x"), "doc_id")).limit(30)
    without, taught = (cotrain.fit(table, used, rounds=n) for n in (0, cotrain.ROUNDS))
    assert accuracy(table, taught, labels, used) > accuracy(table, without, labels, used)
    assert all(a and b for a, b in taught.history)


def test_pseudo_labels_cover_all_documents(spark):
    """Sums over the whole table are what one pass in numpy gives, and grow with it."""
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = cotrain.figured(docs)
    marked = cotrain.labelled(table, labels)
    model = cotrain.fit(table, labels, rounds=0)
    own, rows = cotrain.Everything(marked), marked.where("label is null").collect()
    every = cotrain.Rows([r["figures"] for r in rows], [bytes(r["words"]) for r in rows], [cotrain.metadata(r["lang"], r["source"], r["n_chars"]) for r in rows], [None] * len(rows))
    counts = own.counts(model)
    assert [c.sum() for c in counts] == [len(rows)] * 2
    low, high = zip(*(model._extremes(c, 0.2) for c in counts), strict=True)
    x, z = model.calibrated(every)
    for v, (gradient, hessian, weight, n) in enumerate(own.sums(model, low, high, model.models)):
        y, w = model.pseudo_labels(z[1 - v], z[v], low[1 - v], high[1 - v])
        want = model.models[v].sums(x[v], y, w)
        assert n == np.count_nonzero(w) > 0 and np.isclose(weight, w.sum())
        assert np.allclose(gradient, want[0]) and np.allclose(hessian, want[1])
    doubled = cotrain.Everything(marked.union(marked)).counts(model)
    assert all((2 * a == b).all() for a, b in zip(counts, doubled, strict=True))


def test_classifier_edges(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1), (2, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in cotrain.scored(cotrain.figured(odd), cotrain.fit(cotrain.figured(odd), labels)).collect()} == {1.0}
    assert cotrain.keep_good(odd, labels).columns == odd.columns and cotrain.keep_good(odd, labels).count() == odd.count()
    assert cotrain.keep_good(empty, labels).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(2, 10)], "doc_id long, quality int")
    table = cotrain.figured(odd)
    model = cotrain.fit(table, both)
    scores = cotrain.scored(table, model).collect()
    assert model.fitted and len(scores) == odd.count()
    assert len({r["score"] for r in scores if r["doc_id"] == 7}) <= 2  # rows of one id with unlike lengths may differ
    kept = Counter(map(tuple, cotrain.keep_good(odd, both).collect()))
    assert not kept - Counter(map(tuple, odd.collect()))


def test_op1_query(spark, sf_dir, docs):
    """A row for each document, with the scores that its figures give by the same models."""
    got = {r["doc_id"]: r for r in cotrain.op1_quality_cotraining(spark, sf_dir).collect()}
    table = cotrain.figured(docs)
    model = cotrain.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    read = docs.collect()
    assert set(got) == {r["doc_id"] for r in read}
    seen = [cotrain.figures(r["text"] or "") for r in read]
    every = cotrain.Rows(np.array([f for f, _ in seen], dtype=np.float32), [w for _, w in seen], [cotrain.metadata(r["lang"], r["source"], r["n_chars"]) for r in read], [None] * len(read))
    for r, text, meta, both in zip(read, *model.scores(every), strict=True):
        own = got[r["doc_id"]]
        assert np.allclose([own["text_score"], own["metadata_score"], own["score"]], [text, meta, both], atol=2e-6)
        assert own["keep"] == (own["score"] >= cotrain.KEEP)


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = common.documents(spark, sf_dir)
    before = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == before, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()))


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input in plain Python; scores by the fitted models on figures made here."""
    sf_dir = "/root/testdata/sf0.001"
    docs, library = common.documents(spark, sf_dir), Tokenizer.from_file(bpe.default_vocabulary())
    model = cotrain.fit(cotrain.figured(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    read = docs.collect()
    seen = [cotrain.figures(r["text"] or "") for r in read]
    every = cotrain.Rows(np.array([f for f, _ in seen], dtype=np.float32), [w for _, w in seen], [cotrain.metadata(r["lang"], r["source"], r["n_chars"]) for r in read], [None] * len(read))
    good = [r for r, score in zip(read, model.scores(every)[2], strict=True) if round(score, 6) >= cotrain.KEEP]
    least = {d: c for d, c, _ in linked([(r["doc_id"], r["text"]) for r in good])}
    own = [(r["doc_id"], plain_redact(r["text"]), r["source"]) for r in good if least[r["doc_id"]] == r["doc_id"]]
    sizes = Counter()
    for _, text, source in own:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    target, want = water_filled(sizes), Counter()
    for d, text, source in own:
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        chance = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:8], 16) / 2**32
        ids = library.encode(text, add_special_tokens=False).ids
        n = int(rate) + (chance < rate - int(rate))
        if n:
            want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_batches_are_bounded_by_the_plan(spark, monkeypatch):
    """Operators leave the session's settings alone, and a plan keeps its bound whatever else was planned after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    one = common.in_batches(spark.range(2000), sizes, "n long", rows=1)
    other = common.in_batches(spark.range(2000), sizes, "n long")
    assert max(r[0] for r in other.collect()) == common.BATCH_ROWS and max(r[0] for r in one.collect()) == 1
    assert spark.conf.get(key) == before


def test_clusters_need_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_prefix_sums(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(100)) for k in rnd.sample(range(-1000, 10_000), 300)]
    got = {r["k"]: r["s"] for r in common.prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s", width=7).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_registry():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
