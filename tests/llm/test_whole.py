"""Operators do the whole job where a cut would not show on the small tables."""

import random

import numpy as np

from lathe.llm import jaccard_join, order_minhash


def alike(spark, pairs):
    """Shares of equal entries of the fingerprints of either text."""
    rows = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    got = {r["doc_id"]: r["signature"] for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [len(set(got[2 * i]) & set(got[2 * i + 1])) / max(len(got[2 * i]), len(got[2 * i + 1])) for i in range(len(pairs))]


def test_short_texts_keep_their_order(spark):
    rnd = random.Random(5)
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(20)] for _ in range(30)]
    # all but the k-mers at the seams are in both texts
    found = alike(spark, [(" ".join(x), " ".join(x[10:] + x[:10])) for x in texts])
    assert 0.1 < np.mean(found) < 0.6


def test_repeated_passages_keep_their_order(spark):
    rnd = random.Random(6)
    pairs = []
    for _ in range(20):
        x, y = ([f"w{rnd.randrange(10**6)}" for _ in range(40)] for _ in range(2))
        pairs.append((" ".join(x + x + y + y), " ".join(y + y + x + x)))
    assert 0.2 < np.mean(alike(spark, pairs)) < 0.65


def test_repeated_id_keeps_its_unlike_text(spark):
    rnd = random.Random(7)
    x, y = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, x), (2, x + " more"), (2, y), (3, y + " more")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.keep_one(docs).collect())) == [(1, x), (2, y)]
