"""Searches that keep or add up what they find where the rows are."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import kept, lexical
from sparkloom.plans import catalogue, more


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_matches_are_added_up_in_the_partitions(spark, sf_dir):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 9)))) for k in range(2500)]
    docs = lexical.tokenised(spark.createDataFrame(rows, "doc long, text string").repartition(3), "doc", t=F.col("text"))["t"]
    asks = spark.createDataFrame([("a", ["w1", "w3", "w3"]), ("b", ["w5"]), ("c", ["unseen"]), ("d", [])], "query_id string, tokens array<string>")
    every = lexical.scores(docs, asks).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    got = {r.query_id: (r.matches, r.total) for r in lexical.totals(docs, asks).collect()}
    assert got.keys() == {"a", "b"} and got == {r.query_id: (r.n, pytest.approx(r.s)) for r in every.collect()}
    # No pair of a query and a chunk is shuffled.
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan(catalogue.REGISTRY.queries["agg9_scores_of_all_matches"](spark, sf_dir)))


def test_words_are_digested_once(spark, sf_dir):
    texts = ["The lamp of IS 4711, the LAMP", "", "no", "wire rope wire lamp " * 50, "\u0915\u0916 wire"]
    got = {r.id: r.v for r in more.counted_words(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").collect()}
    for k, text in enumerate(texts):
        want = [0] * more.DIMS
        for w in set(re.findall("[a-z0-9]{3,}", text.lower())):
            h = hashlib.md5(w.encode()).hexdigest()
            want[(ord(h[0]) * 7 + ord(h[1]) * 31 + ord(h[2])) % more.DIMS] += 1
        assert got[k] == want
    # Not in the row's expressions, where each dimension would digest all words again.
    assert "md5" not in plan(more.counted_words(spark.range(1).selectExpr("id", "string(id) as text"), "text"))


def test_the_best_are_kept_whatever_the_parts():
    rng = np.random.default_rng(5)
    ids, scores = np.array([f"i{k:04}" for k in rng.permutation(900)], object), rng.integers(-3, 40, (7, 900)) / 40
    scores[6] = -1
    for size in (1, 50, 900):
        best = kept.Best(20, 7, 0.0)
        for at in range(0, 900, size):
            best.add(ids[at : at + size], scores[:, at : at + size])
        got = list(zip(*best.rows(), strict=True))
        assert got == [(q, i, s) for q in range(7) for s, i in sorted(((-s, i) for s, i in zip(scores[q], ids) if s > 0))[:20] for s in [-s]]
