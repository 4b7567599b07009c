"""Tokens, shared spans, repeated lines, languages: against the public library, brute force, held-out sentences and edge cases."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import language, mixing, repeats, spans, tokens
from sparkloom.runtime import table

PATH = f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}"
FILE = tokens.vocabulary_file()


@lru_cache(1)
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def public():
    return library()


def split(counts, flat):
    at = 0
    for n in counts.tolist():
        yield flat[at : at + n].tolist()
        at += n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stmdrevl  \n\t.,19é९़क中😀 ­"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_tokens_equal_the_public_library(texts):
    t = library()
    got = list(split(*tokens.Encoder(FILE).encode(texts)))
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_vocabulary_entry_is_one_token_or_as_merged(public):
    v = tokens.vocabulary(FILE)
    words = [w for w in v.ids if w != b"<|endoftext|>"]
    assert sum(len(x) != 1 for x in v.encode_words(words)) == 0
    rng = random.Random(1)
    joined = [rng.choice(words) + rng.choice(words) for _ in range(3000)]
    assert v.encode_words(joined) == [v.merged(w) for w in joined]


def test_words_of_one_digest(public):
    """Thue-Morse words: their digests agree for any base of a polynomial modulo a power of two."""
    for n in (1024, 2048, 8192):
        a = "".join("ab"[k.bit_count() & 1] for k in range(n))
        pair = [a, a.translate(str.maketrans("ab", "ba"))]
        want = [public.encode(t, add_special_tokens=False).ids for t in pair]
        coder = tokens.Encoder(FILE)
        assert list(split(*coder.encode([" ".join(pair), *pair]))) == [public.encode(" ".join(pair), add_special_tokens=False).ids, *want]
        # Also where the first of them has been kept from an earlier slice.
        coder = tokens.Encoder(FILE)
        assert [next(split(*coder.encode([t]))) for t in [*pair, *pair]] == [*want, *want]
        assert coder.encode(pair, counts_only=True)[0].tolist() == [len(w) for w in want]


def test_encoding_of_a_table(spark, sf_dir, public):
    docs = table(spark, sf_dir, "documents").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encoded(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    want = public.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: e.ids for r, e in zip(rows, want, strict=True)}
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 1_300_000), (3, "<|endoftext|>")], "doc_id long, text string")
    ids = [(r.doc_id, r.ids) for r in tokens.encoded(edge, "doc_id", "text").collect()]
    assert ids[0][1] == [] and ids[1][1] == [] and ids[2][1] == public.encode("x" * 1_300_000, add_special_tokens=False).ids and len(ids) == 4
    assert tokens.encoded(edge.limit(0), "doc_id", "text").count() == 0


def brute_pairs(rows, n):
    own = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            own[t[k : k + n]].add(i)
    return {p for s in own.values() for p in itertools.combinations(sorted(s), 2)}


def test_shared_spans_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {(r[0], r[1]) for r in spans.pairs_found(docs, "doc_id", "text").collect()}
    assert got == brute_pairs(rows, 250)


def test_shared_spans_of_random_and_odd_texts(spark):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abc \n") for _ in range(n))
    common = [make(rng.randint(35, 90)) for _ in range(6)]
    rows = [(i, make(rng.randint(0, 60)) + rng.choice(common) + make(rng.randint(0, 60)) + rng.choice(common)[: rng.randint(20, 90)]) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a" * 200), (63, "b" + "a" * 90), (64, rows[0][1]), (65, rows[0][1]), (66, "ab" * 60), (67, "xab" * 9 + "ab" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("rep", F.lit(1))
    got = {(r[0], r[1]) for r in spans.pairs_found(df, "doc_id", "text", 40, 16).collect()}
    assert got == brute_pairs(rows, 40)
    # With units taken apart as soon as they stand three times.
    assert {(r[0], r[1]) for r in spans.pairs_found(df, "doc_id", "text", 40, 16, hot_units=2).collect()} == got
    share = {r.doc_id: r for r in spans.shared_share(df, "doc_id", "text", 40, 16).collect()}
    assert share[64].rep == 0 and share[64].shared == 1.0 and share[60].shared_chars == 0 and len(share) == len(rows)
    for i, t in rows[:60]:
        covered = [False] * len(t)
        for j, u in rows:
            if j != i and u:
                for k in range(len(t) - 39):
                    if t[k : k + 40] in u:
                        covered[k : k + 40] = [True] * 40
        assert share[i].shared_chars == sum(covered), i
    assert spans.pairs_found(df.limit(0), "doc_id", "text").count() == 0


def test_units_begin_at_lines(spark):
    """Where lines are short, units are lines' beginnings; long lines are cut by content."""
    lines = "".join(f"\n{k:05d} " + "x" * 50 + f"{k * k:07d}" for k in range(40))
    d, p = spans._units(lines, 250, 110)
    assert all(lines[k] == "\n" for k in p.tolist())
    d, p = spans._units("y" + lines.replace("\n", " ") * 3, 250, 110)
    assert len(p) and np.diff(p).max() <= 141


def brute_lines(rows, share, least, letters):
    norm = lambda s: re.sub("#+", "#", "".join("#" if not c.isalpha() else c for c in s.lower() if c.isalnum()))
    once = {c: (s, t) for c, s, t in rows if c is not None}
    size = Counter(s for s, _ in once.values())
    on = defaultdict(set)
    where = []
    for c, (s, t) in once.items():
        for k, line in enumerate((t or "").split("\n"), 1):
            x = norm(line)
            if t is not None and len(x.replace("#", "")) >= letters:
                on[s, x].add(c)
                where.append((c, k, s, x))
    return {(c, k) for c, k, s, x in where if len(on[s, x]) >= least and len(on[s, x]) >= share * size[s]}


def test_repeated_lines(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunk")
    rows = [tuple(r) for r in chunks.select("chunk_id", "source_id", "text").collect()]
    assert {tuple(r) for r in repeats.repeated_lines(chunks).collect()} == brute_lines(rows, 0.1, 5, 12)
    rng = random.Random(3)
    pool = [f"notice number {k} of the office" for k in range(30)] + [f"Unique line {k:c}" for k in range(97, 120)]
    odd = [(f"c{k}", rng.choice(["hot"] * 6 + ["a", "b", None]), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(400)]
    odd += [("c1", odd[1][1], odd[1][2]), ("n", "hot", None), ("e", "hot", ""), (None, "hot", "x"), ("long", "a", "filler words " * 50_000)]
    df = spark.createDataFrame(odd, "chunk_id string, source_id string, text string").withColumn("digest", F.lit(0)).withColumn("lines", F.lit(0))
    assert {tuple(r) for r in repeats.repeated_lines(df).collect()} == brute_lines(odd, 0.1, 5, 12)
    cleaned = {r.chunk_id: r.text for r in repeats.without_repeats(df).collect()}
    assert cleaned["n"] is None and cleaned["e"] == "" and len(cleaned) == len({c for c, *_ in odd if c})
    assert repeats.repeated_lines(df.limit(0)).count() == 0


def test_summaries_lose_no_heavy_line(spark):
    # Many chunks of many lines: budgets are exceeded and counters pruned, but the share bound holds.
    rng = random.Random(5)
    rows = [(f"c{k}", "s", [rng.randrange(10**6) for _ in range(8)] + ([1] if k % 8 == 0 else []) + ([2] if k % 11 == 0 else [])) for k in range(3000)]
    lines = spark.createDataFrame(rows, "chunk_id string, source_id string, lines array<long>").repartition(3)
    counts = {r.digest: r.n for r in repeats.summaries(lines).groupBy("digest").agg(F.sum("n").alias("n")).collect()}
    assert len(counts) < 24_000
    assert counts.get(1, 0) + counts.get(None, 0) >= 300
    assert {r.digest for r in repeats.repeated(lines).collect()} == {1}
    # A summary that reports more error than the bound leads to an exact count of the whole source.
    real = repeats.summaries
    repeats.summaries = lambda df, share: spark.createDataFrame([("s", None, 3000)], "source_id string, digest long, n long")
    try:
        assert {r.digest for r in repeats.repeated(lines).collect()} == {1}
    finally:
        repeats.summaries = real


def test_languages_of_held_out_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "lang_samples").orderBy("sample_id").collect()
    train, test = rows[::2], rows[1::2]
    detector = language.Detector(language.Model([(r.lang, r.text) for r in train]))
    right = 0
    for r in test:
        s, w, _ = detector.lines([r.text.replace("\n", " ")])
        right += [detector.model.langs[c] for _, c, _ in language.passages(s, w)] == [r.lang]
    assert right >= 0.97 * len(test)


def test_languages_are_those_of_the_sample(spark):
    """A language without a name here counts under its code; a large sample keeps rows of every language."""
    rows = [(k, "en", f"the order number {k:c} is kept by the office for the record") for k in range(97, 1097)] + [(5000 + k, "eo", "la domo estas granda kaj la urbo estas bela") for k in range(20)]
    samples = spark.createDataFrame(rows, "sample_id long, lang string, text string")
    kept = language.labelled_sentences(samples, 100)
    assert len(kept) <= 101 and {c for c, _ in kept} == {"en", "eo"}
    df = spark.createDataFrame([("a", "en", "la urbo estas granda"), ("b", "eo", "la urbo estas granda"), ("c", None, "the office kept the record")], "chunk_id string, lang string, text string")
    assert {tuple(r) for r in language.relabelled(df, samples).collect()} == {("a", 1, "eo"), ("c", 1, "en")}


def test_passages_and_labels(spark, sf_dir):
    samples = table(spark, sf_dir, "lang_samples")
    en, de, hi = (samples.where(f"lang = '{c}'").first().text for c in ("en", "de", "hi"))
    rows = [("a", " EN-in", en), ("b", "fr", en), ("c", None, de), ("d", "en", f"\n{en}\n{en}\n\n12\n{de}\nIS 1234\n{hi}"), ("e", None, None), ("f", "xx", " \n"), ("g", "n/a", "IS 1234\n12"), ("h", "deu", de), ("b", "fr", en)]
    df = spark.createDataFrame(rows, "chunk_id string, lang string, text string").withColumn("confidence", F.lit(1))
    got = {tuple(r) for r in language.relabelled(df, samples).collect()}
    assert {(c, n) for c, n, _ in got if c == "d"} == {("d", 2), ("d", 6), ("d", 8)} and {("b", 1, "en"), ("c", 1, "de")} <= got
    assert {c for c, *_ in got} == {"b", "c", "d"}
    every = language.languages(df, samples).collect()
    assert all(0 < r.confidence <= 1 for r in every)
    assert language.relabelled(df.limit(0), samples).count() == 0
    assert [language.label(x) for x in ("Hindi", "hi_IN", " Eng ", "xx", "", "tam", "Deutsch")] == ["hi", "hi", "en", None, None, "ta", "de"]


def test_no_bin_of_ranks_is_heavy(spark):
    """Whatever share of a source is drawn, its ranks spread over the bins."""
    n = 40_000
    sizes = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (20 + F.col("id") % 300).alias("n_tokens"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeat int")
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    for rate in (1e-5, 1e-3, 0.1, 0.5, 0.999):
        plan = mixing.allocation(sizes, targets, rate * total)
        ranks = mixing.ranked(sizes, plan)
        assert ranks.groupBy("bin").count().agg(F.max("count")).first()[0] <= 0.01 * n
        # Bins are in the order of ranks.
        assert ranks.groupBy("bin").agg(F.min("r").alias("a"), F.max("r").alias("b")).selectExpr("a < lag(b) over (order by bin) as bad").where("bad").isEmpty()


def test_mixing_to_shares(spark):
    text = lambda n: " ".join(["mark"] * n)
    docs = [(k, text(20 + k % 7 * 20), "big") for k in range(3000)] + [(9000 + k, text(30), "mid") for k in range(200)] + [(9900 + k, text(40), "small") for k in range(10)]
    docs += [(9990, None, "small"), (9991, "", "small"), (9992, "mark", None), (9993, "mark", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(7))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 5), ("none", 0.1, 3), ("zero", 0.0, 2)], "source string, target_share double, max_repeat int")
    used, rep = mixing.mixed(df, targets)
    rows = {r.source: r for r in rep.collect()}
    assert abs(rows["big"].actual_share - 0.5 / 0.9) < 0.01 and abs(rows["mid"].actual_share - 0.3 / 0.9) < 0.01 and abs(rows["small"].actual_share - 0.1 / 0.9) < 0.01
    assert rows["none"].tokens_used == rows["zero"].tokens_used == 0 and rows["small"].most_copies == 5
    copies = used.collect()
    assert all(1 <= r.copies <= rows[r.source].max_repeat for r in copies) and len({r.doc_id for r in copies}) == len(copies)
    # Larger documents are likelier, and the draw depends on the seed only.
    big = [len(docs[r.doc_id][1].split()) for r in copies if r.source == "big"]
    assert sum(big) / len(big) > 82
    assert sorted(map(tuple, copies)) == sorted(map(tuple, mixing.mixed(df.repartition(7), targets)[0].collect()))
    short = {r.source: r for r in mixing.mixed(df, targets, total=10_000_000)[1].collect()}
    assert short["small"].tokens_used == 5 * 400 and short["big"].most_copies == 1
    assert mixing.mixed(df.limit(0), targets)[0].count() == 0
