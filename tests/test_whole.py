"""Cases in which queries once did less than the whole job."""

from __future__ import annotations

from collections import defaultdict

from sparkloom import runtime
from sparkloom.plans import base, catalogue, corpus, products, search

QUERIES = catalogue.REGISTRY.queries


def test_ordinals_of_five_digits(spark):
    """All new ids differ, and ids of four and five digits stand in the order of their strings, whatever the ranges."""
    ids = [f"a::{i:04d}" for i in range(10_300)] + ["b::0001"]
    c = spark.createDataFrame([(i, i[0]) for i in ids], "chunk_id string, source_id string")
    of_a = sorted(ids[:-1])
    want = {x: f"a::{k:04d}" for k, x in enumerate(of_a)} | {"b::0001": "b::0000"}
    got = corpus.new_ids(corpus.ordinals(c, 7)).collect()
    assert {r.chunk_id: r.new_id for r in got} == want and len({r.new_id for r in got}) == len(ids)
    beside = {r.chunk_id: (r.previous, r.next) for r in search.beside(c, 7).collect()}
    assert beside == {x: (p, n) for x, p, n in zip(of_a, [None, *of_a], [*of_a[1:], None])} | {"b::0001": (None, None)}


def test_ordered_ids_of_all_sources(spark, sf_dir):
    want = defaultdict(list)
    for r in base.chunks(spark, sf_dir).select("chunk_id", "source_id").collect():
        want[r.source_id].append(r.chunk_id)
    got = defaultdict(list)
    for r in sorted(QUERIES["agg2_ordered_id_blocks"](spark, sf_dir).collect(), key=lambda r: r.block):
        got[r.source_id] += r.ids.split(" ")
    assert "conformity_regulations" in got and got == {s: sorted(x) for s, x in want.items()}


def test_all_parts_and_all_vectors_are_reported(spark, sf_dir):
    part = runtime.table(spark, sf_dir, "part").select("p_partkey").collect()
    assert sorted(QUERIES["str18_headers_of_all_parts"](spark, sf_dir).select("p_partkey").collect()) == sorted(part)
    total = sum(r.n for r in QUERIES["snk4_published_whole"](spark, sf_dir).collect())
    assert total == runtime.table(spark, sf_dir, "embeddings").count()


def test_names_of_any_length_are_found(spark):
    names = ["cast iron pressure cooker with glass lid", "steel switch", "hinge", "\u0915\u0916\u0917\u0918"]
    asks = [(1, "Is a Cast iron pressure cooker with glass lids covered?"), (2, "Which steel switches and hinges?"), (3, "On \u0915\u0916\u0917\u0918 ?"), (4, "cast iron pressure cooker"), (5, "")]
    got = products.named_in(spark.createDataFrame(asks, "id int, question string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == [(1, names[0]), (2, names[2]), (2, names[1]), (3, names[3])]


def test_whole_pages_are_read(spark, sf_dir):
    """Every web chunk with a text, with all its lines, whatever its script or marks."""
    got = {r.url: r.text for r in QUERIES["src6_main_text_of_whole_pages"](spark, sf_dir).collect()}
    pages = {r.chunk_id: r.text for r in base.chunks(spark, sf_dir).where("page is null and text is not null").collect()}
    tidy = lambda t: "\n".join(x for x in (" ".join(line.split()) for line in t.split("\n")) if x)
    assert got == {k: tidy(t) for k, t in pages.items()} and any("<" in t or ">" in t for t in got.values()) and any(not t.isascii() for t in got.values())
