"""Queries that go through files: round trips, tables of pages, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.plans.base import CHUNKS, RESULTS, chunks, results
from sparkloom.plans.registry import Registry
from sparkloom.runtime import checkpoint_dir, cut, table
from sparkloom.sources import files, html
from sparkloom.streaming import jobs

REGISTRY = Registry()
q = REGISTRY.add
#: Postings in a bucket of the index.
POSTINGS = 2_000_000
#: Rows in a file.
FILE_ROWS = 100_000


def folder(spark) -> str:
    """A new folder in the shared place that the session names."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@q("snk1_json_lines", f"WITH {CHUNKS} SELECT chunk_id, title, page, text FROM chunks")
def snk1(spark, d):
    """Chunks written as JSON lines and read back with their schema."""
    path = folder(spark)
    c = chunks(spark, d).select("chunk_id", "title", "page", "text")
    files.write_json_lines(c, path)
    return files.read_json_lines(spark, path, c.schema)


@q("src3_files_below_a_folder", f"WITH {CHUNKS} SELECT coalesce(doc_type, '') AS doc_type, count(*) AS chunks, CAST(sum(length(chunk_id)) AS BIGINT) AS id_chars FROM chunks GROUP BY ALL")
def src3(spark, d):
    """Files of two kinds in folders below one another: those whose name matches are found and read, the others passed over."""
    path = folder(spark)
    c = chunks(spark, d).select(F.coalesce("doc_type", F.lit("")).alias("doc_type"), "chunk_id")
    c.withColumn("kind", F.col("doc_type")).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("kind").json(f"{path}/in/deep")
    c.write.option("maxRecordsPerFile", FILE_ROWS).csv(f"{path}/in/other")
    lines = files.read_files(spark, f"{path}/in", "*.json").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line != ''")
    rows = lines.select(F.from_json("line", "doc_type string, chunk_id string").alias("r")).select("r.*")
    return rows.groupBy("doc_type").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_id")).alias("id_chars"))


@q("snk10_appended_log", f"WITH {RESULTS} SELECT type, count(*) AS refusals, count(DISTINCT provider) AS providers FROM results WHERE refused GROUP BY type")
def snk10(spark, d):
    """A log of refusals, appended to for questions that must be refused and for the others, and read as one."""
    path = folder(spark)
    r = results(spark, d).where("refused").select("id", "type", "provider", F.coalesce("must_refuse", F.lit(False)).alias("must"))
    files.append_log(r.where("must"), path)
    files.append_log(r.where("not must"), path)
    return spark.read.schema(r.schema).parquet(path).groupBy("type").agg(F.count("*").alias("refusals"), F.count_distinct("provider").alias("providers"))


@q("snk2_csv_families", "SELECT 'part' AS family, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, 'p_brand=' || p_brand AS extras FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 's_nationkey=' || CAST(s_nationkey AS VARCHAR) FROM supplier")
def snk2(spark, d):
    """Two CSV folders of differing columns, written and read as one table with a map of what they don't share."""
    path = folder(spark)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), "p_brand")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_nationkey")
    files.write_csv(part, f"{path}/part", ["key", "name"])
    files.write_csv(supplier, f"{path}/supplier", ["key", "name"])
    both = files.read_csv_folders(spark, [f"{path}/supplier", f"{path}/part"], ["key", "name"])
    extras = F.array_join(F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return both.select(F.regexp_extract("origin", "([^/]+)$", 1).alias("family"), "key", "name", extras.alias("extras"))


@q("snk4_published_version", "SELECT label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS total FROM embeddings GROUP BY label")
def snk4(spark, d):
    """Two versions of the whole table published one after the other, the first with other keys; the reader sees the second."""
    root = folder(spark)
    e = table(spark, d, "embeddings").select("vec_id", "label")
    files.publish(e.withColumn("vec_id", F.col("vec_id") + 1), root)
    files.publish(e, root)
    return spark.read.parquet(files.current(spark, root)).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"))


@q("snk4_published_whole", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def snk4_whole(spark, d):
    """An older state published first, then the whole table, then an empty one, which isn't published; the reader sees all rows."""
    root = folder(spark)
    e = table(spark, d, "embeddings")
    for state in (e.where("vec_id % 2 = 0"), e, e.where("false")):
        files.publish(state, root)
    return spark.read.parquet(files.current(spark, root)).groupBy("label").agg(F.count("*").alias("n"))


@q("snk3_bm25_index", f"WITH {CHUNKS}, t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks WHERE text IS NOT NULL) SELECT term, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY ALL) GROUP BY term")
def snk3(spark, d):
    """Postings written partitioned for look-ups by term, and read again; buckets grow in number with the postings."""
    path = folder(spark)
    t = chunks(spark, d).where("text is not null").select("chunk_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    postings = cut(t.groupBy("term", "chunk_id").agg(F.count("*").alias("tf")))
    buckets = max(1, -(-postings.count() // POSTINGS))
    hashed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    # A frequent term's postings are dealt out over files by the chunk, so that no task holds a term.
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(4))
    hashed.repartition(4 * buckets, "bucket", salt).write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


#: What Python's str.split takes for white space within a line.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ROWS = "regexp_extract_all(text, '(?m)^\\| (IS [^|\\n]+ \\| [^|\\n]+ \\| Rs\\. [\\d,]+) \\|$', 1)"


@q(
    "src8_table_grids",
    f"""WITH {CHUNKS}, t AS (SELECT chunk_id, source_id, {_ROWS} AS rows FROM chunks WHERE text IS NOT NULL), k AS (SELECT chunk_id, list_concat(['Source | Standard | Standard | Fee'], [source_id || ' | ' || x FOR x IN rows]) AS rows FROM t WHERE len(rows) > 0),
    r AS (SELECT chunk_id, unnest(range(0, len(rows))) AS r, unnest(rows) AS line FROM k) SELECT chunk_id AS id, CAST(r AS INTEGER) AS row, CAST(unnest(range(0, 4)) AS INTEGER) AS col, unnest(string_split(line, ' | ')) AS cell FROM r""",
)
def src8(spark, d):
    """The tables of web pages as HTML, with a heading over two columns and the source over all rows, expanded to grids."""
    c = chunks(spark, d).where("text is not null")
    rows = F.regexp_extract_all("text", F.lit(r"(?m)^\| (IS [^|\n]+ \| [^|\n]+ \| Rs\. [\d,]+) \|$"), F.lit(1))
    source = F.concat(F.lit("<td rowspan="), F.size(rows).cast("string"), F.lit(">"), "source_id", F.lit("</td>"))
    row = lambda r, k: F.concat(F.lit("<tr>"), F.when(k == 0, source).otherwise(""), F.lit("<td>"), F.replace(r, F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr>"))
    page = F.concat(F.lit("<table><tr><th>Source</th><th colspan=2>Standard</th><th>Fee</th></tr>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))
    t = c.select("chunk_id", rows.alias("rows"), page.alias("html")).where("size(rows) > 0")
    return html.cells(t, "chunk_id", "html").select("id", "row", "col", "cell")


@q(
    "src9_scraped_records",
    f"""WITH {CHUNKS}, t AS (SELECT chunk_id, source_id, {_ROWS} AS rows FROM chunks WHERE text IS NOT NULL), r AS (SELECT chunk_id, source_id, unnest(range(0, len(rows))) AS k, string_split(unnest(rows), ' | ') AS c FROM t),
    f AS (SELECT chunk_id, source_id, c[1] AS is_number, c[2] AS product, c[3] AS fee, k, row_number() OVER (PARTITION BY chunk_id, c[1], c[2] ORDER BY k) AS n FROM r)
    SELECT chunk_id, source_id AS category, is_number, product, fee, 'https://x.example/f/' || k || '.pdf' AS links FROM f WHERE n = 1""",
)
def src9(spark, d):
    """Pages with the chunk's table twice, a group's heading and a footnote over all columns, and a link in each row: the records come out once."""
    c = chunks(spark, d).where("text is not null")
    rows = F.regexp_extract_all("text", F.lit(r"(?m)^\| (IS [^|\n]+ \| [^|\n]+ \| Rs\. [\d,]+) \|$"), F.lit(1))
    row = lambda r, k: F.concat(F.lit("<tr><td>"), F.replace(r, F.lit(" | "), F.lit("</td><td>")), F.lit("<a href='/f/"), k.cast("string"), F.lit(".pdf'></a></td></tr>"))
    one = F.concat(F.lit("<table><tr><th>IS No.</th><th>Product</th><th>Fee</th></tr><tr><td colspan=3>"), "source_id", F.lit("</td></tr><tr><td colspan=3>* as revised</td></tr>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))
    t = c.select(F.concat(F.lit("https://x.example/"), "chunk_id").alias("url"), rows.alias("rows"), F.concat(one, one).alias("html")).where("size(rows) > 0")
    r = html.scraped(t, "url", "html")
    return r.select(F.replace("url", F.lit("https://x.example/"), F.lit("")).alias("chunk_id"), "category", *(F.col("fields")[c].alias(c) for c in ("is_number", "product", "fee")), F.array_join("links", " ").alias("links"))


@q(
    "src7_page_markdown",
    f"WITH {CHUNKS}, l AS (SELECT chunk_id, [trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ') FOR x IN string_split(text, chr(10))] AS lines FROM chunks WHERE page IS NULL AND text IS NOT NULL) SELECT chunk_id, '# Page' || chr(10) || chr(10) || array_to_string(list_concat([x FOR x IN lines IF x <> ''], ['[' || chunk_id || '](https://x.example/f.pdf)']), chr(10) || chr(10)) AS markdown FROM l",
)
def src7(spark, d):
    """Pages of the whole texts of web chunks with a menu, a breadcrumb list and a footer, as markdown with absolute links."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<h1>Page</h1><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p><p><a href='/f.pdf'>"), "chunk_id", F.lit("</a></p>"))
    page = F.concat(F.lit("<html><body><nav><a href='/x'>Menu of this site</a></nav><ul><li>Home</li><li>/</li><li>Page</li></ul><div>"), body, F.lit("</div><footer>All rights reserved.</footer></body></html>"))
    c = chunks(spark, d).where("page is null and text is not null").select("chunk_id", F.concat(F.lit("https://x.example/p/"), "chunk_id").alias("url"), page.alias("html"))
    return html.markdown(c, "url", "html").select(F.replace("url", F.lit("https://x.example/p/"), F.lit("")).alias("chunk_id"), "markdown")


@q(
    "src10_links_of_the_section",
    "WITH u AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM download WHERE regexp_full_match(url, 'https?://[a-z.]+(/[A-Za-z0-9._-]+)+/?([?#].*)?')), f AS (SELECT url, regexp_replace(regexp_replace(url, '/+$', ''), '[^/]*$', '') AS folder FROM u) SELECT url, folder || 'beside/ ' || folder || 'other' AS links FROM f",
)
def src10(spark, d):
    """Of each page's links those to pages beside it: not deeper ones, other folders, files, other hosts, the page itself, or repeats."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    u = table(spark, d, "download").where(F.col("url").rlike(r"^https?://[a-z.]+(/[A-Za-z0-9._-]+)+/?([?#].*)?$")).select(url.alias("url")).distinct()
    folder = F.regexp_replace(F.regexp_replace("url", "/+$", ""), "[^/]*$", "")
    link = lambda *p: F.concat(F.lit("<a href='"), *p, F.lit("'>x</a>"))
    page = F.concat(link(folder, F.lit("beside/?lang=en")), link(folder, F.lit("beside/deeper/")), link(folder, F.lit("other#part")), link(folder), link(F.col("url")), link(folder, F.lit("doc.PDF")), link(F.lit("https://elsewhere.example/other")), link(folder, F.lit("other")), link(F.lit("mailto:a@b.example")))
    return html.pages(u.select("url", page.alias("html")), "url", "html").select("url", F.array_join("links", " ").alias("links"))


@q(
    "src6_main_text_of_pages",
    f"WITH {CHUNKS}, l AS (SELECT chunk_id, array_to_string([x FOR x IN [trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ') FOR x IN string_split(text, chr(10))] IF x <> ''], chr(10)) AS t FROM chunks WHERE page IS NULL AND text IS NOT NULL) SELECT chunk_id AS url, CASE WHEN length(t) > 50 THEN t WHEN t = '' THEN 'Loading' ELSE 'Loading' || chr(10) || t END AS text FROM l",
)
def src6(spark, d):
    """Pages of the whole texts whose main element says too little: the article is taken, and the body where that says too little too."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    page = F.concat(F.lit("<html><body><nav><a href='/x'>Menu of this site</a></nav><main><p>Loading</p></main><article>"), body, F.lit("</article><footer>All rights reserved by the site, as always.</footer></body></html>"))
    c = chunks(spark, d).where("page is null and text is not null")
    return html.pages(c.select("chunk_id", page.alias("html")), "chunk_id", "html").select("url", "text")


@q(
    "src6_main_text_of_whole_pages",
    f"WITH {CHUNKS}, l AS (SELECT chunk_id, [trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ') FOR x IN string_split(text, chr(10))] AS lines FROM chunks WHERE page IS NULL AND text IS NOT NULL) SELECT chunk_id AS url, array_to_string([x FOR x IN lines IF x <> ''], chr(10)) AS text FROM l",
)
def src6_whole(spark, d):
    """Pages of the whole texts of web chunks, a paragraph for each line, in all scripts and with marks escaped, read again."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    page = F.concat(F.lit("<html><body><nav><a href='/x'>Menu of this site</a></nav><main>"), body, F.lit("</main><footer>All rights reserved by the site, as always.</footer></body></html>"))
    c = chunks(spark, d).where("page is null and text is not null")
    return html.pages(c.select("chunk_id", page.alias("html")), "chunk_id", "html").select("url", "text")


@q(
    "stream_windowed_counts",
    """WITH e AS (SELECT to_timestamp(floor(epoch(ts) / 600) * 600) AS w, event_type, value FROM events WHERE ts IS NOT NULL), m AS (SELECT epoch(max(ts)) - 600 AS mark FROM events)
    SELECT strftime(w AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, m WHERE epoch(w) + 600 <= floor(mark * 1000) / 1000 GROUP BY ALL""",
)
def stream_windows(spark, d):
    """Counts per ten minutes as a stream emits them: only windows closed when the stream ends."""
    path = folder(spark)
    counts = jobs.windowed_counts(jobs.stream(spark, f"{d}/events.parquet"), "ts", "event_type")
    done = jobs.run_to_end(counts, f"{path}/out", f"{path}/state")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@q("stream_numbered_events", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events WHERE user_id IS NOT NULL")
def stream_numbered(spark, d):
    path = folder(spark)
    events = jobs.stream(spark, f"{d}/events.parquet").where("user_id is not null").select("user_id", "event_id")
    return jobs.run_to_end(jobs.numbered(events, "user_id", ["event_id"], "user_id long, event_id long"), f"{path}/out", f"{path}/state")
