"""Corpus preparation and its reports: filters, labels, joins between chunks, documents and downloads, counts, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import segments
from sparkloom.plans.base import CHUNKS, chunks, in_ranges
from sparkloom.plans.registry import Registry
from sparkloom.runtime import broadcast_if_small, cut, table

REGISTRY = Registry()
q = REGISTRY.add
#: Ids in one list.
LIST = 256


@q("src1_chunk_scan", f"WITH {CHUNKS} SELECT chunk_id, source_id, title, page, CAST(length(text) AS BIGINT) AS n_chars FROM chunks")
def src1(spark, d):
    return chunks(spark, d).select("chunk_id", "source_id", "title", "page", F.length("text").cast("long").alias("n_chars"))


@q(
    "src11_saved_page_headers",
    f"""WITH {CHUNKS}, p AS (SELECT chunk_id, 'Source: ' || url || chr(10) || 'Downloaded: ' || date_downloaded || chr(10) || '---' || chr(10) || text AS saved FROM chunks WHERE text IS NOT NULL AND url IS NOT NULL AND page IS NULL)
    SELECT chunk_id, regexp_extract(saved, 'Source: (\\S+)', 1) AS source, regexp_extract(saved, 'Downloaded: (\\S+)', 1) AS downloaded, CAST(length(substr(saved, instr(saved, chr(10) || '---' || chr(10)) + 5)) AS BIGINT) AS body_chars FROM p""",
)
def src11(spark, d):
    """A saved page has two header lines, a rule and its body; the pages are put together from the chunks and read again."""
    c = chunks(spark, d).where("text is not null and url is not null and page is null")
    saved = F.concat(F.lit("Source: "), "url", F.lit("\nDownloaded: "), "date_downloaded", F.lit("\n---\n"), "text")
    s = c.select("chunk_id", saved.alias("saved"))
    body = F.expr("substring(saved, instr(saved, '\\n---\\n') + 5)")
    return s.select("chunk_id", F.regexp_extract("saved", r"Source: (\S+)", 1).alias("source"), F.regexp_extract("saved", r"Downloaded: (\S+)", 1).alias("downloaded"), F.length(body).cast("long").alias("body_chars"))


@q("src13_latest_downloads", "SELECT path, arg_max(date, (date, bytes, url, id)) AS date, arg_max(bytes, (date, bytes, url, id)) AS bytes FROM download WHERE status = 'downloaded' AND path IS NOT NULL AND date IS NOT NULL AND bytes IS NOT NULL GROUP BY path")
def src13(spark, d):
    t = table(spark, d, "download").where("status = 'downloaded' and path is not null and date is not null and bytes is not null")
    return t.groupBy("path").agg(F.max(F.struct("date", "bytes", "url", "id")).alias("m")).select("path", "m.date", "m.bytes")


@q("src12_selected_sources", "SELECT DISTINCT source_id, title, agent FROM parsed WHERE agent = 'law' OR source_id IN ('bureau_act', 'licence_guide')")
def src12(spark, d):
    return table(spark, d, "parsed").where("agent = 'law' or source_id in ('bureau_act', 'licence_guide')").select("source_id", "title", "agent").distinct()


@q("snk6_download_attempts", "SELECT id, count(*) AS attempts, count(DISTINCT url) AS urls, count(sha256) AS with_checksum, max(date) AS last FROM download GROUP BY id")
def snk6(spark, d):
    return table(spark, d, "download").groupBy("id").agg(F.count("*").alias("attempts"), F.count_distinct("url").alias("urls"), F.count("sha256").alias("with_checksum"), F.max("date").alias("last"))


@q("fil5_vocabulary_corpus", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE NOT contains(chunk_id, '::row') AND coalesce(lang, '') <> 'hi' AND NOT starts_with(source_id, 'qco_')")
def fil5(spark, d):
    return chunks(spark, d).where("not contains(chunk_id, '::row') and coalesce(lang, '') != 'hi' and not startswith(source_id, 'qco_')").select("chunk_id")


@q("fil6_enough_letters", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[A-Za-zऀ-ॿ]')) >= 40")
def fil6(spark, d):
    return chunks(spark, d).where(F.regexp_count("text", F.lit("[A-Za-zऀ-ॿ]")) >= 40).select("chunk_id")


@q("fil7_latin_lines", f"WITH {CHUNKS}, l AS (SELECT chunk_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE length(text) > 20) SELECT chunk_id, line_no, line FROM l WHERE len(regexp_extract_all(line, '[ऀ-ॿ]')) <= len(regexp_extract_all(line, '[A-Za-z]'))")
def fil7(spark, d):
    lines = chunks(spark, d).where("length(text) > 20").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.where(F.regexp_count("line", F.lit("[ऀ-ॿ]")) <= F.regexp_count("line", F.lit("[A-Za-z]"))).select("chunk_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@q(
    "src5_pages_of_documents",
    f"""WITH {CHUNKS}, o AS (SELECT DISTINCT source_id, unnest(ocr_pages) AS page FROM parsed), p AS (SELECT source_id, page, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM chunks WHERE page IS NOT NULL AND text IS NOT NULL GROUP BY source_id, page),
    w AS (SELECT source_id, page, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS l FROM p),
    g AS (SELECT source_id, page, text, len([x FOR x IN l IF regexp_matches(x, '[ऀ-ॿ]')]) AS words, len([x FOR x IN l IF regexp_matches(x, '^[ा-्]')]) AS signs FROM w),
    k AS (SELECT source_id, page, words >= 20 AND signs > 0.05 * words AS garbled, array_to_string([x FOR x IN string_split(text, chr(10)) IF len(regexp_extract_all(x, '[ऀ-ॿ]')) <= len(regexp_extract_all(x, '[A-Za-z]'))], chr(10)) AS latin FROM g)
    SELECT k.source_id, count(*) AS pages, count(*) FILTER (o.page IS NOT NULL) AS scanned, count(*) FILTER (garbled) AS garbled, count(*) FILTER (length(trim(latin)) < 20) AS short, CAST(sum(CASE WHEN length(trim(latin)) >= 20 THEN length(latin) ELSE 0 END) AS BIGINT) AS kept_chars
    FROM k LEFT JOIN o ON k.source_id = o.source_id AND k.page = o.page GROUP BY k.source_id""",
)
def src5(spark, d):
    """The pages of each document: how many are scanned, garbled or too short once only their Latin lines are kept, and what is kept.

    A page's chunks are put together by (source, page), a bounded group.
    """
    c = chunks(spark, d).where("page is not null and text is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n")
    p = c.groupBy("source_id", "page").agg(text.alias("text"))
    words, signs = T.words_with_vowel_signs(F.col("text"))
    latin = F.array_join(F.filter(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit("[ऀ-ॿ]")) <= F.regexp_count(x, F.lit("[A-Za-z]"))), "\n")
    k = p.select("source_id", "page", ((words >= 20) & (signs > 0.05 * words)).alias("garbled"), latin.alias("latin"))
    o = table(spark, d, "parsed").select("source_id", F.explode("ocr_pages").alias("page"), F.lit(True).alias("ocr")).distinct()
    long = F.length(F.trim("latin")) >= 20
    return k.join(o, ["source_id", "page"], "left").groupBy("source_id").agg(
        F.count("*").alias("pages"), F.count("ocr").alias("scanned"), F.count_if("garbled").alias("garbled"), F.count_if(~long).alias("short"), F.sum(F.when(long, F.length("latin")).otherwise(0)).alias("kept_chars")
    )


@q("fil8_sampling_pool", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE length(text) >= 400 AND len(regexp_extract_all(text, '[A-Za-z]')) > 250")
def fil8(spark, d):
    return chunks(spark, d).where((F.length("text") >= 400) & (F.regexp_count("text", F.lit("[A-Za-z]")) > 250)).select("chunk_id")


# The document types as an ordered ladder; the first that holds names the type.
DOC_TYPES = [
    ("starts_with(source_id, 'qco_') OR contains(t, 'quality control')", "qco"),
    ("contains(t, 'faq')", "faq"),
    ("contains(t, 'guideline') OR contains(t, 'guidance')", "guideline"),
    ("ends_with(path, '.md')", "page"),
    ("contains(t, 'regulation') OR contains(source_id, '_regs')", "regulation"),
    ("contains(t, 'rules')", "rule"),
    ("regexp_matches(t, '\\bact\\b')", "act"),
    ("contains(t, 'order') OR contains(t, 's.o.') OR contains(t, 'notification')", "order"),
]
_LADDER = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in DOC_TYPES) + " ELSE 'guideline' END"


@q("fil9_document_types", f"SELECT DISTINCT source_id, {_LADDER} AS doc_type FROM (SELECT source_id, path, lower(replace(source_id, '_', ' ') || ' ' || title) AS t FROM parsed)")
def fil9(spark, d):
    t = table(spark, d, "parsed").select("source_id", "path", F.lower(F.concat_ws(" ", F.replace(F.col("source_id"), F.lit("_"), F.lit(" ")), "title")).alias("t"))
    ladder = None
    for cond, value in DOC_TYPES:
        # Spark's string literals take one backslash more.
        sql = F.expr(cond.replace("starts_with", "startswith").replace("ends_with", "endswith").replace("regexp_matches", "regexp_like").replace("\\b", "\\\\b"))
        ladder = F.when(sql, value) if ladder is None else ladder.when(sql, value)
    return t.select("source_id", ladder.otherwise("guideline").alias("doc_type")).distinct()


@q("fil14_link_kinds", "SELECT DISTINCT url, CASE WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' WHEN contains(url, '/tables/') THEN 'table' ELSE 'page' END AS kind FROM download WHERE url IS NOT NULL")
def fil14(spark, d):
    kind = F.when(F.lower("url").rlike(r"\.pdf($|[?#])"), "pdf").when(F.contains("url", F.lit("/tables/")), "table").otherwise("page")
    return table(spark, d, "download").where("url is not null").select("url", kind.alias("kind")).distinct()


@q("fil24_note_names", f"WITH {CHUNKS} SELECT chunk_id, replace(chunk_id, '::', '__') AS note, CASE scheme WHEN 'I' THEN '#scheme-I' WHEN 'II' THEN '#scheme-II' WHEN 'FMCS' THEN '#fmcs' ELSE '' END AS tag FROM chunks")
def fil24(spark, d):
    tag = F.when(F.col("scheme") == "I", "#scheme-I").when(F.col("scheme") == "II", "#scheme-II").when(F.col("scheme") == "FMCS", "#fmcs").otherwise("")
    return chunks(spark, d).select("chunk_id", F.replace("chunk_id", F.lit("::"), F.lit("__")).alias("note"), tag.alias("tag"))


@q("joi10_chunks_with_documents", f"WITH {CHUNKS}, p AS (SELECT source_id, max(path) AS path FROM parsed GROUP BY source_id) SELECT chunk_id, coalesce(path, '') AS path FROM chunks LEFT JOIN p USING (source_id)")
def joi10(spark, d):
    p = cut(table(spark, d, "parsed").groupBy("source_id").agg(F.max("path").alias("path")))
    return chunks(spark, d).join(broadcast_if_small(p), "source_id", "left").select("chunk_id", F.coalesce("path", F.lit("")).alias("path"))


@q("joi15_documents_without_chunks", "SELECT DISTINCT source_id FROM parsed WHERE source_id NOT IN (SELECT source_id FROM chunk WHERE source_id IS NOT NULL) UNION ALL SELECT DISTINCT id FROM download WHERE id IS NOT NULL AND id NOT IN (SELECT source_id FROM parsed)")
def joi15(spark, d):
    p = table(spark, d, "parsed").select("source_id").distinct()
    of = table(spark, d, "chunk").select("source_id").distinct()
    asked = table(spark, d, "download").where("id is not null").select(F.col("id").alias("source_id")).distinct()
    return p.join(of, "source_id", "left_anti").unionByName(asked.join(p, "source_id", "left_anti"))


@q("joi16_pages_with_a_download", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE url IN (SELECT url FROM download WHERE status = 'downloaded')")
def joi16(spark, d):
    got = cut(table(spark, d, "download").where("status = 'downloaded'").select("url").distinct())
    return chunks(spark, d).join(broadcast_if_small(got), "url", "left_semi").select("chunk_id")


@q(
    "joi17_cached_digests",
    f"""WITH {CHUNKS}, known AS (SELECT DISTINCT sha256('m:' || text) AS key FROM chunks WHERE source_id = 'conformity_regulations' AND text IS NOT NULL)
    SELECT chunk_id, key IS NOT NULL AS cached FROM chunks LEFT JOIN known ON sha256('m:' || text) = key WHERE text IS NOT NULL""",
)
def joi17(spark, d):
    """Which texts an embedding cache keyed by a digest of model and text would already hold."""
    c = chunks(spark, d).where("text is not null").select("chunk_id", "source_id", F.sha2(F.concat(F.lit("m:"), "text"), 256).alias("key"))
    known = c.where("source_id = 'conformity_regulations'").select("key").distinct().withColumn("cached", F.lit(True))
    return c.join(known, "key", "left").select("chunk_id", F.coalesce("cached", F.lit(False)).alias("cached"))


@q(
    "joi17_cached_lines",
    f"""WITH {CHUNKS}, known AS (SELECT DISTINCT sha256('m:' || line) AS key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE length(line) >= 20),
    l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, count(*) AS lines, count(key) AS cached FROM l LEFT JOIN known ON sha256('m:' || line) = key WHERE length(line) >= 20 GROUP BY chunk_id""",
)
def joi17_lines(spark, d):
    """How many of each chunk's lines a cache filled from the documents' lines, keyed by a digest of model and text, would already hold."""
    lines = lambda t, *keep: t.where("text is not null").select(*keep, F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 20").select(*keep, F.sha2(F.concat(F.lit("m:"), "line"), 256).alias("key"))
    known = lines(table(spark, d, "documents")).distinct().withColumn("hit", F.lit(1))
    asked = lines(chunks(spark, d), "chunk_id")
    return asked.join(known, "key", "left").groupBy("chunk_id").agg(F.count("*").alias("lines"), F.count("hit").alias("cached"))


@q("joi19_source_page_counts", f"WITH {CHUNKS}, n AS (SELECT source_id, count(*) AS chunks, count(DISTINCT page) AS pages FROM chunks GROUP BY source_id), p AS (SELECT source_id, max(title) AS title FROM parsed GROUP BY source_id) SELECT source_id, title, coalesce(chunks, 0) AS chunks, coalesce(pages, 0) AS pages FROM p LEFT JOIN n USING (source_id)")
def joi19(spark, d):
    n = chunks(spark, d).groupBy("source_id").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"))
    p = table(spark, d, "parsed").groupBy("source_id").agg(F.max("title").alias("title"))
    return p.join(n, "source_id", "left").na.fill(0, ["chunks", "pages"])


@q("joi9_prefix_schemes", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN starts_with(source_id, 'guide_') THEN 'I' WHEN starts_with(source_id, 'fmcs_') THEN 'FMCS' WHEN starts_with(source_id, 'hm_') THEN 'Hallmarking' WHEN starts_with(source_id, 'scheme1_products_table') THEN 'I' WHEN starts_with(source_id, 'cert_') THEN 'I' ELSE 'general' END AS scheme FROM chunks")
def joi9(spark, d):
    """The first matching prefix names the scheme."""
    starts = F.col("source_id").startswith
    scheme = F.when(starts("guide_"), "I").when(starts("fmcs_"), "FMCS").when(starts("hm_"), "Hallmarking").when(starts("scheme1_products_table"), "I").when(starts("cert_"), "I").otherwise("general")
    return chunks(spark, d).select("chunk_id", scheme.alias("scheme"))


@q("agg2_ordered_ids", f"WITH {CHUNKS} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1 AS ordinal, chunk_id FROM chunks")
def agg2(spark, d):
    """Every source's ids in order, the largest source's too, as rows: no source is gathered."""
    return ordinals(chunks(spark, d).select("chunk_id", "source_id")).select("source_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id")


@q("agg3_counts_by_type", f"WITH {CHUNKS} SELECT doc_type, scheme, count(*) AS n FROM chunks GROUP BY doc_type, scheme")
def agg3(spark, d):
    return chunks(spark, d).groupBy("doc_type", "scheme").agg(F.count("*").alias("n"))


@q("agg4_size_statistics", f"WITH {CHUNKS} SELECT doc_type, CAST(min(length(text)) AS BIGINT) AS least, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean, CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS BIGINT) AS upper_median, CAST(max(length(text)) AS BIGINT) AS most FROM chunks WHERE text IS NOT NULL GROUP BY doc_type")
def agg4(spark, d):
    """The upper median is the exact value of rank n div 2 + 1, found from counts per length, not by sorting a group's rows."""
    c = chunks(spark, d).where("text is not null").groupBy("doc_type", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("doc_type").orderBy("n")
    ranked = c.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy("doc_type")))
    median = F.min(F.when(F.col("upto") >= F.expr("total div 2 + 1"), F.col("n")))
    return ranked.groupBy("doc_type").agg(F.min("n").alias("least"), F.floor(F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), median.alias("upper_median"), F.max("n").alias("most"))


@q(
    "agg8_repeated_page_lines",
    f"""WITH {CHUNKS}, l AS (SELECT source_id, chunk_id, [s FOR s IN [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))] IF s <> ''] AS lines FROM chunks WHERE page IS NOT NULL AND text IS NOT NULL),
    e AS (SELECT DISTINCT source_id, chunk_id, regexp_replace(unnest(list_concat(lines[1:3], lines[-3:])), '\\d+', '#', 'g') AS line FROM l),
    n AS (SELECT source_id, count(*) AS pages FROM l GROUP BY source_id) SELECT source_id, line, count(*) AS n FROM e JOIN n USING (source_id) WHERE length(line) < 150 AND pages >= 3 GROUP BY source_id, line, pages HAVING count(*) >= greatest(3, 0.5 * pages)""",
)
def agg8(spark, d):
    """Running heads and feet: lines among a page's first and last three that stand on half of a document's pages."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    pages = chunks(spark, d).where("page is not null and text is not null").select("source_id", "chunk_id", lines.alias("lines"))
    edge = F.concat(F.slice("lines", 1, 3), F.expr("slice(lines, greatest(size(lines) - 2, 1), 3)"))
    marked = pages.select("source_id", F.explode(F.array_distinct(F.transform(edge, lambda s: F.regexp_replace(s, r"\d+", "#")))).alias("line")).where("length(line) < 150")
    total = pages.groupBy("source_id").agg(F.count("*").alias("pages"))
    counted = marked.groupBy("source_id", "line").agg(F.count("*").alias("n"))
    return counted.join(broadcast_if_small(total), "source_id").where("pages >= 3 and n >= greatest(3, 0.5 * pages)").select("source_id", "line", "n")


@q("agg10_distinct_counts", f"WITH {CHUNKS} SELECT agent, count(DISTINCT source_id) AS sources, count(DISTINCT section) AS sections FROM chunks GROUP BY agent")
def agg10(spark, d):
    return chunks(spark, d).groupBy("agent").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("section").alias("sections"))


@q("agg13_conditional_counts", "SELECT status, count(*) AS n, count(*) FILTER (WHERE path IS NULL) AS without_path, count(*) FILTER (WHERE sha256 IS NULL OR sha256 = '') AS without_checksum FROM download GROUP BY status")
def agg13(spark, d):
    count_if = lambda s: F.count_if(F.expr(s))
    return table(spark, d, "download").groupBy("status").agg(F.count("*").alias("n"), count_if("path is null").alias("without_path"), count_if("sha256 is null or sha256 = ''").alias("without_checksum"))


@q("agg20_section_counts", f"WITH {CHUNKS} SELECT source_id, string_split(section, ' ')[1] AS head, count(*) AS n, count(DISTINCT title) AS titles FROM chunks WHERE section IS NOT NULL GROUP BY ALL")
def agg20(spark, d):
    return chunks(spark, d).where("section is not null").groupBy("source_id", F.split("section", " ")[0].alias("head")).agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


@q("agg21_unique_slugs", "WITH u AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '([^/]+?)(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1)), '[^a-z0-9]+', '_', 'g') AS slug FROM download WHERE url IS NOT NULL), n AS (SELECT slug, count(*) AS n FROM u GROUP BY slug) SELECT url, CASE WHEN n = 1 THEN slug ELSE slug || '_' || substr(md5(url), 1, 6) END AS slug FROM u JOIN n USING (slug)")
def agg21(spark, d):
    """Slugs that collide take a short digest; counted by slug, then joined back."""
    u = table(spark, d, "download").where("url is not null").select("url").distinct()
    u = u.withColumn("slug", F.regexp_replace(F.lower(F.regexp_extract("url", r"([^/]+?)(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)), "[^a-z0-9]+", "_"))
    n = u.groupBy("slug").agg(F.count("*").alias("n"))
    return u.join(n, "slug").select("url", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), F.substring(F.md5("url"), 1, 6))).alias("slug"))


@q("agg22_standards_of_a_source", f"WITH {CHUNKS}, t AS (SELECT source_id, unnest(regexp_extract_all(text, 'IS (\\d{{1,5}})', 1)) AS no FROM chunks WHERE text IS NOT NULL) SELECT source_id, count(DISTINCT no) AS standards, bool_or(no = '65018') AS names_65018 FROM t GROUP BY source_id")
def agg22(spark, d):
    """Whole-number containment in a source's text: the numbers are taken out, so that no source's text is put together."""
    t = chunks(spark, d).where("text is not null").select("source_id", F.explode(F.regexp_extract_all("text", F.lit(r"IS (\d{1,5})"), F.lit(1))).alias("no"))
    return t.groupBy("source_id").agg(F.count_distinct("no").alias("standards"), F.bool_or(F.col("no") == "65018").alias("names_65018"))


def ordinals(c: DataFrame, parts: int | None = None) -> DataFrame:
    """``ordinal`` of each chunk in its source by chunk id, counted in ranges of the ids, then over the ranges."""
    b = in_ranges(c, parts)
    inside = Window.partitionBy("source_id", "block").orderBy("chunk_id")
    n = b.groupBy("source_id", "block").agg(F.count("*").alias("n"))
    before = n.select("source_id", "block", F.coalesce(F.sum("n").over(Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return b.withColumn("k", F.row_number().over(inside)).join(before, ["source_id", "block"]).withColumn("ordinal", F.col("before") + F.col("k") - 1).drop("k", "before", "block")


def new_ids(c: DataFrame) -> DataFrame:
    number = F.col("ordinal").cast("string")
    return c.select("chunk_id", F.concat("source_id", F.lit("::"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("new_id"))


@q("win2_ordinal_ids", f"WITH {CHUNKS} SELECT chunk_id, source_id || '::' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1 AS VARCHAR), 4, '0') AS new_id FROM chunks")
def win2(spark, d):
    """Four digits at least; larger ordinals keep all of theirs, where the lpad of the SQL cuts them."""
    return new_ids(ordinals(chunks(spark, d).select("chunk_id", "source_id")))


@q("agg2_ordered_id_blocks", f"WITH {CHUNKS}, r AS (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1 AS ordinal FROM chunks) SELECT source_id, CAST(ordinal // {LIST} AS BIGINT) AS block, string_agg(chunk_id, ' ' ORDER BY chunk_id) AS ids FROM r GROUP BY ALL")
def agg2_blocks(spark, d):
    """All sources' ids in order, the largest source's too: one list for each ``LIST`` ordinals, so that no source is gathered."""
    c = ordinals(chunks(spark, d).select("chunk_id", "source_id")).withColumn("block", F.expr(f"ordinal div {LIST}"))
    return c.groupBy("source_id", "block").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), " ").alias("ids"))


@q("win11_first_middle_last", f"WITH {CHUNKS}, r AS (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM chunks) SELECT source_id, chunk_id, k FROM r WHERE k IN (1, n // 2 + 1, n)")
def win11(spark, d):
    c = ordinals(chunks(spark, d).select("chunk_id", "source_id")).withColumn("k", F.col("ordinal") + 1)
    n = c.groupBy("source_id").agg(F.count("*").alias("n"))
    return c.join(n, "source_id").where("k in (1, n div 2 + 1, n)").select("source_id", "chunk_id", F.col("k").cast("long").alias("k"))


@q(
    "win3_headings_carried_forward",
    f"""WITH {CHUNKS}, l AS (SELECT chunk_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL),
    h AS (SELECT *, CASE WHEN regexp_matches(line, '^(#+ |CHAPTER |SCHEDULE-|\\d+\\. [A-Z])') THEN line END AS head FROM l)
    SELECT chunk_id, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY line_no) AS heading, CAST(sum(CASE WHEN head IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY line_no) AS BIGINT) AS segment FROM h""",
)
def win3(spark, d):
    """One level of headings over the lines of each chunk; the full three-level form is ``win3_segments``."""
    lines = chunks(spark, d).where("text is not null").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    head = F.when(F.col("line").rlike(r"^(#+ |CHAPTER |SCHEDULE-|\d+\. [A-Z])"), F.col("line"))
    w = Window.partitionBy("chunk_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    h = lines.withColumn("head", head)
    return h.select("chunk_id", (F.col("p") + 1).cast("long").alias("line_no"), F.last("head", ignorenulls=True).over(w).alias("heading"), F.sum(F.when(F.col("head").isNull(), 0).otherwise(1)).over(w).alias("segment"))


_OUTLINE = r"""lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    items AS (SELECT *, regexp_matches(line, '^\s*(\d+[A-Z]?)\.\s+(\S.*)$') AS item, regexp_extract(line, '^\s*(\d+[A-Z]?)\.\s+(\S.*)$', 1) AS no, trim(regexp_extract(line, '^\s*(\d+[A-Z]?)\.\s+(\S.*)$', 2)) AS w FROM lines),
    titled AS (SELECT *, regexp_extract(w, '^(.{3,120}?)(?:\.\s|\.$|\s[–—-]\s|:-)', 1) AS short FROM items),
    named AS (SELECT *, CASE WHEN NOT item OR NOT regexp_matches(w, '^[A-Z("''\x{0900}-\x{097F}]') THEN NULL WHEN ends_with(w, '?') AND length(w) < 200 THEN no || '. ' || w WHEN starts_with(w, '(') THEN no || '.'
      WHEN short <> '' THEN no || '. ' || trim(short) WHEN ends_with(w, ':') THEN NULL WHEN length(w) > 120 OR regexp_matches(w, '[,;—-]$') THEN no || '.' ELSE no || '. ' || w END AS title FROM titled),
    heads AS (SELECT doc_id, p, line, CASE WHEN regexp_matches(line, '^\s*(CHAPTER|SCHEDULE|ANNEX|FORM|PART)\b.{0,120}$') THEN 0 WHEN regexp_matches(line, '(?i)^\s*scheme\s*-\s*([ivx]+)\b.{0,60}$') THEN 1
      WHEN regexp_matches(line, '^#{1,6}\s+(.*\S)\s*$') OR title IS NOT NULL THEN 2 END AS level,
      CASE WHEN regexp_matches(line, '^\s*(CHAPTER|SCHEDULE|ANNEX|FORM|PART)\b.{0,120}$') THEN left(trim(regexp_replace(line, '\s+', ' ', 'g')), 80)
      WHEN regexp_matches(line, '(?i)^\s*scheme\s*-\s*([ivx]+)\b.{0,60}$') THEN 'Scheme-' || upper(regexp_extract(line, '(?i)^\s*scheme\s*-\s*([ivx]+)\b.{0,60}$', 1))
      WHEN regexp_matches(line, '^#{1,6}\s+(.*\S)\s*$') THEN left(regexp_extract(line, '^#{1,6}\s+(.*\S)\s*$', 1), 150) ELSE left(title, 150) END AS title FROM named),
    counted AS (SELECT *, count(level) OVER d AS seg, count(CASE WHEN level = 0 THEN 1 END) OVER d AS c0, count(CASE WHEN level <= 1 THEN 1 END) OVER d AS c1 FROM heads WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    carried AS (SELECT *, last_value(CASE WHEN level = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS t0, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, c0 ORDER BY p) AS t1,
      last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, c1 ORDER BY p) AS t2 FROM counted),
    grouped AS (SELECT doc_id, seg, left(concat_ws(' > ', nullif(min(t0), ''), nullif(min(t1), ''), nullif(min(t2), '')), 200) AS section, trim(string_agg(line, chr(10) ORDER BY p), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM carried GROUP BY doc_id, seg),
    segs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS INT) AS segment, section, text FROM grouped WHERE text <> '')"""


@q("win3_segments", f"WITH {_OUTLINE} SELECT doc_id, segment, section, text FROM segs")
def win3_segments(spark, d):
    return segments.segmented(table(spark, d, "documents"), "doc_id", "text")


@q(
    "win4_joined_segments",
    f"""WITH RECURSIVE {_OUTLINE}, walk AS (SELECT doc_id, segment, section, text, 0 AS grp, length(text) AS size FROM segs WHERE segment = 0
    UNION ALL SELECT s.doc_id, s.segment, s.section, s.text, CASE WHEN w.size // 4 < 120 AND (w.size + length(s.text)) // 4 <= 800 THEN w.grp ELSE w.grp + 1 END,
    CASE WHEN w.size // 4 < 120 AND (w.size + length(s.text)) // 4 <= 800 THEN w.size + 1 + length(s.text) ELSE length(s.text) END FROM walk w JOIN segs s ON s.doc_id = w.doc_id AND s.segment = w.segment + 1)
    SELECT doc_id, CAST(grp AS INT) AS segment, coalesce(arg_min(section, segment) FILTER (section <> ''), '') AS section, string_agg(text, chr(10) ORDER BY segment) AS text FROM walk GROUP BY doc_id, grp""",
)
def win4(spark, d):
    return segments.segmented(table(spark, d, "documents"), "doc_id", "text", small=True)


@q("win5_capped_pieces")
def win5(spark, d):
    return segments.segmented(table(spark, d, "documents"), "doc_id", "text", small=True, long=True)


@q("win6_word_windows", f"WITH {CHUNKS}, w AS (SELECT chunk_id, unnest(range(0, len(l))) AS p, unnest(l) AS word FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS l FROM chunks WHERE text IS NOT NULL)) SELECT chunk_id, p // 25 AS win, count(*) AS n, count(DISTINCT word) AS words FROM w GROUP BY ALL")
def win6(spark, d):
    w = chunks(spark, d).where("text is not null").select("chunk_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("p", "word"))
    return w.groupBy("chunk_id", F.floor(F.col("p") / 25).alias("win")).agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"))


@q("top5_core_documents_first", f"WITH {CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY contains(chunk_id, '::row'), chunk_id) AS place FROM chunks ORDER BY place LIMIT 1000")
def top5(spark, d):
    """The first 1,000 of a work list: a top-k with the places counted afterwards, over the k rows only."""
    best = chunks(spark, d).select("chunk_id", F.contains("chunk_id", F.lit("::row")).alias("row")).orderBy("row", "chunk_id").limit(1000)
    return best.select("chunk_id", F.row_number().over(Window.orderBy("row", "chunk_id")).cast("long").alias("place"))


@q("top6_hash_sample", f"WITH {CHUNKS} SELECT doc_type, chunk_id FROM (SELECT doc_type, chunk_id, row_number() OVER (PARTITION BY doc_type ORDER BY md5(chunk_id || ':7'), chunk_id) AS k FROM chunks) WHERE k <= 20")
def top6(spark, d):
    """A seeded sample of 20 per type: the least digests, pruned in every partition before the shuffle."""
    w = Window.partitionBy("doc_type").orderBy(F.md5(F.concat("chunk_id", F.lit(":7"))), "chunk_id")
    return chunks(spark, d).select("doc_type", "chunk_id").withColumn("k", F.row_number().over(w)).where("k <= 20").select("doc_type", "chunk_id")


@q("set1_families_together", "SELECT 'chunk' AS family, count(*) AS n FROM chunk UNION ALL SELECT 'document', count(*) FROM documents UNION ALL SELECT 'turn', count(*) FROM turns")
def set1(spark, d):
    one = lambda name, t: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "n")
    return one("chunk", "chunk").unionByName(one("document", "documents")).unionByName(one("turn", "turns"))


@q("set2_distinct_in_order", f"WITH {CHUNKS} SELECT source_id, section, min(chunk_id) AS first FROM chunks WHERE section <> '' GROUP BY source_id, section")
def set2(spark, d):
    return chunks(spark, d).where("section != ''").groupBy("source_id", "section").agg(F.min("chunk_id").alias("first"))


@q("set3_words_in_both", f"WITH {CHUNKS}, w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, CAST(len([x FOR x IN a IF list_contains(b, x)]) AS BIGINT) AS both, CAST(len([x FOR x IN a IF NOT list_contains(b, x)]) AS BIGINT) AS title_only FROM w")
def set3(spark, d):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    c = chunks(spark, d).where("text is not null")
    return c.select("chunk_id", F.size(F.array_intersect(words("title"), words("text"))).cast("long").alias("both"), F.size(F.array_except(words("title"), words("text"))).cast("long").alias("title_only"))


@q("snk9_chunk_report", f"WITH {CHUNKS} SELECT CASE WHEN length(text) < 100 THEN 'small' WHEN length(text) > 3000 THEN 'big' ELSE 'fit' END AS size, CASE WHEN contains(chunk_id, '::row') THEN 'row' WHEN starts_with(source_id, 'qco_') THEN 'order' ELSE 'document' END AS family, count(*) AS chunks, count(DISTINCT source_id) AS sources FROM chunks WHERE text IS NOT NULL GROUP BY ALL")
def snk9(spark, d):
    size = F.when(F.length("text") < 100, "small").when(F.length("text") > 3000, "big").otherwise("fit")
    family = F.when(F.contains("chunk_id", F.lit("::row")), "row").when(F.col("source_id").startswith("qco_"), "order").otherwise("document")
    return chunks(spark, d).where("text is not null").groupBy(size.alias("size"), family.alias("family")).agg(F.count("*").alias("chunks"), F.count_distinct("source_id").alias("sources"))


