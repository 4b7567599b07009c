"""Product rows of the tables' sources: look-ups by number, by name and by words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import fusion
from sparkloom.plans.base import ASKED, CHUNKS, RESULTS, asked, chunks, results
from sparkloom.plans.registry import Registry
from sparkloom.plans.scalars import SQL_NAME_WORDS
from sparkloom.runtime import broadcast_if_small, cut, table

REGISTRY = Registry()
q = REGISTRY.add


def products(spark, d) -> DataFrame:
    """(row_id, name, is_number, source_id) of the table rows."""
    c = chunks(spark, d).where("doc_type = 'product_row' and text is not null")
    return c.select(F.col("chunk_id").alias("row_id"), F.trim(F.regexp_extract("text", r"Product: ([^|]+)", 1)).alias("name"), F.regexp_extract("text", r"\| (IS [^|]+?) \|", 1).alias("is_number"), "source_id").where("name != ''")


PRODUCTS = "products AS (SELECT * FROM (SELECT chunk_id AS row_id, trim(regexp_extract(text, 'Product: ([^|]+)', 1)) AS name, regexp_extract(text, '\\| (IS [^|]+?) \\|', 1) AS is_number, source_id FROM chunks WHERE doc_type = 'product_row' AND text IS NOT NULL) WHERE name <> '')"


@q("src2_product_rows", f"WITH {CHUNKS}, {PRODUCTS} SELECT row_id, name, is_number FROM products")
def src2(spark, d):
    return products(spark, d).select("row_id", "name", "is_number")


def number_keys(c) -> F.Column:
    """A standard's number, and the number with its part."""
    found = F.regexp_extract_all(c, F.lit(r"IS (\d{2,5}(?::\d{4})?(?: \(Part \d+)?)"), F.lit(1))
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1)
    part = lambda x: F.regexp_extract(x, r"\(Part (\d+)", 1)
    return F.array_distinct(F.concat(F.transform(found, number), F.transform(F.filter(found, lambda x: part(x) != ""), lambda x: F.concat(number(x), F.lit("-"), part(x)))))


_FOUND = "regexp_extract_all({0}, 'IS (\\d{{2,5}}(?::\\d{{4}})?(?: \\(Part \\d+)?)', 1)"
SQL_KEYS = lambda e: "list_distinct(list_concat([regexp_extract(x, '^(\\d+)', 1) FOR x IN " + _FOUND.format(e) + "], [regexp_extract(x, '^(\\d+)', 1) || '-' || regexp_extract(x, '\\(Part (\\d+)', 1) FOR x IN " + _FOUND.format(e) + " IF regexp_extract(x, '\\(Part (\\d+)', 1) <> '']))"


@q(
    "joi4_products_by_number",
    f"""WITH {CHUNKS}, {PRODUCTS}, {RESULTS}, p AS (SELECT row_id, unnest({SQL_KEYS('is_number')}) AS k FROM products), a AS (SELECT id, unnest({SQL_KEYS('question')}) AS k FROM results WHERE question IS NOT NULL)
    SELECT id, row_id, count(*) AS shared FROM a JOIN p USING (k) GROUP BY id, row_id""",
)
def joi4(spark, d):
    p = products(spark, d).select("row_id", F.explode(number_keys(F.col("is_number"))).alias("k"))
    a = results(spark, d).where("question is not null").select("id", F.explode(number_keys(F.col("question"))).alias("k"))
    return a.join(p, "k").groupBy("id", "row_id").agg(F.count("*").alias("shared"))


@q(
    "joi5_names_in_questions",
    f"""WITH {CHUNKS}, {PRODUCTS}, {RESULTS}, n AS (SELECT DISTINCT lower(name) AS name FROM products WHERE length(name) >= 4)
    SELECT id, name FROM results, n WHERE question IS NOT NULL AND regexp_matches(' ' || lower(question) || ' ', '[^a-z0-9]' || replace(name, '-', '\\-') || '(?:s|es)?[^a-z0-9]')""",
)
def joi5(spark, d):
    """Names contained in questions at word borders, with a plural ending at most.

    No nested loop, see ``named_in``.
    """
    names = products(spark, d).where("length(name) >= 4").select(F.lower("name").alias("name")).distinct()
    return named_in(results(spark, d).where("question is not null").select("id", "question"), names)


def named_in(asks: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of names contained in the questions of ``asks`` (id, question).

    A name's first two words and a question's runs of one and two words meet in an equi-join; the exact test of the whole name follows, so
    names may have any length. Names without such words meet all questions.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    keyed_names = names.withColumn("key", F.array_join(F.slice(words(F.col("name")), 1, 2), " "))
    said = asks.select("id", F.lower("question").alias("said"), words(F.col("question")).alias("w"))
    runs = said.select("id", "said", F.explode(F.expr("concat(array(''), w, transform(w, (x, i) -> concat(x, ' ', coalesce(get(w, i + 1), ''))))")).alias("run"))
    keyed = runs.select("id", "said", F.explode(F.array_distinct(F.array("run", F.regexp_replace("run", "s$", ""), F.regexp_replace("run", "es$", "")))).alias("key")).distinct()
    hit = keyed.join(keyed_names, "key")
    inside = F.expr("regexp_like(concat(' ', said, ' '), concat('[^a-z0-9]', replace(name, '-', '\\\\-'), '(?:s|es)?[^a-z0-9]'))")
    return hit.where(inside).select("id", "name").distinct()


def overlaps(spark, d) -> DataFrame:
    """(query_id, row_id, shared, n_words): words that a question and a product's name share, by an inverted index."""
    p = products(spark, d).select("row_id", T.name_words(F.col("name")).alias("w"))
    a = asked(spark, d).select("query_id", F.explode(T.name_words(F.col("question"))).alias("word"))
    index = p.select("row_id", F.size("w").alias("n_words"), F.explode("w").alias("word"))
    return index.join(broadcast_if_small(cut(a)), "word").groupBy("query_id", "row_id", "n_words").agg(F.count("*").alias("shared"))


OVERLAPS = f"""WITH {CHUNKS}, {PRODUCTS}, {ASKED}, idx AS (SELECT row_id, len({SQL_NAME_WORDS('name')}) AS n_words, unnest({SQL_NAME_WORDS('name')}) AS word FROM products), aw AS (SELECT query_id, unnest({SQL_NAME_WORDS('question')}) AS word FROM asked),
    o AS (SELECT query_id, row_id, n_words, count(*) AS shared FROM aw JOIN idx USING (word) GROUP BY ALL)"""


@q("joi6_products_by_words", f"{OVERLAPS}, s AS (SELECT *, shared / (sqrt(n_words) + 1) AS score FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS k FROM s) SELECT query_id, row_id, round(score, 6) AS score, shared = n_words AS full_match FROM r WHERE k <= 5")
def joi6(spark, d):
    s = overlaps(spark, d).withColumn("score", F.col("shared") / (F.sqrt("n_words") + 1))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 5").select("query_id", "row_id", F.round("score", 6).alias("score"), (F.col("shared") == F.col("n_words")).alias("full_match"))


@q("joi7_coverage", f"{OVERLAPS}, n AS (SELECT query_id, count(*) AS asked_words FROM aw WHERE word IN (SELECT word FROM idx) GROUP BY query_id), r AS (SELECT query_id, row_id, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, row_id DESC) AS k FROM o) SELECT query_id, row_id, round(shared / asked_words, 6) AS coverage FROM r JOIN n USING (query_id) WHERE k <= 10")
def joi7(spark, d):
    """Overlap limited to words that occur in some product's name; ties by descending row."""
    vocabulary = products(spark, d).select(F.explode(T.name_words(F.col("name"))).alias("word")).distinct()
    n = asked(spark, d).select("query_id", F.explode(T.name_words(F.col("question"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("query_id").agg(F.count("*").alias("asked_words"))
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("row_id"))
    r = overlaps(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 10")
    return r.join(n, "query_id").select("query_id", "row_id", F.round(F.col("shared") / F.col("asked_words"), 6).alias("coverage"))


@q(
    "top8_fused_candidates",
    f"""{OVERLAPS}, keyword AS (SELECT query_id, row_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, row_id) - 1 AS rank FROM o),
    pk AS (SELECT row_id, unnest({SQL_KEYS('is_number')}) AS k FROM products), ak AS (SELECT query_id, unnest({SQL_KEYS('question')}) AS k FROM asked), st AS (SELECT query_id, row_id, count(*) AS n FROM ak JOIN pk USING (k) GROUP BY ALL),
    strong AS (SELECT query_id, row_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, row_id) - 1 AS rank FROM st),
    f AS (SELECT query_id, id, sum(1 / (61.0::DOUBLE + rank)) AS score FROM (SELECT * FROM keyword WHERE rank < 10 UNION ALL SELECT * FROM strong WHERE rank < 10) GROUP BY ALL)
    SELECT query_id, id AS row_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM f) WHERE k <= 15""",
)
def top8(spark, d):
    ranked = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(n), "row_id")) - 1).where("rank < 10").select("query_id", F.col("row_id").alias("id"), "rank")
    p = products(spark, d).select("row_id", F.explode(number_keys(F.col("is_number"))).alias("k"))
    a = asked(spark, d).select("query_id", F.explode(number_keys(F.col("question"))).alias("k"))
    strong = a.join(p, "k").groupBy("query_id", "row_id").agg(F.count("*").alias("n"))
    f = fusion.reciprocal_rank(ranked(overlaps(spark, d), "shared"), ranked(strong, "n"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return f.withColumn("k", F.row_number().over(w)).where("k <= 15").select("query_id", F.col("id").alias("row_id"), F.round("score", 8).alias("score"))


@q("joi8_first_title_per_number", f"WITH {CHUNKS}, {PRODUCTS}, e AS (SELECT unnest({SQL_KEYS('is_number')}) AS number, row_id, name FROM products) SELECT number, arg_min(name, row_id) AS name, count(*) AS n FROM e GROUP BY number")
def joi8(spark, d):
    """A list column exploded, the first row of each value wins."""
    e = products(spark, d).select(F.explode(number_keys(F.col("is_number"))).alias("number"), "row_id", "name")
    return e.groupBy("number").agg(F.min_by("name", "row_id").alias("name"), F.count("*").alias("n"))


@q("joi26_deciding_words", f"{OVERLAPS}, r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, row_id) AS k FROM o), x AS (SELECT query_id, k, row_id, list_sort({SQL_NAME_WORDS('name')}) AS w FROM r JOIN products USING (row_id) WHERE k <= 3) SELECT a.query_id, b.row_id AS row_id, array_to_string([y FOR y IN a.w IF NOT list_contains(b.w, y)], ' ') AS only_best, array_to_string([y FOR y IN b.w IF NOT list_contains(a.w, y)], ' ') AS only_other FROM x a JOIN x b ON a.query_id = b.query_id AND a.k = 1 AND b.k > 1")
def joi26(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "row_id")
    r = overlaps(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").join(products(spark, d), "row_id").select("query_id", "k", "row_id", F.array_sort(T.name_words(F.col("name"))).alias("w"))
    best = r.where("k = 1").select("query_id", F.col("w").alias("b"))
    only = lambda a, b, n: F.array_join(F.array_except(a, b), " ").alias(n)
    return r.where("k > 1").join(best, "query_id").select("query_id", "row_id", only("b", "w", "only_best"), only("w", "b", "only_other"))


@q("fil15_usable_rows", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE doc_type = 'product_row' AND coalesce(nullif(regexp_extract(text, 'Product: ([^|]+)', 1), ''), nullif(regexp_extract(text, '(IS \\d+)', 1), '')) IS NOT NULL")
def fil15(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return chunks(spark, d).where("doc_type = 'product_row'").where(F.coalesce(part("Product: ([^|]+)"), part(r"(IS \d+)")).isNotNull()).select("chunk_id")


@q("str21_row_texts", "SELECT p_partkey, concat_ws(' | ', p_name, p_brand, nullif(p_type, 'ECONOMY'), 'Size: ' || CAST(p_size AS VARCHAR)) AS row_text FROM part")
def str21(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" | ", "p_name", "p_brand", F.nullif(F.col("p_type"), F.lit("ECONOMY")), F.concat(F.lit("Size: "), F.col("p_size").cast("string"))).alias("row_text"))


def unique_headers(part: DataFrame, keys: int) -> DataFrame:
    """(p_partkey, header): names that stand more than once in a group of ``keys`` part keys are numbered."""
    h = part.select("p_partkey", F.floor(F.col("p_partkey") / keys).alias("g"), F.regexp_replace(F.lower("p_type"), "[^a-z]+", "_").alias("name"))
    w = Window.partitionBy("name", "g")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("p_partkey"))
    return h.select("p_partkey", F.when(n > 1, F.concat("name", F.lit("_"), k.cast("string"))).otherwise(F.col("name")).alias("header"))


@q("str18_header_suffixes", "WITH h AS (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z]+', '_', 'g') AS name FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY name, p_partkey // 100) > 1 THEN name || '_' || CAST(row_number() OVER (PARTITION BY name, p_partkey // 100 ORDER BY p_partkey) AS VARCHAR) ELSE name END AS header FROM h")
def str18(spark, d):
    """Column names made unique within groups of a hundred columns."""
    return unique_headers(table(spark, d, "part"), 100)


@q("str18_headers_of_all_parts", "WITH h AS (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z]+', '_', 'g') AS name FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY name, p_partkey // 10) > 1 THEN name || '_' || CAST(row_number() OVER (PARTITION BY name, p_partkey // 10 ORDER BY p_partkey) AS VARCHAR) ELSE name END AS header FROM h")
def str18_all(spark, d):
    """Column names made unique within groups of ten columns, over all parts."""
    return unique_headers(table(spark, d, "part"), 10)


@q("joi18_scanned_chunks", f"WITH {CHUNKS}, p AS (SELECT DISTINCT source_id, unnest(ocr_pages) AS page FROM parsed) SELECT chunk_id FROM chunks JOIN p USING (source_id, page)")
def joi18(spark, d):
    """A look-up by two columns."""
    p = table(spark, d, "parsed").select("source_id", F.explode("ocr_pages").alias("page")).distinct()
    return chunks(spark, d).join(broadcast_if_small(cut(p)), ["source_id", "page"]).select("chunk_id")
