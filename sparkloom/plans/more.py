"""Further operators: query rewriting, titles, evidence, trimming, stated facts, carried categories, similarity within a threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import citations, fusion, lexical, vectors
from sparkloom.plans.base import ASKED, CHUNKS, RESULTS, TURNS, asked, chunks, results, sql_replaced, turns
from sparkloom.plans.registry import Registry
from sparkloom.plans.search import FUSED, NEIGHBOURS, docs_of, fused, neighbours, queries_of, sql_bm25, sql_top
from sparkloom.plans.scalars import SQL_EMBED
from sparkloom.runtime import cut, table

REGISTRY = Registry()
q = REGISTRY.add

# Mixed-language question words and their English ones.
HINGLISH = [(r"\b(kitna|kitni|kitne)\b", "how much"), (r"\bkaise\b", "how"), (r"\bkya\b", "what"), (r"\bkab\b", "when"), (r"\bkahan\b", "where"), (r"\bchahiye\b", "is needed")]
# Designations written with a colon, a dash or in small letters.
NUMBERS = [(r"\b(?:IS|is)[\-:]?(\d{3,5})\b", "IS {1}"), (r"\bIS\s*[\-:]\s*(\d{2,5})\b", "IS {1}")]


@q(
    "str4_normalised_questions",
    f"WITH {RESULTS} SELECT id, " + sql_replaced("trim(regexp_replace(question, '\\s+', ' ', 'g'))", *HINGLISH, *((p, r.replace("{1}", "\\1")) for p, r in NUMBERS)) + " AS normal FROM results WHERE question IS NOT NULL",
)
def str4(spark, d):
    r = results(spark, d).where("question is not null")
    return r.select("id", T.replaced(F.trim(F.regexp_replace("question", r"\s+", " ")), *HINGLISH, *((p, x.replace("{1}", "$1")) for p, x in NUMBERS)).alias("normal"))


# Hindi words of questions and the documents' English ones.
HINDI = [
    ("शुल्क", "fee"), ("मानक", "standard"), ("अनिवार्य", "compulsory"), ("लाइसेंस", "licence"), ("आवेदन", "application"),
    ("परीक्षण", "testing"), ("नमूना", "sample"), ("निर्माता", "manufacturer"), ("शिकायत", "complaint"), ("नवीनीकरण", "renewal"),
]


@q(
    "str27_english_keywords",
    f"""WITH {RESULTS} SELECT id, array_to_string(list_concat(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9.\\-/()]*|\\d+'), [x FOR x IN [{', '.join(f"CASE WHEN contains(question, '{h}') THEN '{e}' END" for h, e in HINDI)}] IF x IS NOT NULL]), ' ') AS keywords
    FROM results WHERE regexp_matches(question, '[ऀ-ॿ]')""",
)
def str27(spark, d):
    words = F.array_compact(F.array(*(F.when(F.contains("question", F.lit(h)), e) for h, e in HINDI)))
    latin = F.regexp_extract_all("question", F.lit(r"([A-Za-z][A-Za-z0-9.\-/()]*|\d+)"), F.lit(1))
    return results(spark, d).where(F.col("question").rlike("[ऀ-ॿ]")).select("id", F.array_join(F.concat(latin, words), " ").alias("keywords"))


@q(
    "str19_numbered_titles",
    f"""WITH {CHUNKS}, l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL), m AS (SELECT DISTINCT chunk_id, regexp_extract(line, '^\\s*(\\d+)\\.\\s+', 1) AS no, trim(regexp_extract(line, '^\\s*\\d+\\.\\s+(.*)$', 1)) AS rest FROM l WHERE regexp_matches(line, '^\\s*\\d+\\.\\s+[A-Z]'))
    SELECT chunk_id, no || '. ' || CASE WHEN ends_with(rest, '?') AND length(rest) < 200 THEN rest ELSE regexp_extract(rest, '^([^.]{{3,120}})', 1) END AS title FROM m WHERE NOT ends_with(rest, ':')""",
)
def str19(spark, d):
    line = chunks(spark, d).where("text is not null").select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\d+\.\s+[A-Z]"))
    m = line.select("chunk_id", F.regexp_extract("line", r"^\s*(\d+)\.\s+", 1).alias("no"), F.trim(F.regexp_extract("line", r"^\s*\d+\.\s+(.*)$", 1)).alias("rest")).distinct()
    title = F.when(F.col("rest").endswith("?") & (F.length("rest") < 200), F.col("rest")).otherwise(F.regexp_extract("rest", "^([^.]{3,120})", 1))
    return m.where(~F.col("rest").endswith(":")).select("chunk_id", F.concat("no", F.lit(". "), title).alias("title"))


@q("str20_better_titles", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN regexp_extract(text, '([A-Z][A-Za-z ,&()/-]{{5,80}}? at [A-Z][a-z]+)', 1) <> '' THEN regexp_extract(text, '([A-Z][A-Za-z ,&()/-]{{5,80}}? at [A-Z][a-z]+)', 1) || ' (' || title || ')' ELSE title END AS better FROM chunks WHERE text IS NOT NULL")
def str20(spark, d):
    found = F.regexp_extract("text", r"([A-Z][A-Za-z ,&()/-]{5,80}? at [A-Z][a-z]+)", 1)
    return chunks(spark, d).where("text is not null").select("chunk_id", F.when(found != "", F.concat(found, F.lit(" ("), "title", F.lit(")"))).otherwise(F.col("title")).alias("better"))


@q("str17_tidied_answers", f"WITH {RESULTS} SELECT id, regexp_replace(" + sql_replaced("answer", (r"\s*\[\d+\.\d+\]", ""), (r"(\[\d+\])\s*\((?:[ivx]+|[a-z])\)", r"\1"), (r"\n{3,}", "\n\n")) + ", '^\\s+|\\s+$', '', 'g') AS tidy FROM results WHERE answer IS NOT NULL")
def str17(spark, d):
    t = T.replaced(F.col("answer"), (r"\s*\[\d+\.\d+\]", ""), (r"(\[\d+\])\s*\((?:[ivx]+|[a-z])\)", "$1"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
    return results(spark, d).where("answer is not null").select("id", t.alias("tidy"))


_HEADING = "'\\s*(#+\\s.*|(\\d+\\.\\s+)?\\*\\*[^*]+\\*\\*:?)\\s*'"


@q(
    "str17_without_empty_parts",
    f"""WITH {RESULTS}, l AS (SELECT id, unnest(range(1, len(string_split(answer, chr(10))) + 1)) - 1 AS p, unnest(string_split(answer, chr(10))) AS line FROM results WHERE answer IS NOT NULL),
    r AS (SELECT *, starts_with(ltrim(line), '|') AS tab FROM l), g AS (SELECT *, sum(CASE WHEN tab THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY p) AS run FROM r),
    f AS (SELECT *, p > min(p) OVER (PARTITION BY id, run, tab) AND NOT regexp_matches(line, '^\\s*\\|?\\s*:?-{{3,}}') AND regexp_replace(line, '(?i)[|\\s\\-–—:]|\\[\\d+\\]|n/?a', '', 'g') <> '' AS says FROM g),
    t AS (SELECT id, p, line FROM (SELECT *, bool_or(says) OVER (PARTITION BY id, run, tab) AS spoken FROM f) WHERE NOT tab OR spoken),
    h AS (SELECT *, regexp_full_match(line, {_HEADING}) AS head FROM t), n AS (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN head END IGNORE NULLS) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM h)
    SELECT id, p AS line_no, line FROM n WHERE NOT head OR NOT coalesce(after, true)""",
)
def str17_parts(spark, d):
    """The lines of answers without tables that lost their rows and headings that nothing follows."""
    lines = citations.without_empty_tables(results(spark, d), "id", "answer")
    return citations.without_empty_headings(lines).select("id", F.col("p").cast("long").alias("line_no"), "line")


@q("fil10_categories", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN starts_with(source_id, 'qco_') OR starts_with(source_id, 'scheme') THEN 'qco' WHEN starts_with(source_id, 'hm_') THEN 'hallmarking' WHEN starts_with(source_id, 'help_') THEN 'consumer' WHEN doc_type IN ('act', 'rule', 'regulation') THEN 'law' ELSE 'certification' END AS category FROM chunks")
def fil10(spark, d):
    begins = lambda *p: reduce(lambda a, b: a | b, (F.col("source_id").startswith(x) for x in p))
    kind = F.when(begins("qco_", "scheme"), "qco").when(begins("hm_"), "hallmarking").when(begins("help_"), "consumer").when(F.col("doc_type").isin("act", "rule", "regulation"), "law").otherwise("certification")
    return chunks(spark, d).select("chunk_id", kind.alias("category"))


@q("fil18_product_questions", f"WITH {RESULTS} SELECT id, regexp_matches(lower(question), '\\b(standard|mark|licen[cs]e|compulsory)\\b') AND (type IN ('product_qco', 'certification') OR regexp_matches(question, 'IS \\d+')) AS about_product FROM results WHERE question IS NOT NULL AND type IS NOT NULL")
def fil18(spark, d):
    about = F.lower("question").rlike(r"\b(standard|mark|licen[cs]e|compulsory)\b") & (F.col("type").isin("product_qco", "certification") | F.col("question").rlike(r"IS \d+"))
    return results(spark, d).where("question is not null and type is not null").select("id", about.alias("about_product"))


@q("fil23_product_texts", "SELECT p_partkey, p_name || '. Also called: ' || coalesce(nullif(p_type, 'ECONOMY'), '-') || '. ' || p_brand AS product_text FROM part")
def fil23(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(". Also called: "), F.coalesce(F.nullif(F.col("p_type"), F.lit("ECONOMY")), F.lit("-")), F.lit(". "), "p_brand").alias("product_text"))


@q("fil25_briefs", f"{FUSED}, {sql_top('best', 'fused', 5)} SELECT query_id, chunk_id, rank + 1 AS n, substr(title, 1, 90) AS title, substr(coalesce(section, ''), 1, 80) AS section, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS text FROM best JOIN chunks ON id = chunk_id")
def fil25(spark, d):
    c = chunks(spark, d).select("chunk_id", "title", "section", "text")
    best = lexical.top(fused(spark, d), 5).select("query_id", F.col("id").alias("chunk_id"), (F.col("rank") + 1).cast("long").alias("n"))
    return best.join(c, "chunk_id").select("query_id", "chunk_id", "n", F.substring("title", 1, 90).alias("title"), F.substring(F.coalesce("section", F.lit("")), 1, 80).alias("section"), T.snippet(F.col("text")).alias("text"))


@q("top7_hybrid_search", f"{FUSED}, {sql_top('best', 'fused', 8)} SELECT query_id, id AS chunk_id, rank FROM best")
def top7(spark, d):
    return lexical.top(fused(spark, d), 8).select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"))


#: Dimensions of the vectors that words are counted into.
DIMS = 64
_SQL_VECTOR = lambda source, key, text: f"SELECT {key}, [{', '.join(f'count(*) FILTER (dim = {k})::DOUBLE' for k in range(DIMS))}] AS v FROM (SELECT {key}, CAST(ascii(substr(md5(w), 1, 1)) * 7 + ascii(substr(md5(w), 2, 1)) * 31 + ascii(substr(md5(w), 3, 1)) AS INT) % {DIMS} AS dim FROM (SELECT {key}, unnest(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{3,}}'))) AS w FROM {source} WHERE {text} IS NOT NULL)) GROUP BY {key}"


def counted_words(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``v`` in the place of ``text``, a vector of ``DIMS`` dimensions: the text's distinct words, each counted in the dimension that
    its digest names. Each word of a batch is digested once."""
    rest = [c for c in df.columns if c != text]
    words = df.select(*rest, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(len(rest))
            found = lists.flatten().dictionary_encode()
            digests = (hashlib.md5(w.encode()).hexdigest() for w in found.dictionary.to_pylist())
            dims = np.array([(ord(h[0]) * 7 + ord(h[1]) * 31 + ord(h[2])) % DIMS for h in digests], np.int64)
            of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            counts = np.bincount(of * DIMS + dims[found.indices.to_numpy()], minlength=n * DIMS).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * DIMS + 1, DIMS, dtype=np.int32)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], v], names=[*rest, "v"])

    return words.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in df.select(*rest).dtypes), "v array<int>"]))


@q(
    "top7_hybrid_with_vectors",
    f"""WITH {CHUNKS}, {ASKED}, {sql_bm25('whole', SQL_EMBED)}, {sql_top('lexical', 'whole', 20)}, cv AS ({_SQL_VECTOR('chunks', 'chunk_id', 'text')}), qv AS ({_SQL_VECTOR('asked', 'query_id', 'question')}),
    near AS (SELECT query_id, chunk_id AS id, list_cosine_similarity(cv.v, qv.v) AS score FROM cv, qv), {sql_top('closest', 'near', 20)},
    f AS (SELECT query_id, id, sum(1 / (61.0::DOUBLE + rank)) AS score FROM (SELECT query_id, id, rank FROM lexical UNION ALL SELECT query_id, id, rank FROM closest) GROUP BY ALL), {sql_top('hybrid', 'f', 8)} SELECT query_id, id AS chunk_id, rank FROM hybrid""",
)
def top7_vectors(spark, d):
    """A lexical list and a vector list of 20 each, fused; the vectors are those of the words."""
    tokens = T.tokens(T.embed_text(F.col("title"), F.col("section"), F.col("text")))
    c = chunks(spark, d).where("text is not null").select(F.col("chunk_id").alias("id"), tokens.alias("tokens"), "text")
    c = cut(counted_words(c.select("id", F.concat_ws(" ", "tokens").alias("said"), F.size("tokens").alias("dl"), "text"), "text"))
    asks = cut(counted_words(asked(spark, d).select("query_id", T.tokens(F.col("question")).alias("tokens"), "question"), "question"))
    first = lexical.search(lexical.of_written(c, "said", "dl"), asks.select("query_id", "tokens"), 20)
    said = "exists(v, x -> x > 0)"
    near = vectors.nearest(c.where(said).select(F.col("id").alias("chunk_id"), "v"), asks.where(said).select("query_id", "v"), "chunk_id", "v", 20)
    return lexical.top(fusion.reciprocal_rank(first, near), 8).select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"))


@q("rul11_evidence", f"WITH {CHUNKS}, {ASKED}, {sql_bm25('whole', SQL_EMBED)}, {sql_top('best', 'whole', 3)}, {NEIGHBOURS} SELECT query_id, b.id AS chunk_id, CAST(length(concat_ws(' ', p.text, c.text, n.text)) AS BIGINT) AS evidence_chars, md5(concat_ws(' ', p.text, c.text, n.text)) AS evidence FROM best b JOIN chunks c ON c.chunk_id = b.id JOIN beside e ON e.chunk_id = b.id LEFT JOIN chunks p ON p.chunk_id = e.previous LEFT JOIN chunks n ON n.chunk_id = e.next")
def rul11(spark, d):
    """What a citation of a hit may rely on: the chunk with the one before and the one behind."""
    c = chunks(spark, d).select("chunk_id", "text")
    best = lexical.search(docs_of(spark, d), queries_of(spark, d), 3).select("query_id", F.col("id").alias("chunk_id"))
    text = lambda k, n: c.select(F.col("chunk_id").alias(k), F.col("text").alias(n))
    e = best.join(neighbours(spark, d), "chunk_id").join(text("chunk_id", "t"), "chunk_id").join(text("previous", "p"), "previous", "left").join(text("next", "n"), "next", "left")
    whole = F.concat_ws(" ", "p", "t", "n")
    return e.select("query_id", "chunk_id", F.length(whole).cast("long").alias("evidence_chars"), F.md5(whole).alias("evidence"))


@q(
    "win18_trimmed_results",
    f"""WITH {RESULTS}, t AS (SELECT id, unnest(range(1, len(top5) + 1)) AS n, unnest(top5) AS chunk_id FROM results), {CHUNKS}, l AS (SELECT id, n, length(text) AS len FROM t JOIN chunks USING (chunk_id) WHERE text IS NOT NULL),
    h AS (SELECT *, sum(len) OVER (PARTITION BY id) AS total FROM l) SELECT id, n, CAST(CASE WHEN total <= 4000 THEN len ELSE least(len, 300) END AS BIGINT) AS kept FROM h WHERE total <= 4000 OR n <= 3""",
)
def win18(spark, d):
    """Results that are too long together keep their best three, each cut to 300 characters."""
    t = results(spark, d).select("id", F.posexplode("top5").alias("p", "chunk_id")).select("id", (F.col("p") + 1).cast("long").alias("n"), "chunk_id")
    has = t.join(chunks(spark, d).where("text is not null").select("chunk_id", F.length("text").cast("long").alias("len")), "chunk_id")
    h = has.withColumn("total", F.sum("len").over(Window.partitionBy("id"))).where("total <= 4000 or n <= 3")
    return h.select("id", "n", F.when(F.col("total") <= 4000, F.col("len")).otherwise(F.least("len", F.lit(300))).cast("long").alias("kept"))


_STATED = [("is_number", r"\bis\s*[:\-]?\s*(\d{2,5})"), ("scheme", r"\b(scheme[\s-]*(?:x|iv|ii|i)\b|crs|fmcs|hallmarking)"), ("place", r"\bat ([a-z]{4,})")]


@q("rul5_stated_facts", f"WITH {TURNS}, f AS ({' UNION ALL '.join(f'''SELECT session_id, turn_no, '{k}' AS key, regexp_extract(lower(text), '{p}', 1) AS value FROM turn WHERE lower(trim(role)) IN ('user', 'human', 'customer') AND text IS NOT NULL''' for k, p in _STATED)}) SELECT session_id, key, arg_max(value, turn_no) AS value FROM f WHERE value <> '' GROUP BY session_id, key")
def rul5(spark, d):
    """Facts users stated, the last one of each kind kept; what nobody said is not there."""
    said = turns(spark, d).where("lower(trim(role)) in ('user', 'human', 'customer') and text is not null")
    facts = F.array(*(F.struct(F.lit(k).alias("key"), F.regexp_extract(F.lower("text"), p, 1).alias("value")) for k, p in _STATED))
    f = said.select("session_id", "turn_no", F.explode(facts).alias("f")).where("f.value != ''")
    return f.groupBy("session_id", F.col("f.key").alias("key")).agg(F.max_by("f.value", "turn_no").alias("value"))


_SCHEMES = [(r"\b(difference|compare|versus|vs)\b", None), (r"hallmark", "Hallmarking"), (r"foreign|import", "FMCS"), (r"\bscheme[ -]?(x|10)\b", "X"), (r"\bscheme[ -]?(iv|4)\b", "IV"), (r"\bscheme[ -]?(ii|2)\b", "II"), (r"\blicen[cs]e|\bmark\b", "I")]


@q("rul1_detected_schemes", f"WITH {RESULTS} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN {repr(v) if v else 'NULL'}" for p, v in _SCHEMES) + " END AS scheme FROM results WHERE question IS NOT NULL")
def rul1(spark, d):
    """An ordered list of patterns; the first that matches decides, comparisons decide nothing."""
    first = F.when(F.lower("question").rlike(_SCHEMES[0][0]), F.lit(None).cast("string"))
    found = reduce(lambda c, p: c.when(F.lower("question").rlike(p[0]), p[1]), _SCHEMES[1:], first)
    return results(spark, d).where("question is not null").select("id", found.alias("scheme"))


@q(
    "win15_categories_carried",
    f"""WITH {CHUNKS}, l AS (SELECT chunk_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL AND contains(text, '| IS ')),
    c AS (SELECT *, last_value(CASE WHEN NOT starts_with(line, '|') THEN line END IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY line_no) AS category FROM l) SELECT chunk_id, line_no, category FROM c WHERE starts_with(line, '| IS ')""",
)
def win15(spark, d):
    """Table rows with the last line above that is no row: the group's heading, carried forward."""
    lines = chunks(spark, d).where("contains(text, '| IS ')").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    w = Window.partitionBy("chunk_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    c = lines.withColumn("category", F.last(F.when(~F.col("line").startswith("|"), F.col("line")), ignorenulls=True).over(w))
    return c.where(F.col("line").startswith("| IS ")).select("chunk_id", (F.col("p") + 1).cast("long").alias("line_no"), "category")


@q("joi11_similar_vectors", "SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.label <> b.label AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2")
def joi11(spark, d):
    """All vectors of another label within a cosine of 0.2 of each query vector; nothing is capped."""
    e = table(spark, d, "embeddings")
    asks = e.where("vec_id % 50 = 0").withColumn("query_id", F.col("vec_id"))
    return vectors.nearest(e, asks, "vec_id", "embedding", None, label="label", least=0.2).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@q("set4_all_words_of_a_source", f"WITH {CHUNKS}, w AS (SELECT DISTINCT source_id, unnest(list_concat(regexp_extract_all(lower(title), '[a-z]+'), regexp_extract_all(lower(coalesce(section, '')), '[a-z]+'))) AS word FROM chunks) SELECT source_id, count(*) AS words FROM w GROUP BY source_id")
def set4(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    union = F.array_union(words("title"), words(F.coalesce("section", F.lit(""))))
    return chunks(spark, d).select("source_id", F.explode(union).alias("word")).groupBy("source_id").agg(F.count_distinct("word").alias("words"))


@q("top4_strong_first", f"WITH {RESULTS} SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY NOT coalesce(hit5, false), round(coalesce(facts, 0), 6) DESC, id) AS k FROM results WHERE coalesce(facts, 0) >= 0.3) WHERE k <= 5")
def top4(spark, d):
    """Strong rows first, then by score, above a threshold, five of each type."""
    w = Window.partitionBy("type").orderBy(~F.coalesce("hit5", F.lit(False)), F.desc(F.round(F.coalesce("facts", F.lit(0.0)), 6)), "id")
    return results(spark, d).where("coalesce(facts, 0) >= 0.3").withColumn("k", F.row_number().over(w)).where("k <= 5").select("type", "id")


@q("mth4_projection")
def mth4(spark, d):
    """Vectors in two dimensions (principal components), for maps of the collection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(e)
    p = model.transform(e).select("vec_id", "label", vector_to_array("p").alias("p"))
    return p.select("vec_id", "label", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))
