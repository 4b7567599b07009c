"""Lexical and vector search, fusion, and what follows a ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import fusion, lexical, vectors
from sparkloom.plans.base import ASKED, CHUNKS, asked, chunks, in_ranges
from sparkloom.plans.registry import Registry
from sparkloom.plans.scalars import SQL_EMBED, SQL_TOKENS
from sparkloom.runtime import broadcast_if_small, cut, table

REGISTRY = Registry()
q = REGISTRY.add


def indexed(spark, d, *names: str) -> dict[str, DataFrame]:
    """The tokens of the chunks' texts with title and section (``whole``) and of their sections (``heads``), from one pass over the chunks."""
    texts = {"whole": T.embed_text(F.col("title"), F.col("section"), F.col("text")), "heads": F.col("section")}
    return lexical.tokenised(chunks(spark, d).where("text is not null"), "chunk_id", **{n: texts[n] for n in names})


def docs_of(spark, d) -> DataFrame:
    return indexed(spark, d, "whole")["whole"]


def queries_of(spark, d) -> DataFrame:
    return asked(spark, d).select("query_id", T.tokens(F.col("question")).alias("tokens"))


def best(spark, d, n: int) -> DataFrame:
    return lexical.search(docs_of(spark, d), queries_of(spark, d), n)


def sql_bm25(name: str, text: str) -> str:
    """Common table expressions ending in ``name`` (query_id, id, score)."""
    p = name
    return f"""{p}_docs AS (SELECT chunk_id AS id, tokens, len(tokens) AS dl FROM (SELECT chunk_id, {SQL_TOKENS(text)} AS tokens FROM chunks WHERE text IS NOT NULL) WHERE len(tokens) > 0),
    {p}_stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}_docs),
    {p}_df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM {p}_docs) GROUP BY term),
    {p}_raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {p}_df, {p}_stats),
    {p}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw),
    {p}_asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({SQL_TOKENS('question')}) AS term FROM asked) GROUP BY ALL),
    {p}_post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS term FROM {p}_docs) GROUP BY ALL),
    {p} AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {p}_asked JOIN {p}_idf USING (term) JOIN {p}_post USING (term), {p}_stats GROUP BY query_id, id HAVING score > 0)"""


def sql_top(name: str, source: str, n: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM {source}) WHERE rank < {n})"


WITH = f"WITH {CHUNKS}, {ASKED}, {sql_bm25('whole', SQL_EMBED)}"
WITH2 = f"{WITH}, {sql_bm25('heads', 'section')}, {sql_top('top_whole', 'whole', 30)}, {sql_top('top_heads', 'heads', 30)}"


@q("agg9_vocabulary", f"WITH {CHUNKS}, {ASKED}, {sql_bm25('whole', SQL_EMBED)} SELECT term, df, round(idf, 6) AS idf FROM whole_idf")
def vocabulary(spark, d):
    docs = docs_of(spark, d)
    return lexical.inverse_frequencies(docs, lexical.collection_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@q("agg9_bm25_search", f"{WITH}, {sql_top('best', 'whole', 20)} SELECT query_id, id AS chunk_id, round(score, 5) AS score, rank FROM best")
def search(spark, d):
    return best(spark, d, 20).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@q("fil2_search_within_agent", f"{WITH}, {sql_top('best', '(SELECT whole.* FROM whole JOIN chunks ON id = chunk_id WHERE agent = ' + chr(39) + 'law' + chr(39) + ')', 10)} SELECT query_id, id AS chunk_id, round(score, 5) AS score FROM best")
def search_agent(spark, d):
    law = chunks(spark, d).where("agent = 'law'").select(F.col("chunk_id").alias("id"))
    docs = docs_of(spark, d)
    return lexical.search(docs.join(law, "id", "left_semi"), queries_of(spark, d), 10, corpus=docs).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 5).alias("score"))


def fused(spark, d) -> DataFrame:
    docs, queries = indexed(spark, d, "whole", "heads"), cut(queries_of(spark, d))
    return fusion.reciprocal_rank(*(lexical.search(docs[n], queries, 30) for n in ("whole", "heads")))


FUSED = f"{WITH2}, fused AS (SELECT query_id, id, sum(1 / (61.0::DOUBLE + rank)) AS score FROM (SELECT query_id, id, rank FROM top_whole UNION ALL SELECT query_id, id, rank FROM top_heads) GROUP BY ALL)"


@q("agg1_reciprocal_rank_fusion", f"{FUSED} SELECT query_id, id AS chunk_id, round(score, 8) AS score FROM fused")
def rrf(spark, d):
    return fused(spark, d).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 8).alias("score"))


def adjusted(spark, d) -> DataFrame:
    """Fused scores, lowered for table rows and raised for passages about the law, with the chunk's columns."""
    c = chunks(spark, d).select(F.col("chunk_id").alias("id"), "source_id", "doc_type", "scheme", "text")
    # The hits are few (a bounded list for each query): the chunks stay where they are.
    x = c.join(broadcast_if_small(cut(fused(spark, d))), "id")
    factor = F.when(F.col("doc_type").isin("act", "rule", "regulation"), 1.4).when(F.col("doc_type") == "product_row", 0.25).otherwise(1.0)
    plus = F.when(F.col("scheme") == "general", 0.01).otherwise(0.0)
    return lexical.top(x.withColumn("score", F.col("score") * factor + plus), 30)


ADJUSTED = f"""{FUSED}, adj AS (SELECT query_id, id, source_id, doc_type, scheme, text, score * CASE WHEN doc_type IN ('act', 'rule', 'regulation') THEN 1.4 WHEN doc_type = 'product_row' THEN 0.25 ELSE 1.0 END::DOUBLE
    + CASE WHEN scheme = 'general' THEN 0.01 ELSE 0 END::DOUBLE AS score FROM fused JOIN chunks ON id = chunk_id), {sql_top('adjusted', 'adj', 30)}"""


@q("top3_adjusted_scores", f"{ADJUSTED} SELECT query_id, id AS chunk_id, rank, round(score, 8) AS score FROM adjusted")
def top3(spark, d):
    return adjusted(spark, d).select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 8).alias("score"))


# What asks for a definition, and what names a scheme (fixed values).
BASIC = r"^\s*(what (is|are|does)\b|define\b|who (is|are)\b)"
SCHEME_WORDS = [("hallmark", "Hallmarking"), ("foreign|import", "FMCS"), (r"\bscheme[ -]?(x|10)\b", "X"), (r"\bscheme[ -]?(iv|4)\b", "IV"), (r"\bscheme[ -]?(ii|2)\b", "II"), (r"\blicen[cs]e|\bmark\b", "I")]
_SCHEME = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{s}'" for p, s in SCHEME_WORDS) + " END"


@q(
    "top3_adjusted_in_full",
    f"""{FUSED}, ask AS (SELECT query_id, regexp_matches(lower(question), '{BASIC}') AS basic, regexp_extract(question, 'IS (\\d{{2,5}})', 1) AS no, {_SCHEME} AS wanted FROM asked),
    x AS (SELECT query_id, id, score * CASE WHEN basic AND (agent = 'general' OR doc_type = 'faq') THEN 1.6 ELSE 1 END::DOUBLE
      + CASE WHEN doc_type = 'product_row' AND no <> '' AND regexp_matches(text, 'IS ' || no || '\\b') THEN 0.05 WHEN doc_type = 'product_row' AND no = '' THEN 0.01 ELSE 0 END::DOUBLE AS s, coalesce(scheme, 'general') AS scheme, wanted, source_id FROM fused JOIN chunks ON id = chunk_id JOIN ask USING (query_id)),
    y AS (SELECT query_id, id, s * CASE WHEN wanted = scheme THEN 1.4 WHEN wanted IS NOT NULL AND scheme <> 'general' AND NOT (ends_with(source_id, '_products_table') OR ends_with(source_id, '_page')) THEN 0.25 ELSE 1 END::DOUBLE AS score FROM x),
    {sql_top('best', 'y', 30)} SELECT query_id, id AS chunk_id, rank, round(score, 8) AS score FROM best""",
)
def top3_full(spark, d):
    """Fused scores raised for definitions where one is asked for, by a bonus for the table row of the number asked about (a smaller one for
    rows where none is), raised for the scheme asked about and lowered for any other."""
    wanted = None
    for p, name in SCHEME_WORDS:
        wanted = F.when(F.lower("question").rlike(p), name) if wanted is None else wanted.when(F.lower("question").rlike(p), name)
    ask = asked(spark, d).select("query_id", F.lower("question").rlike(BASIC).alias("basic"), F.regexp_extract("question", r"IS (\d{2,5})", 1).alias("no"), wanted.alias("wanted"))
    c = chunks(spark, d).select(F.col("chunk_id").alias("id"), "source_id", "agent", "doc_type", F.coalesce("scheme", F.lit("general")).alias("scheme"), "text")
    x = c.join(broadcast_if_small(cut(fused(spark, d).join(ask, "query_id"))), "id")
    row = F.col("doc_type") == "product_row"
    named = F.regexp_like("text", F.concat(F.lit("IS "), "no", F.lit(r"\b")))
    basic = F.when(F.col("basic") & ((F.col("agent") == "general") | (F.col("doc_type") == "faq")), 1.6).otherwise(1.0)
    bonus = F.when(row & (F.col("no") != "") & named, 0.05).when(row & (F.col("no") == ""), 0.01).otherwise(0.0)
    other = F.col("wanted").isNotNull() & (F.col("scheme") != "general") & ~(F.col("source_id").endswith("_products_table") | F.col("source_id").endswith("_page"))
    scheme = F.when(F.col("wanted") == F.col("scheme"), 1.4).when(other, 0.25).otherwise(1.0)
    y = lexical.top(x.withColumn("score", (F.col("score") * basic + bonus) * scheme), 30)
    return y.select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 8).alias("score"))


@q("fil3_passing_filters", f"{ADJUSTED} SELECT query_id, id AS chunk_id FROM adjusted WHERE scheme IN ('I', 'general') AND doc_type = 'regulation' AND starts_with(source_id, 'conformity')")
def fil3(spark, d):
    return adjusted(spark, d).where("scheme in ('I', 'general') and doc_type = 'regulation' and startswith(source_id, 'conformity')").select("query_id", F.col("id").alias("chunk_id"))


_KEY = "substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 220)"
DEDUPED = f"{ADJUSTED}, deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY rank) AS rn FROM adjusted) WHERE rn = 1)"


def deduped(spark, d) -> DataFrame:
    return fusion.best_per_key(adjusted(spark, d).withColumn("key", T.letters_key(F.col("text"))), "key")


@q("win1_near_duplicates_collapsed", f"{DEDUPED} SELECT query_id, id AS chunk_id, rank FROM deduped")
def win1(spark, d):
    return deduped(spark, d).select("query_id", F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"))


CAPPED = f"""{DEDUPED}, classed AS (SELECT *, sum(CASE WHEN doc_type = 'product_row' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM deduped),
    capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM classed WHERE doc_type <> 'product_row' OR so_far <= 4) WHERE place <= 12)"""


def capped(spark, d) -> DataFrame:
    return fusion.capped(deduped(spark, d), "doc_type = 'product_row'", 4, 12)


@q("win7_class_capped_top", f"{CAPPED} SELECT query_id, id AS chunk_id, place FROM capped")
def win7(spark, d):
    return capped(spark, d).select("query_id", F.col("id").alias("chunk_id"), F.col("place").cast("long").alias("place"))


@q(
    "win8_context_budget",
    f"""{CAPPED}, held AS (SELECT query_id, id, place, sum(length(text)) OVER (PARTITION BY query_id ORDER BY place) AS h FROM capped),
    stop AS (SELECT query_id, min(place) AS s FROM held WHERE h > 6000 AND place > 1 GROUP BY query_id) SELECT query_id, id AS chunk_id, CAST(h AS BIGINT) AS held FROM held LEFT JOIN stop USING (query_id) WHERE s IS NULL OR place < s""",
)
def win8(spark, d):
    r = capped(spark, d).withColumn("len", F.length("text")).drop("rank").withColumnRenamed("place", "rank")
    return fusion.within_budget(r, "len", 6000).select("query_id", F.col("id").alias("chunk_id"), F.col("held").cast("long").alias("held"))


def neighbours(spark, d) -> DataFrame:
    """(chunk_id, source_id, previous, next) within a source by chunk id."""
    return beside(chunks(spark, d).select("chunk_id", "source_id"))


def beside(c: DataFrame, parts: int | None = None) -> DataFrame:
    """Neighbours of (chunk_id, source_id). A source may hold a large share of all chunks, so windows run over ranges of the ids; where a
    range ends, its edge comes from the source's next range."""
    b = in_ranges(c, parts)
    w = Window.partitionBy("source_id", "block").orderBy("chunk_id")
    inner = b.withColumn("p", F.lag("chunk_id").over(w)).withColumn("n", F.lead("chunk_id").over(w))
    ends = b.groupBy("source_id", "block").agg(F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
    v = Window.partitionBy("source_id").orderBy("block")
    ends = ends.select("source_id", "block", F.lag("last").over(v).alias("before"), F.lead("first").over(v).alias("after"))
    return inner.join(ends, ["source_id", "block"]).select("chunk_id", "source_id", F.coalesce("p", "before").alias("previous"), F.coalesce("n", "after").alias("next"))


NEIGHBOURS = "beside AS (SELECT chunk_id, source_id, lag(chunk_id) OVER (PARTITION BY source_id ORDER BY chunk_id) AS previous, lead(chunk_id) OVER (PARTITION BY source_id ORDER BY chunk_id) AS next FROM chunks)"


@q("joi2_neighbours", f"WITH {CHUNKS}, {NEIGHBOURS} SELECT chunk_id, previous, next FROM beside")
def joi2(spark, d):
    return neighbours(spark, d).select("chunk_id", "previous", "next")


@q(
    "joi2_context_of_the_best",
    f"""{CAPPED}, {NEIGHBOURS}, near AS (SELECT query_id, unnest([previous, next]) AS chunk_id FROM capped JOIN beside ON capped.id = beside.chunk_id WHERE place <= 5)
    SELECT DISTINCT query_id, chunk_id FROM near WHERE chunk_id IS NOT NULL AND (query_id, chunk_id) NOT IN (SELECT query_id, id FROM capped)""",
)
def context(spark, d):
    hits = cut(capped(spark, d).select("query_id", F.col("id").alias("chunk_id"), "place"))
    near = hits.where("place <= 5").join(neighbours(spark, d), "chunk_id").select("query_id", F.explode(F.array("previous", "next")).alias("chunk_id")).where("chunk_id is not null")
    return near.join(hits, ["query_id", "chunk_id"], "left_anti").distinct()


_REF = "(Section|Regulation|Rule|Clause)"


@q(
    "joi3_cross_references",
    f"""WITH {CHUNKS}, named AS (SELECT DISTINCT source_id, regexp_extract(section, 'IS (\\d+)', 1) AS no, chunk_id FROM chunks WHERE regexp_matches(section, 'IS \\d+')),
    cites AS (SELECT DISTINCT source_id, chunk_id AS citing, unnest(list_distinct(regexp_extract_all(text, 'IS (\\d+)', 1))) AS no FROM chunks WHERE text IS NOT NULL AND NOT regexp_matches(section, 'IS \\d+'))
    SELECT n.chunk_id, c.citing FROM named n JOIN cites c USING (source_id, no) WHERE n.chunk_id <> c.citing""",
)
def joi3(spark, d):
    """Chunks whose section names a standard, and the chunks of the same source that cite it elsewhere: an equi-join on (source, number)."""
    c = chunks(spark, d)
    named = c.where(F.col("section").rlike(r"IS \d+")).select("source_id", "chunk_id", F.regexp_extract("section", r"IS (\d+)", 1).alias("no"))
    cites = c.where(F.col("text").isNotNull() & ~F.col("section").rlike(r"IS \d+")).select("source_id", F.col("chunk_id").alias("citing"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"IS (\d+)"), F.lit(1)))).alias("no"))
    return named.join(cites, ["source_id", "no"]).where("chunk_id != citing").select("chunk_id", "citing")


@q(
    "joi3_references_of_hits",
    f"""{WITH}, {sql_top('best', 'whole', 5)}, h AS (SELECT DISTINCT query_id, id, source_id, unnest(list_distinct(regexp_extract_all(text, 'IS (\\d+)', 1))) AS no FROM best JOIN chunks ON id = chunk_id),
    n AS (SELECT chunk_id AS other, source_id, regexp_extract(section, 'IS (\\d+)', 1) AS no, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS have FROM chunks WHERE text IS NOT NULL AND regexp_matches(section, 'IS \\d+')),
    m AS (SELECT DISTINCT query_id, id, other, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), have)) AS shared FROM h JOIN n USING (source_id, no) JOIN asked USING (query_id) WHERE id <> other)
    SELECT query_id, id AS chunk_id, other, CAST(shared AS INT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY shared DESC, other) AS k FROM m) WHERE k <= 2""",
)
def joi3_hits(spark, d):
    """Of each query's best five chunks the two passages of the same source that treat of a standard they cite and share most words with the
    question. The hits are a bounded list for each query, so a hot source gives no pairs of its chunks with each other."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"IS (\d+)"), F.lit(1)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    c = chunks(spark, d).where("text is not null")
    top5 = cut(best(spark, d, 5).join(asked(spark, d), "query_id").select("query_id", "id", words("question").alias("asked")))
    h = cut(c.select(F.col("chunk_id").alias("id"), "source_id", F.explode(numbers).alias("no")).join(broadcast_if_small(top5), "id"))
    n = c.where(F.col("section").rlike(r"IS \d+")).select(F.col("chunk_id").alias("other"), "source_id", F.regexp_extract("section", r"IS (\d+)", 1).alias("no"), words("text").alias("have"))
    m = n.join(broadcast_if_small(h), ["source_id", "no"]).where("id != other").select("query_id", "id", "other", F.size(F.array_intersect("asked", "have")).alias("shared")).distinct()
    k = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("shared"), "other"))
    return m.withColumn("k", k).where("k <= 2").select("query_id", F.col("id").alias("chunk_id"), "other", "shared")


_Q = "vec_id % 50 = 0"


@q(
    "top2_nearest_vectors",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.{_Q} AND a.vec_id <> b.vec_id),
    {sql_top('best', 's', 20)} SELECT query_id, id AS vec_id, round(score, 6) AS score FROM best""",
)
def top2(spark, d):
    e = table(spark, d, "embeddings").withColumn("own", F.col("vec_id"))
    asks = e.where(_Q).withColumn("query_id", F.col("vec_id"))
    return vectors.nearest(e, asks, "vec_id", "embedding", 20, label="own").select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@q(
    "joi12_similar_from_other_labels",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.{_Q} AND a.label <> b.label),
    {sql_top('best', '(SELECT * FROM s WHERE score >= 0.1)', 3)} SELECT query_id, id AS vec_id, round(score, 6) AS score FROM best""",
)
def joi12(spark, d):
    e = table(spark, d, "embeddings")
    asks = e.where(_Q).withColumn("query_id", F.col("vec_id"))
    return vectors.nearest(e, asks, "vec_id", "embedding", 3, label="label", least=0.1).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@q("mth2_norms", "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS norm FROM embeddings")
def mth2(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"))


@q("mth2_label_centroids", "WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS x FROM embeddings) SELECT label, dim, round(avg(x::DOUBLE), 6) AS mean FROM u GROUP BY ALL")
def centroids(spark, d):
    t = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return t.groupBy("label", (F.col("p") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@q("fil19_empty_searches", f"{WITH}, m AS (SELECT query_id, max(score) AS best FROM whole GROUP BY query_id) SELECT query_id, round(coalesce(best, 0), 5) AS best, coalesce(best, 0) < 0.003 AS empty FROM asked LEFT JOIN m USING (query_id)")
def fil19(spark, d):
    m = best(spark, d, 1).select("query_id", F.col("score").alias("best"))
    return asked(spark, d).select("query_id").join(m, "query_id", "left").select("query_id", F.round(F.coalesce("best", F.lit(0.0)), 5).alias("best"), (F.coalesce("best", F.lit(0.0)) < 0.003).alias("empty"))


@q(
    "agg18_best_windows",
    f"""WITH {CHUNKS}, {ASKED}, {sql_bm25('whole', SQL_EMBED)}, {sql_top('best', 'whole', 3)}, c AS (SELECT b.query_id, b.id, question, text FROM best b JOIN chunks ON b.id = chunk_id JOIN asked USING (query_id)),
    w AS (SELECT query_id, id, question, text, unnest(CASE WHEN length(text) <= 300 THEN [0::BIGINT] ELSE range(0, length(text) - 150, 100) END) AS start FROM c),
    s AS (SELECT query_id, id, start, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(substr(text, start + 1, 300)), '[a-z0-9]+')))) AS shared FROM w)
    SELECT query_id, id AS chunk_id, arg_min(start, (-shared, start)) AS start, max(shared) AS shared FROM s GROUP BY ALL""",
)
def agg18(spark, d):
    """Of each of a query's best three chunks the window of 300 characters, every 100, that shares most words with the question."""
    top3 = best(spark, d, 3).select("query_id", F.col("id").alias("chunk_id"))
    c = top3.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(asked(spark, d), "query_id")
    n = F.length("text")
    starts = F.when(n <= 300, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 151, F.lit(100)))
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)))
    w = c.select("query_id", "chunk_id", words(F.col("question")).alias("asked"), "text", F.explode(starts).alias("start"))
    s = w.select("query_id", "chunk_id", F.col("start").cast("long").alias("start"), F.size(F.array_intersect("asked", words(F.substring(F.col("text"), F.col("start") + 1, F.lit(300))))).cast("long").alias("shared"))
    return s.groupBy("query_id", "chunk_id").agg(F.max(F.struct("shared", -F.col("start"))).alias("m")).select("query_id", "chunk_id", (-F.col("m.col2")).alias("start"), F.col("m.shared").alias("shared"))


@q("agg9_scores_of_all_matches", f"{WITH} SELECT query_id, count(*) AS matches, round(sum(score), 4) AS total FROM whole GROUP BY query_id")
def all_scores(spark, d):
    return lexical.totals(docs_of(spark, d), queries_of(spark, d)).select("query_id", "matches", F.round("total", 4).alias("total"))


@q("fil1_embedding_texts", f"WITH {CHUNKS} SELECT chunk_id, {SQL_EMBED} AS embed_text FROM chunks WHERE text IS NOT NULL")
def fil1(spark, d):
    c = chunks(spark, d).where("text is not null")
    return c.select("chunk_id", T.embed_text(F.col("title"), F.col("section"), F.col("text")).alias("embed_text"))


