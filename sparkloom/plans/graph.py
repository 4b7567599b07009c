"""The term graph and query expansion with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import terms
from sparkloom.plans.base import CHUNKS, chunks, results, sql_words
from sparkloom.plans.registry import Registry
from sparkloom.plans.scalars import _STEM
from sparkloom.runtime import cut

REGISTRY = Registry()
q = REGISTRY.add


def wins(spark, d):
    c = chunks(spark, d).where("text is not null and not contains(chunk_id, '::row') and coalesce(lang, '') != 'hi' and not startswith(source_id, 'qco_')")
    first = c.withColumn("key", T.letters_key(F.col("text"))).groupBy("key").agg(F.min(F.struct("chunk_id", "text")).alias("m"))
    return cut(terms.windows(first.select("m.*"), "chunk_id", F.col("text")))


WINS = f"""WITH {CHUNKS}, corpus AS (SELECT chunk_id, text FROM (SELECT chunk_id, text, row_number() OVER (PARTITION BY substr(regexp_replace(lower(text), '[^a-z]', '', 'g'), 1, 220) ORDER BY chunk_id) AS rn FROM chunks
    WHERE text IS NOT NULL AND NOT contains(chunk_id, '::row') AND coalesce(lang, '') <> 'hi' AND NOT starts_with(source_id, 'qco_')) WHERE rn = 1),
    ws AS (SELECT chunk_id, unnest(range(0, len(l))) AS p, unnest(l) AS term FROM (SELECT chunk_id, [{_STEM} FOR w IN regexp_extract_all(lower(text), '[a-z]{{4,}}') IF w NOT IN ({sql_words(T.STOPWORDS)})] AS l FROM corpus)),
    sized AS (SELECT chunk_id || ':' || CAST(p // 25 AS VARCHAR) AS win, term, count(*) OVER (PARTITION BY chunk_id, p // 25) AS size FROM ws), wins AS (SELECT DISTINCT win, term FROM sized WHERE size >= 10),
    total AS (SELECT count(DISTINCT win) AS n FROM wins), dfs AS (SELECT term, count(*) AS df FROM wins GROUP BY term), vocab AS (SELECT term, df FROM dfs, total WHERE df >= 3 AND df <= 0.08 * n)"""
ASSOC = f"""{WINS}, kept AS (SELECT win, term FROM wins JOIN vocab USING (term)), pair AS (SELECT x.term AS a, y.term AS b, count(*) AS co FROM kept x JOIN kept y ON x.win = y.win AND x.term <> y.term GROUP BY ALL),
    pmis AS (SELECT a, b, co, n, ln(co * n / (va.df * vb.df)) AS pmi FROM pair JOIN vocab va ON a = va.term JOIN vocab vb ON b = vb.term, total),
    assoc AS (SELECT a, b, co, CASE WHEN co >= 3 THEN pmi / -ln(co / n) ELSE 0 END::DOUBLE AS npmi, CASE WHEN co >= 2 THEN greatest(pmi, 0) ELSE 0 END::DOUBLE AS ppmi FROM pmis)"""


@q("agg5_document_frequencies", f"{WINS} SELECT term, df FROM vocab")
def agg5(spark, d):
    return terms.vocabulary(wins(spark, d))[0]


@q("agg6_co_occurrences", f"{ASSOC} SELECT a, b, co FROM assoc")
def agg6(spark, d):
    return terms.associations(wins(spark, d)).select("a", "b", "co")


@q("agg7_associations", f"{ASSOC} SELECT a, b, round(npmi, 5) AS npmi, round(ppmi, 5) AS ppmi FROM assoc")
def agg7(spark, d):
    return terms.associations(wins(spark, d)).select("a", "b", F.round("npmi", 5).alias("npmi"), F.round("ppmi", 5).alias("ppmi"))


RELATED = f"""{ASSOC}, sizes AS (SELECT a, sqrt(sum(ppmi * ppmi)) AS size FROM assoc WHERE ppmi > 0 GROUP BY a), unit AS (SELECT a, b AS c, ppmi / (size + 1e-9) AS v FROM assoc JOIN sizes USING (a) WHERE ppmi > 0),
    sims AS (SELECT x.a AS a, y.a AS b, sum(x.v * y.v) AS sim FROM unit x JOIN unit y USING (c) WHERE x.a <> y.a GROUP BY ALL),
    scored AS (SELECT coalesce(s.a, t.a) AS a, coalesce(s.b, t.b) AS b, 0.5 * coalesce(sim, 0) + 0.5 * least(greatest(coalesce(npmi, 0), 0), 1) AS score FROM sims s FULL JOIN assoc t ON s.a = t.a AND s.b = t.b),
    related AS (SELECT a AS term, b AS related, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS k FROM scored) WHERE k <= 8 AND score >= 0.15)"""


@q("joi14_related_terms", f"{RELATED} SELECT term, related, round(score, 4) AS score FROM related")
def joi14(spark, d):
    return terms.related(terms.associations(wins(spark, d))).select("term", "related", F.round("score", 4).alias("score"))


@q(
    "rul2_concept_terms",
    f"""{RELATED}, rq AS (SELECT id, max(question) AS question FROM results_quick WHERE question IS NOT NULL GROUP BY id), qt AS (SELECT DISTINCT id, {_STEM} AS term FROM (SELECT id, unnest(regexp_extract_all(lower(question), '[a-z]{{4,}}')) AS w FROM rq) WHERE w NOT IN ({sql_words(T.STOPWORDS)})),
    r AS (SELECT term, related, score, row_number() OVER (PARTITION BY term ORDER BY round(score, 6) DESC, related) AS k FROM related WHERE score >= 0.3),
    x AS (SELECT id, related, max(round(score, 4)) AS score FROM qt JOIN r USING (term) WHERE k <= 3 GROUP BY id, related) SELECT id, related, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, related) AS k FROM x) WHERE k <= 6""",
)
def rul2(spark, d):
    """Each question's words, and up to three neighbours of each in the term graph, six in all."""
    words = F.filter(F.regexp_extract_all(F.lower("question"), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(T.STOPWORDS))
    asks = results(spark, d).where("question is not null").select("id", F.explode(F.array_distinct(F.transform(words, T.stem))).alias("term"))
    graph = terms.related(terms.associations(wins(spark, d))).where("score >= 0.3")
    three = graph.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("score", 6)), "related"))).where("k <= 3")
    x = asks.join(three, "term").groupBy("id", "related").agg(F.max(F.round("score", 4)).alias("score"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "related"))).where("k <= 6").drop("k")
