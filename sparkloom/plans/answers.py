"""Answers: citations, claims against excerpts, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import citations
from sparkloom.plans.base import CHUNKS, RESULTS, chunks, results
from sparkloom.plans.registry import Registry
from sparkloom.plans.scalars import _sql_fact

REGISTRY = Registry()
q = REGISTRY.add



@q(
    "str15_single_markers",
    f"""WITH {RESULTS} SELECT id, regexp_replace(answer, '\\s+', ' ', 'g') || ' [1][' || CAST(length(question) % 5 + 2 AS VARCHAR) || '] and ' || array_to_string(['[' || CAST(x AS VARCHAR) || ']' FOR x IN range(2, length(question) % 4 + 4)], '') AS single FROM results WHERE answer IS NOT NULL AND question IS NOT NULL""",
)
def str15(spark, d):
    written = F.concat(F.regexp_replace("answer", r"\s+", " "), F.lit(" [1, "), (F.length("question") % 5 + 2).cast("string"), F.lit("] and [2-"), (F.length("question") % 4 + 3).cast("string"), F.lit("]"))
    r = results(spark, d).where("answer is not null and question is not null")
    return citations.single_markers(r.select("id", written.alias("written")), "id", "written").withColumnRenamed("written", "single")


_MARKS = "marks AS (SELECT id, unnest(range(1, len(m) + 1)) AS pos, unnest(m) AS n FROM (SELECT id, [CAST(x AS INTEGER) FOR x IN regexp_extract_all(answer, '\\[(\\d+)\\]', 1)] AS m FROM results WHERE answer IS NOT NULL))"


@q("win9_renumbered_citations", f"WITH {RESULTS}, {_MARKS}, f AS (SELECT id, n, min(pos) AS first FROM marks WHERE n BETWEEN 1 AND 9 GROUP BY id, n) SELECT id, n, dense_rank() OVER (PARTITION BY id ORDER BY first) AS new_n FROM f")
def win9(spark, d):
    return citations.renumbered(citations.markers(results(spark, d), "id", "answer").where("n between 1 and 9"), "id").select("id", "n", F.col("new_n").cast("long").alias("new_n"))


@q("agg10_sources_used", f"WITH {RESULTS}, {_MARKS} SELECT id, count(DISTINCT n) AS cited FROM marks GROUP BY id")
def agg10(spark, d):
    return citations.markers(results(spark, d), "id", "answer").groupBy("id").agg(F.count_distinct("n").alias("cited"))


_TOP = "tops AS (SELECT id, unnest(range(1, len(top5) + 1)) AS n, unnest(top5) AS chunk_id FROM results)"


@q(
    "win10_merged_citations",
    f"WITH {RESULTS}, {CHUNKS}, {_TOP}, k AS (SELECT id, n, CASE WHEN contains(t.chunk_id, '::row') THEN t.chunk_id ELSE source_id || '#' || coalesce(CAST(page AS VARCHAR), '') END AS key FROM tops t JOIN chunks c ON t.chunk_id = c.chunk_id) SELECT id, n, min(n) OVER (PARTITION BY id, key) AS merged FROM k",
)
def win10(spark, d):
    """Excerpts of the same document and page take the first one's number."""
    t = results(spark, d).select("id", F.posexplode("top5").alias("p", "chunk_id")).select("id", (F.col("p") + 1).cast("long").alias("n"), "chunk_id")
    place = chunks(spark, d).select("chunk_id", "source_id", "page")
    key = F.when(F.contains("chunk_id", F.lit("::row")), F.col("chunk_id")).otherwise(F.concat("source_id", F.lit("#"), F.coalesce(F.col("page").cast("string"), F.lit(""))))
    return t.join(place, "chunk_id").withColumn("key", key).select("id", "n", F.min("n").over(Window.partitionBy("id", "key")).alias("merged"))


@q("joi1_excerpts_by_id", f"WITH {RESULTS}, {CHUNKS}, {_TOP} SELECT id, n, t.chunk_id, title, page FROM tops t JOIN chunks c ON t.chunk_id = c.chunk_id")
def joi1(spark, d):
    t = results(spark, d).select("id", F.posexplode("top5").alias("p", "chunk_id")).select("id", (F.col("p") + 1).cast("long").alias("n"), "chunk_id")
    return t.join(chunks(spark, d).select("chunk_id", "title", "page"), "chunk_id").select("id", "n", "chunk_id", "title", "page")


_ADVICE = citations.ADVICE.replace("'", "''")


@q(
    "fil17_lines_to_cite",
    f"""WITH {RESULTS}, l AS (SELECT id, unnest(range(1, len(string_split(answer, chr(10))) + 1)) AS line_no, unnest(string_split(answer, chr(10))) AS line FROM results WHERE answer IS NOT NULL),
    c AS (SELECT id, line_no, trim(line) AS shown, length(trim(regexp_replace(regexp_replace(line, '\\[\\d+\\]|\\*\\*|^\\s*[-*\\d.)]+\\s*|\\|', ' ', 'g'), '\\s+', ' ', 'g'))) AS claim,
    regexp_replace(regexp_replace(trim(line), '^\\s*([-*•]|\\d+[.)]|[a-z][.)])\\s*', ''), '^\\*\\*[^*]{{1,60}}\\*\\*\\s*[:–-]?\\s*', '') AS said FROM l),
    k AS (SELECT id, line_no, CASE WHEN regexp_matches(shown, '^\\|?\\s*:?-{{3,}}') THEN 'rule' WHEN claim < 25 THEN 'short' WHEN regexp_full_match(shown, '#+\\s.*|(\\d+\\.\\s+)?\\*\\*[^*]+\\*\\*:?') OR (ends_with(shown, ':') AND length(shown) < 80) THEN 'heading'
      WHEN regexp_matches(lower(said), '^({_ADVICE})\\b') AND NOT regexp_matches(said, '\\d') THEN 'advice'
      WHEN regexp_matches(said, 'https?://') AND len([w FOR w IN regexp_split_to_array(regexp_replace(said, 'https?://\\S+', '', 'g'), '\\s+') IF w <> '']) < 12 THEN 'link' END AS exempt FROM c)
    SELECT id, line_no, exempt IS NULL AS needs, exempt FROM k""",
)
def fil17(spark, d):
    return citations.lines_to_cite(results(spark, d), "id", "answer")


_COVER = """WITH {r}, {c}, cl AS (SELECT id, k, claim, list_distinct([w FOR w IN regexp_extract_all(lower(claim), '[a-z0-9]+') IF w NOT IN ('the','a','an','of','to','and','or','in','on','for','with','is','are','be','by','from','your','you','if','as','at','this','that','its','it','any','within','under')]) AS words
    FROM (SELECT id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS claim FROM (SELECT id, [x FOR x IN string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF length(x) >= 25] AS s FROM results WHERE answer IS NOT NULL))),
    ex AS (SELECT id, n, list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(section, '') || ' ' || text), '[a-z0-9]+')) AS have, text FROM (SELECT id, unnest(range(1, len(top5) + 1)) AS n, unnest(top5) AS chunk_id FROM results) t JOIN chunks USING (chunk_id) WHERE text IS NOT NULL),
    cov AS (SELECT id, k, n, CAST(len([w FOR w IN words IF list_contains(have, w)]) AS DOUBLE) / len(words) AS covered FROM cl JOIN ex USING (id) WHERE len(words) > 0)"""
COVERED = _COVER.format(r=RESULTS, c=CHUNKS)


@q("joi23_claims_and_excerpts", f"{COVERED} SELECT id, k, n, round(covered, 6) AS covered FROM cov")
def joi23(spark, d):
    return citations.coverage(results(spark, d), chunks(spark, d)).select("id", "k", "n", F.round("covered", 6).alias("covered"))


@q(
    "joi23_two_passes",
    f"""{COVERED}, num AS (SELECT id, k, n, len([w FOR w IN words IF list_contains(have, w)]) AS shared, len(words) AS size, contains(claim, '[' || n || ']') AS cited,
      len([x FOR x IN list_distinct(regexp_extract_all(claim, '\\d+')) IF NOT list_contains(regexp_extract_all(text, '\\d+'), x)]) AS missing FROM cl JOIN ex USING (id) WHERE len(words) > 0),
    passes AS (SELECT id, k, n, shared, size, 1 AS pass FROM num WHERE cited
      UNION ALL SELECT id, k, n, shared, size, 2 FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY shared DESC, n) AS r FROM num WHERE NOT cited AND missing = 0) WHERE r <= 6)
    SELECT id, k, n, CAST(pass AS INT) AS pass, round(CAST(shared AS DOUBLE) / size, 6) AS covered FROM passes""",
)
def joi23_passes(spark, d):
    """Claims against the excerpts they cite, then against up to six others that have all their numbers, by shared words."""
    c = citations.coverage(results(spark, d), chunks(spark, d), numbers=True)
    one = c.where("cited").withColumn("pass", F.lit(1))
    best = F.row_number().over(Window.partitionBy("id", "k").orderBy(F.desc("shared"), "n"))
    two = c.where("not cited and missing = 0").withColumn("r", best).where("r <= 6").drop("r").withColumn("pass", F.lit(2))
    return one.unionByName(two).select("id", "k", "n", "pass", F.round("covered", 6).alias("covered"))


@q("rul10_citation_decisions", f"{COVERED} SELECT id, k, round(max(covered), 6) AS best, CASE WHEN max(covered) >= 0.6 THEN 'keep' WHEN max(covered) >= 0.3 THEN 'check' ELSE 'remove' END AS decision, arg_min(n, (-round(covered, 9), n)) AS excerpt FROM cov GROUP BY id, k")
def rul10(spark, d):
    c = citations.coverage(results(spark, d), chunks(spark, d)).groupBy("id", "k").agg(F.max("covered").alias("b"), F.max(F.struct(F.round("covered", 9), -F.col("n"))).alias("m"))
    decision = F.when(F.col("b") >= 0.6, "keep").when(F.col("b") >= 0.3, "check").otherwise("remove")
    return c.select("id", "k", F.round("b", 6).alias("best"), decision.alias("decision"), (-F.col("m.col2")).alias("excerpt"))


@q("fil22_refusals", f"WITH {RESULTS} SELECT id, starts_with(answer, 'NOT_COVERED') OR NOT regexp_matches(answer, '\\[\\d+\\]') AS uncited FROM results WHERE answer IS NOT NULL")
def fil22(spark, d):
    return results(spark, d).where("answer is not null").select("id", (F.col("answer").startswith("NOT_COVERED") | ~F.col("answer").rlike(r"\[\d+\]")).alias("uncited"))


@q("win14_renumbered_lists", f"WITH {RESULTS}, l AS (SELECT id, unnest(range(1, len(string_split(answer, chr(10))) + 1)) AS line_no, unnest(string_split(answer, chr(10))) AS line FROM results WHERE answer IS NOT NULL), g AS (SELECT *, regexp_matches(line, '^\\s*[-*]\\s') AS item, sum(CASE WHEN regexp_matches(line, '^\\s*[-*]\\s') OR trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY line_no) AS grp FROM l) SELECT id, line_no, row_number() OVER (PARTITION BY id, grp ORDER BY line_no) AS number FROM g WHERE item")
def win14(spark, d):
    """List items numbered anew, from 1 behind each paragraph."""
    return citations.numbered_items(results(spark, d), "id", "answer")


@q("agg14_key_facts", f"WITH {RESULTS}, n AS (SELECT id, {_sql_fact('answer')} AS a, [f FOR f IN [{_sql_fact('x')} FOR x IN string_split(expected, ' ')] IF length(f) > 3] AS facts FROM results WHERE expected IS NOT NULL AND answer IS NOT NULL) SELECT id, round(CAST(len([f FOR f IN facts IF contains(a, f)]) AS DOUBLE) / len(facts), 6) AS share FROM n WHERE len(facts) > 0")
def agg14(spark, d):
    facts = F.filter(F.transform(F.split("expected", " "), T.fact_form), lambda f: F.length(f) > 3)
    n = results(spark, d).where("expected is not null and answer is not null").select("id", T.fact_form(F.col("answer")).alias("a"), facts.alias("facts")).where("size(facts) > 0")
    return n.select("id", F.round(F.expr("size(filter(facts, f -> contains(a, f))) / size(facts)"), 6).alias("share"))


@q("agg15_citation_validity", f"WITH {RESULTS} SELECT type, round(CAST(sum(claims_checked - len(changed)) AS DOUBLE) / nullif(sum(claims_checked), 0), 6) AS micro, round(avg(CAST(claims_checked - len(changed) AS DOUBLE) / nullif(claims_checked, 0)), 6) AS macro FROM results GROUP BY type")
def agg15(spark, d):
    """Of all claims, and as the mean of the answers' shares: two figures that differ."""
    r = results(spark, d).withColumn("good", F.col("claims_checked") - F.when(F.col("changed").isNotNull(), F.size("changed")))
    return r.groupBy("type").agg(F.round(F.sum("good") / F.nullif(F.sum("claims_checked"), F.lit(0)), 6).alias("micro"), F.round(F.avg(F.col("good") / F.nullif(F.col("claims_checked"), F.lit(0))), 6).alias("macro"))


@q("agg16_answer_scores", f"WITH {RESULTS} SELECT id, CASE WHEN must_refuse THEN CASE WHEN refused THEN 10 ELSE 0 END::DOUBLE WHEN refused THEN 0::DOUBLE ELSE round(10 * list_avg([x FOR x IN [facts, cite_valid] IF x IS NOT NULL]), 4) END AS score FROM results WHERE must_refuse IS NOT NULL AND refused IS NOT NULL")
def agg16(spark, d):
    parts = F.expr("filter(array(facts, cite_valid), x -> x is not null)")
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))
    score = F.when(F.col("must_refuse"), F.when(F.col("refused"), 10.0).otherwise(0.0)).when(F.col("refused"), 0.0).otherwise(F.round(10 * mean, 4))
    return results(spark, d).where("must_refuse is not null and refused is not null").select("id", score.alias("score"))


@q("agg23_hit_shares", f"WITH {RESULTS} SELECT type, count(*) AS n, count(hit5) AS judged, round(avg(CASE WHEN hit5 THEN 1.0::DOUBLE WHEN NOT hit5 THEN 0 END), 6) AS hit5 FROM results GROUP BY type")
def agg23(spark, d):
    return results(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count("hit5").alias("judged"), F.round(F.avg(F.col("hit5").cast("int")), 6).alias("hit5"))


@q("joi21_expected_source_hit", f"WITH {RESULTS} SELECT id, len([x FOR x IN top5 IF starts_with(string_split(x, '::')[1], 'conformity') OR starts_with(string_split(x, '::')[1], 'licence')]) > 0 AS hit FROM results WHERE top5 IS NOT NULL")
def joi21(spark, d):
    hit = F.exists("top5", lambda x: F.exists(F.array(F.lit("conformity"), F.lit("licence")), lambda e: F.startswith(F.split(x, "::")[0], e)))
    return results(spark, d).where("top5 is not null").select("id", hit.alias("hit"))


@q("joi25_consistent_answers", f"WITH {RESULTS} SELECT question, count(*) AS runs, count(DISTINCT (refused, top5[1])) AS outcomes FROM results WHERE question IS NOT NULL GROUP BY question")
def joi25(spark, d):
    r = results(spark, d).where("question is not null")
    outcome = F.struct(F.coalesce(F.col("refused").cast("string"), F.lit("?")).alias("r"), F.coalesce(F.try_element_at("top5", F.lit(1)), F.lit("?")).alias("t"))
    return r.groupBy("question").agg(F.count("*").alias("runs"), F.count_distinct(outcome).alias("outcomes"))


@q("agg3_actions", f"WITH {RESULTS}, a AS (SELECT id, unnest(changed, recursive := true) FROM results) SELECT regexp_replace(action, '\\d+', '#', 'g') AS action, count(*) AS n, round(avg(score), 6) AS mean FROM a GROUP BY ALL")
def actions(spark, d):
    a = results(spark, d).select(F.explode("changed").alias("c")).select("c.*")
    return a.groupBy(F.regexp_replace("action", r"\d+", "#").alias("action")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


