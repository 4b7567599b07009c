"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.plans.base import ASKED, CHUNKS, RESULTS, TURNS, asked, chunks, results, sql_replaced, sql_words, turns
from sparkloom.plans.registry import Registry
from sparkloom.runtime import table

REGISTRY = Registry()
q = REGISTRY.add

SQL_IDS = lambda e: sql_replaced(f"lower({e})", *((p, r.replace("{1}", "\\1")) for p, r in T.ID_PATTERNS))
SQL_TOKENS = lambda e: f"[t FOR t IN regexp_extract_all({SQL_IDS(e)}, '{T.TOKEN}') IF t NOT IN ({sql_words(T.STOPWORDS)})]"
SQL_EMBED = "CASE WHEN coalesce(title, '') = '' AND coalesce(section, '') = '' THEN text ELSE concat_ws(' | ', nullif(title, ''), nullif(section, '')) || chr(10) || text END"


@q("str1_normalized_ids", f"WITH {ASKED} SELECT query_id, {SQL_IDS('question')} AS normal FROM asked")
def str1(spark, d):
    return asked(spark, d).select("query_id", T.normalize_ids(F.col("question")).alias("normal"))


@q("str2_token_counts", f"WITH {CHUNKS} SELECT chunk_id, len({SQL_TOKENS('text')}) AS n_tokens, coalesce(array_to_string({SQL_TOKENS('text')}[1:5], ' '), '') AS first_tokens FROM chunks WHERE text IS NOT NULL")
def str2(spark, d):
    t = chunks(spark, d).where("text is not null").select("chunk_id", T.tokens(F.col("text")).alias("t"))
    return t.select("chunk_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


_expansion = " || ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN ' {r}' ELSE '' END" for p, r in T.SYNONYMS)


@q("str3_expanded_queries", f"WITH {RESULTS} SELECT id, question || {_expansion} AS expanded FROM results WHERE question IS NOT NULL")
def str3(spark, d):
    return results(spark, d).where("question is not null").select("id", T.expanded(F.col("question")).alias("expanded"))


_STEM = (
    "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 5 AND regexp_matches(w, '(xes|ches|shes|sses)$') THEN regexp_replace(w, 'es$', '') "
    "WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|as)$') THEN regexp_replace(w, 's$', '') ELSE w END"
)


@q("str5_stems", f"WITH {CHUNKS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM chunks) SELECT w AS word, {_STEM} AS stem FROM words")
def str5(spark, d):
    words = chunks(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@q(
    "str6_languages",
    f"""WITH {CHUNKS}, n AS (SELECT chunk_id, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS hi, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM chunks WHERE text IS NOT NULL)
    SELECT chunk_id, CASE WHEN hi > 0.3 * greatest(hi + en, 1) THEN 'hi' ELSE 'en' END AS language FROM n""",
)
def str6(spark, d):
    return chunks(spark, d).where("text is not null").select("chunk_id", T.language(F.col("text")).alias("language"))


@q("str6_query_languages", f"WITH {RESULTS} SELECT id, CASE WHEN regexp_matches(question, '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS language FROM results WHERE question IS NOT NULL")
def str6b(spark, d):
    return results(spark, d).where("question is not null").select("id", F.when(F.col("question").rlike("[ऀ-ॿ]"), "hi").otherwise("en").alias("language"))


@q(
    "str7_garbled_hindi",
    f"""WITH {CHUNKS}, w AS (SELECT chunk_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS l FROM chunks WHERE text IS NOT NULL),
    n AS (SELECT chunk_id, len([x FOR x IN l IF regexp_matches(x, '[ऀ-ॿ]')]) AS words, len([x FOR x IN l IF regexp_matches(x, '^[ा-्]')]) AS signs FROM w)
    SELECT chunk_id, words, words >= 20 AND signs > 0.05 * words AS garbled FROM n WHERE words > 0""",
)
def str7(spark, d):
    words, signs = T.words_with_vowel_signs(F.col("text"))
    t = chunks(spark, d).where("text is not null").select("chunk_id", words.cast("long").alias("words"), signs.alias("signs"))
    return t.where("words > 0").select("chunk_id", "words", F.expr("words >= 20 and signs > 0.05 * words").alias("garbled"))


def _sql_clean(e: str) -> str:
    t = sql_replaced(e, ("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("[​﻿]+", " "), ("[‪-‮⁦-⁩]", ""), (r"([\p{L}\p{N}_])-\n\s*([\p{L}\p{N}_])", r"\1\2"))
    kept = f"array_to_string([s FOR s IN [regexp_replace(x, '\\s+$', '') FOR x IN string_split({t}, chr(10))] IF NOT regexp_matches(lower(s), '{T.MASTHEAD}')], chr(10))"
    return sql_replaced(kept, (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))


@q("str8_clean_pages", f"WITH {CHUNKS} SELECT chunk_id, {_sql_clean('text')} AS cleaned FROM chunks WHERE text IS NOT NULL")
def str8(spark, d):
    return chunks(spark, d).where("text is not null").select("chunk_id", T.clean_page(F.col("text")).alias("cleaned"))


@q(
    "str9_redacted_turns",
    f"WITH {TURNS}, said AS (SELECT session_id, turn_no, text || ' mail ' || session_id || '@x.example id 1234 5678 ' || lpad(CAST(turn_no AS VARCHAR), 4, '0') || ' tel 98765' || lpad(CAST(turn_no AS VARCHAR), 5, '0') AS s FROM turn WHERE text IS NOT NULL) "
    "SELECT session_id, turn_no, " + sql_replaced("s", (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+", "[email]"), (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[id number]"), (r"(^|\D)(?:\+?91[\s-]?)?[6-9]\d{9}(\D|$)", r"\1[phone]\2")) + " AS redacted FROM said",
)
def str9(spark, d):
    # The turns hold no personal data: some is added from their keys, so that the masks have something to do.
    no = F.col("turn_no").cast("string")
    s = F.concat("text", F.lit(" mail "), "session_id", F.lit("@x.example id 1234 5678 "), F.lpad(no, 4, "0"), F.lit(" tel 98765"), F.lpad(no, 5, "0"))
    return turns(spark, d).where("text is not null").select("session_id", "turn_no", T.redacted(s).alias("redacted"))


@q("str10_slugs", "SELECT DISTINCT title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM parsed WHERE title IS NOT NULL")
def str10(spark, d):
    return table(spark, d, "parsed").where("title is not null").select("title", T.slug(F.col("title")).alias("slug")).distinct()


_SENTENCES = (
    "[replace(x, chr(2), '.') FOR x IN string_split(regexp_replace(regexp_replace({e}, '\\b([Rr]s|No|S\\.O|e\\.g|i\\.e|viz|Sr)\\.', '\\1' || chr(2), 'g'), "
    "'([.!?।])\\s+([A-Z0-9\"''(*ऀ-ॿ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))]"
)


@q(
    "str11_sentences",
    f"WITH {CHUNKS}, s AS (SELECT chunk_id, {_SENTENCES.format(e='text')} AS l FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS sentence FROM s",
)
def str11(spark, d):
    t = chunks(spark, d).where("text is not null").select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "sentence"))
    return t.select("chunk_id", (F.col("no") + 1).cast("long").alias("no"), "sentence")


_WORDMAP = "CASE w " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in T.NUMBER_WORDS.items()) + " END"
SQL_UNCITED = lambda e: f"regexp_replace(lower({e}), '\\[\\d+\\]', ' ', 'g')"
SQL_NUMBERS = lambda e: f"list_sort(list_distinct(list_concat([replace(x, ',', '') FOR x IN regexp_extract_all({SQL_UNCITED(e)}, '\\d[\\d,]*(?:\\.\\d+)?')], [{_WORDMAP} FOR w IN regexp_extract_all({SQL_UNCITED(e)}, '[a-z]+') IF {_WORDMAP} IS NOT NULL])))"


@q("str12_numbers", f"WITH {RESULTS} SELECT id, array_to_string({SQL_NUMBERS('answer')}, ' ') AS numbers FROM results WHERE answer IS NOT NULL")
def str12(spark, d):
    return results(spark, d).where("answer is not null").select("id", F.array_join(F.array_sort(T.numbers(F.col("answer"))), " ").alias("numbers"))


def _sql_quantities(e: str) -> str:
    t = SQL_UNCITED(e)
    for w, n in T.NUMBER_WORDS.items():
        t = f"regexp_replace({t}, '\\b{w}\\b', '{n}', 'g')"
    found = f"regexp_extract_all({t}, '\\d[\\d,]*\\s*(?:\\(\\s*\\d+\\s*\\)\\s*)?{T.UNITS}')"
    unit = f"replace(regexp_replace(regexp_extract(x, '{T.UNITS}$', 1), 's+$', ''), 'working day', 'day')"
    return f"list_sort(list_distinct([replace(regexp_extract(x, '^(\\d[\\d,]*)', 1), ',', '') || ' ' || {unit} FOR x IN {found}]))"


@q("str13_quantities", f"WITH {RESULTS} SELECT id, array_to_string({_sql_quantities('answer')}, '; ') AS quantities FROM results WHERE answer IS NOT NULL")
def str13(spark, d):
    return results(spark, d).where("answer is not null").select("id", F.array_join(F.array_sort(T.quantities(F.col("answer"))), "; ").alias("quantities"))


@q(
    "str14_numbers_supported",
    f"""WITH {RESULTS}, n AS (SELECT id, {SQL_NUMBERS('question')} AS a, {SQL_NUMBERS('answer')} AS b, {_sql_quantities('question')} AS c, {_sql_quantities('answer')} AS e FROM results WHERE question IS NOT NULL AND answer IS NOT NULL)
    SELECT id, len([x FOR x IN a IF NOT list_contains(b, x)]) = 0 AND len([x FOR x IN c IF NOT list_contains(e, x)]) = 0 AS supported FROM n""",
)
def str14(spark, d):
    missing = lambda f: F.size(F.array_except(f(F.col("question")), f(F.col("answer"))))
    t = results(spark, d).where("question is not null and answer is not null")
    return t.select("id", ((missing(T.numbers) == 0) & (missing(T.quantities) == 0)).alias("supported"))


@q(
    "str16_cleaned_output",
    f"WITH {RESULTS} SELECT id, trim(" + sql_replaced("answer", (r"(?s)<think>.*?</think>", ""), (r"【(\d+)[^】]*】", r"[\1]"), (r"\[\^(\d+)\]", r"[\1]"), (r"\[[Ee]xcerpt (\d+)\]", r"[\1]")) + ") AS cleaned FROM results WHERE answer IS NOT NULL",
)
def str16(spark, d):
    return results(spark, d).where("answer is not null").select("id", T.cleaned_output(F.col("answer")).alias("cleaned"))


@q(
    "str22_order_numbers",
    f"""WITH {CHUNKS} SELECT chunk_id, regexp_extract(text, '(?:S\\.O\\.|G\\.S\\.R\\.) ?\\d+ ?\\(E\\)') AS order_number, regexp_extract(text, 'IS (\\d+)', 1) AS is_number FROM chunks WHERE text IS NOT NULL""",
)
def str22(spark, d):
    t = chunks(spark, d).where("text is not null")
    return t.select("chunk_id", F.regexp_extract("text", r"(?:S\.O\.|G\.S\.R\.) ?\d+ ?\(E\)", 0).alias("order_number"), F.regexp_extract("text", r"IS (\d+)", 1).alias("is_number"))


SQL_NAME_WORDS = lambda e: f"list_distinct([regexp_replace(w, 's+$', '') FOR w IN regexp_extract_all(lower({e}), '[a-z0-9]+') IF w NOT IN ({sql_words(T.STOPWORDS)}) AND length(w) > 2])"


@q("str23_name_words", f"SELECT p_partkey, array_to_string(list_sort({SQL_NAME_WORDS('p_name')}), ' ') AS words FROM part")
def str23(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.name_words(F.col("p_name"))), " ").alias("words"))


@q(
    "str24_question_parts",
    f"""WITH {RESULTS}, p AS (SELECT id, unnest(string_split(regexp_replace(question, '([?.!])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part FROM results WHERE question IS NOT NULL),
    c AS (SELECT id, regexp_replace(trim(part), '^(?i)(additionally|also|and|further(more)?|moreover)[,\\s]+', '') AS part FROM p),
    k AS (SELECT id, part, count(*) OVER (PARTITION BY id) AS n FROM c WHERE len(string_split(regexp_replace(trim(part), '\\s+', ' ', 'g'), ' ')) >= 5) SELECT id, part FROM k WHERE n >= 2""",
)
def str24(spark, d):
    marked = F.regexp_replace("question", r"([?.!])\s+", "$1\x01")
    part = F.transform(F.split(marked, "\x01"), lambda p: F.regexp_replace(F.trim(p), r"^(?i)(additionally|also|and|further(more)?|moreover)[,\s]+", ""))
    long = F.filter(part, lambda p: F.size(F.split(F.regexp_replace(F.trim(p), r"\s+", " "), " ")) >= 5)
    return results(spark, d).where("question is not null").select("id", long.alias("parts")).where("size(parts) >= 2").select("id", F.explode("parts").alias("part"))


def _sql_fact(e: str) -> str:
    t = f"lower({e})"
    for w, n in T.FACT_WORDS.items():
        t = f"regexp_replace({t}, '\\b{w}\\b', '{n}', 'g')"
    return sql_replaced(t, (r"[\s,.\-]", ""), ("₹", "rs"))


@q("str25_fact_forms", f"WITH {RESULTS} SELECT id, {_sql_fact('expected')} AS fact FROM results WHERE expected IS NOT NULL")
def str25(spark, d):
    return results(spark, d).where("expected is not null").select("id", T.fact_form(F.col("expected")).alias("fact"))


@q("str28_token_estimates", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def str28(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@q("str29_snippets", f"WITH {CHUNKS} SELECT chunk_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS snippet FROM chunks WHERE text IS NOT NULL")
def str29(spark, d):
    return chunks(spark, d).where("text is not null").select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@q(
    "str30_excerpt_labels",
    f"""WITH {CHUNKS} SELECT chunk_id, concat_ws(' | ', title, 'scheme: ' || nullif(scheme, ''), nullif(section, ''), 'page ' || CAST(page AS VARCHAR), nullif(doc_date, '')) AS label FROM chunks""",
)
def str30(spark, d):
    part = lambda c, before="": F.concat(F.lit(before), F.nullif(F.col(c), F.lit("")))
    label = F.concat_ws(" | ", "title", part("scheme", "scheme: "), part("section"), F.concat(F.lit("page "), F.col("page").cast("string")), part("doc_date"))
    return chunks(spark, d).select("chunk_id", label.alias("label"))


@q(
    "str31_without_sources",
    f"""WITH {RESULTS} SELECT id, regexp_replace(string_split(regexp_replace(answer, '\\n\\s*(?:\\*\\*)?(?:Sources|स्रोत)(?:\\*\\*)?\\s*:?\\s*(?:\\*\\*)?\\s*\\n', chr(1), 'g'), chr(1))[1], '^\\s+|\\s+$', '', 'g') AS body FROM results WHERE answer IS NOT NULL""",
)
def str31(spark, d):
    return results(spark, d).where("answer is not null").select("id", T.without_sources(F.col("answer")).alias("body"))


@q(
    "str33_claims",
    f"""WITH {RESULTS}, l AS (SELECT id, unnest(string_split(answer, chr(10))) AS line FROM results WHERE answer IS NOT NULL),
    c AS (SELECT id, trim(regexp_replace(regexp_replace(line, '\\[\\d+\\]|\\*\\*|^\\s*[-*\\d.)]+\\s*|\\|', ' ', 'g'), '\\s+', ' ', 'g')) AS claim, list_distinct([CAST(x AS INTEGER) FOR x IN regexp_extract_all(line, '\\[(\\d+)\\]', 1)]) AS cited FROM l)
    SELECT DISTINCT id, claim, array_to_string(list_sort(cited), ',') AS cited FROM c WHERE length(claim) >= 25""",
)
def str33(spark, d):
    lines = results(spark, d).where("answer is not null").select("id", F.explode(F.split("answer", "\n")).alias("line"))
    claim = F.trim(F.regexp_replace(F.regexp_replace("line", r"\[\d+\]|\*\*|^\s*[-*\d.)]+\s*|\|", " "), r"\s+", " "))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    return lines.select("id", claim.alias("claim"), F.array_join(F.transform(cited, lambda x: x.cast("string")), ",").alias("cited")).where("length(claim) >= 25").distinct()


_D = T.DATE_PATTERNS
_MONTH = "list_position(['" + "', '".join(T.MONTHS) + "'], {})"
_dates = []
for _k, _p in enumerate(_D):
    _g = [f"regexp_extract(t, '{_p}', {i})" for i in range(4)]
    _day, _mon, _yr = ((_g[1], _MONTH.format(f"substr({_g[2]}, 1, 3)"), _g[3]), (_g[2], _MONTH.format(f"substr({_g[1]}, 1, 3)"), _g[3]), (_g[1], _g[2], _g[3]))[_k]
    _dates.append(
        f"SELECT chunk_id, instr(t, {_g[0]}) AS pos, TRY_CAST({_yr} AS INTEGER) AS y, TRY_CAST({_mon} AS INTEGER) AS m, TRY_CAST({_day} AS INTEGER) AS dd FROM lowered WHERE {_g[0]} <> ''"
    )


@q(
    "dat1_first_dates",
    f"""WITH {CHUNKS}, lowered AS (SELECT chunk_id, lower(substr(text, 1, 6000)) AS t FROM chunks WHERE text IS NOT NULL), found AS ({' UNION ALL '.join(_dates)}),
    ok AS (SELECT chunk_id, pos, lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS date FROM found WHERE y BETWEEN 1950 AND 2030 AND m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31)
    SELECT chunk_id, arg_min(date, pos) AS first_date FROM ok GROUP BY chunk_id""",
)
def dat1(spark, d):
    return chunks(spark, d).where("text is not null").select("chunk_id", T.first_date(F.col("text")).alias("first_date")).where("first_date is not null")


@q("dat2_title_years", "SELECT DISTINCT title, regexp_extract_all(title, '\\b(19[5-9]\\d|20[0-3]\\d)\\b')[-1] AS year FROM parsed WHERE title IS NOT NULL")
def dat2(spark, d):
    years = F.regexp_extract_all("title", F.lit(r"\b(19[5-9]\d|20[0-3]\d)\b"), F.lit(1))
    return table(spark, d, "parsed").where("title is not null").select("title", F.try_element_at(years, F.lit(-1)).alias("year")).distinct()


@q("dat3_epochs", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def dat3(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_timestamp(ts).alias("epoch"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"))


@q(
    "url1_addresses",
    """SELECT DISTINCT url, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^www\\.', '') AS host, regexp_extract(url, '([^/]+?)(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1) AS stem,
    regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.pdf$') AS is_pdf FROM download WHERE url IS NOT NULL""",
)
def url1(spark, d):
    return (
        table(spark, d, "download")
        .where("url is not null")
        .select(
            "url",
            F.regexp_replace(F.regexp_extract(F.lower("url"), r"^https?://([^/?#]+)", 1), r"^www\.", "").alias("host"),
            F.regexp_extract("url", r"([^/]+?)(?:\.[a-z]+)?/?(?:[?#].*)?$", 1).alias("stem"),
            F.lower(F.regexp_replace("url", "[?#].*$", "")).rlike(r"\.pdf$").alias("is_pdf"),
        )
        .distinct()
    )


@q("hsh1_text_digests", "SELECT doc_id, sha256('model:' || text) AS cache_key, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def hsh1(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.concat(F.lit("model:"), "text"), 256).alias("cache_key"), F.md5("text").alias("md5"))


@q("jsn1_event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def jsn1(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@q("jsn1_citations", f"WITH {TURNS} SELECT session_id, turn_no, CAST(json_array_length(citations_json) AS BIGINT) AS n, json_extract_string(citations_json, '$[0].source_id') AS first_source FROM turn WHERE json_valid(citations_json)")
def jsn1b(spark, d):
    t = turns(spark, d).withColumn("c", F.from_json("citations_json", "array<struct<n:int,source_id:string,page:int>>"))
    return t.where("c is not null").select("session_id", "turn_no", F.size("c").cast("long").alias("n"), F.expr("try_element_at(c, 1).source_id").alias("first_source"))


@q("map1_defaults", "SELECT DISTINCT label, coalesce(map_extract_value(MAP {0: 'zero', 1: 'one', 2: 'two'}, label), 'other') AS name FROM embeddings WHERE label IS NOT NULL")
def map1(spark, d):
    names = F.create_map(*(F.lit(x) for pair in ((0, "zero"), (1, "one"), (2, "two")) for x in pair))
    return table(spark, d, "embeddings").where("label is not null").select("label", F.coalesce(F.try_element_at(names, F.col("label")), F.lit("other")).alias("name")).distinct()


@q("mth1_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 10)), 6) AS p FROM events WHERE value IS NOT NULL")
def mth1(spark, d):
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(1 / (1 + F.exp(-F.col("value") / 10)), 6).alias("p"))


@q("mth3_clipped_logs", "SELECT l_orderkey, l_linenumber, round(least(greatest(ln(l_extendedprice), 7), 10), 6) AS clipped FROM lineitem WHERE l_extendedprice > 0")
def mth3(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > 0").select("l_orderkey", "l_linenumber", F.round(F.least(F.greatest(F.ln("l_extendedprice"), F.lit(7.0)), F.lit(10.0)), 6).alias("clipped"))
