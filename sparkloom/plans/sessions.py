"""Sessions and turns as keyed tables; event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import keyed
from sparkloom.plans.base import RESULTS, TURNS, results, turns
from sparkloom.plans.registry import Registry
from sparkloom.runtime import cut, table

REGISTRY = Registry()
q = REGISTRY.add


def sessions(spark, d):
    return table(spark, d, "sessions")


@q("joi20_session_list", f"WITH {TURNS} SELECT s.session_id, any_value(title) AS title, strftime(max(updated_at), '%Y-%m-%d %H:%M') AS updated, count(turn_no) AS turns FROM sessions s LEFT JOIN turn t ON lower(trim(s.session_id)) = t.session_id WHERE owner = 'owner0000hot' GROUP BY s.session_id")
def joi20(spark, d):
    """One owner's sessions with the number of their turns; turns are counted before the join, so a long session is no long join."""
    n = turns(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"))
    s = sessions(spark, d).where("owner = 'owner0000hot'").select("session_id", "title", "updated_at", F.lower(F.trim("session_id")).alias("key"))
    return s.join(n.withColumnRenamed("session_id", "key"), "key", "left").select("session_id", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"), F.coalesce("turns", F.lit(0)).alias("turns"))


@q("fil13_optional_owner", "SELECT owner, count(*) AS n FROM sessions WHERE CAST(NULL AS VARCHAR) IS NULL OR owner = CAST(NULL AS VARCHAR) GROUP BY owner")
def fil13(spark, d, owner: str | None = None):
    return sessions(spark, d).where(F.lit(owner).isNull() | (F.col("owner") == F.lit(owner))).groupBy("owner").agg(F.count("*").alias("n"))


@q("fil20_owned_turns", f"WITH {TURNS} SELECT session_id, turn_no FROM turn WHERE session_id IN (SELECT lower(trim(session_id)) FROM sessions WHERE owner = 'owner0000hot')")
def fil20(spark, d):
    own = sessions(spark, d).where("owner = 'owner0000hot'").select(F.lower(F.trim("session_id")).alias("session_id"))
    return turns(spark, d).join(own, "session_id", "left_semi").select("session_id", "turn_no")


@q("snk7_latest_per_key", "SELECT lower(trim(session_id)) AS session_id, turn_no, max(created_at) AS created_at, count(*) AS writes FROM turns WHERE session_id IS NOT NULL AND turn_no IS NOT NULL GROUP BY ALL")
def snk7(spark, d):
    """What a keyed upsert leaves: the last write of each key."""
    t = table(spark, d, "turns").where("session_id is not null and turn_no is not null")
    return keyed.latest(t.withColumn("session_id", F.lower(F.trim("session_id"))), ["session_id", "turn_no"], "created_at", ["created_at"], count="writes")


@q("snk8_kept_after_purge", f"WITH {TURNS}, cut AS (SELECT max(updated_at) - INTERVAL 30 DAY AS t FROM sessions) SELECT session_id, turn_no FROM turn WHERE session_id NOT IN (SELECT lower(trim(session_id)) FROM sessions, cut WHERE updated_at < t AND session_id IS NOT NULL)")
def snk8(spark, d):
    """Turns left when sessions untouched for 30 days before the newest are deleted with all that belongs to them."""
    s = sessions(spark, d)
    newest = s.agg((F.max("updated_at") - F.expr("interval 30 days")).alias("t"))
    old = s.crossJoin(F.broadcast(newest)).where("updated_at < t").select(F.lower(F.trim("session_id")).alias("session_id"))
    return keyed.without(turns(spark, d).select("session_id", "turn_no"), old, ["session_id"])


@q("agg17_next_numbers", f"WITH {TURNS} SELECT session_id, CAST(coalesce(max(turn_no), 0) + 1 AS INTEGER) AS next_no FROM turn GROUP BY session_id")
def agg17(spark, d):
    return keyed.next_numbers(turns(spark, d), "session_id", "turn_no").select("session_id", F.col("next_no").cast("int").alias("next_no"))


@q("win12_last_six_turns", f"WITH {TURNS} SELECT session_id, turn_no FROM (SELECT session_id, turn_no, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS k FROM turn) WHERE k <= 6")
def win12(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_no"))
    return turns(spark, d).select("session_id", "turn_no").withColumn("k", F.row_number().over(w)).where("k <= 6").drop("k")


@q("win13_titles", f"WITH {TURNS} SELECT session_id, substr(arg_min(text, turn_no), 1, 60) AS title FROM turn WHERE role = 'user' AND text IS NOT NULL GROUP BY session_id")
def win13(spark, d):
    return turns(spark, d).where("role = 'user' and text is not null").groupBy("session_id").agg(F.substring(F.min_by("text", "turn_no"), 1, 60).alias("title"))


@q("rul8_recalled_turns", f"WITH {TURNS} SELECT session_id, arg_min(text, turn_no) AS first_said, arg_max(text, turn_no) AS last_said, count(*) AS n FROM turn WHERE role = 'user' AND text IS NOT NULL GROUP BY session_id")
def rul8(spark, d):
    return turns(spark, d).where("role = 'user' and text is not null").groupBy("session_id").agg(F.min_by("text", "turn_no").alias("first_said"), F.max_by("text", "turn_no").alias("last_said"), F.count("*").alias("n"))


# Kinds of talk, the first that fits (fixed values).
_TALK = [("owner", r"\bwho (made|built|owns|created) (you|this)\b|किसने बनाया"), ("farewell", r"^\s*(bye|goodbye|see you)\b"), ("recall", r"\b(what did i|my (first|last|previous) question|did i (ask|say))\b"), ("refers_back", r"^\s*(it|that|this|these|those|the same)\b|\b(that|this) (one|product|standard)\b"), ("greeting", r"^\s*(hi|hello|hey|namaste|good (morning|evening))\b"), ("thanks", r"\b(thanks|thank you|dhanyavaad)\b"), ("follow_up", r"^\s*(and|what about|and what about)\b"), ("basic", r"^\s*(what (is|are|does)\b|define\b)")]


@q("fil16_kinds_of_talk", f"WITH {TURNS} SELECT session_id, turn_no, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in _TALK) + " ELSE 'question' END AS kind FROM turn WHERE text IS NOT NULL")
def fil16(spark, d):
    kind = None
    for name, p in _TALK:
        kind = F.when(F.lower("text").rlike(p), name) if kind is None else kind.when(F.lower("text").rlike(p), name)
    return turns(spark, d).where("text is not null").select("session_id", "turn_no", kind.otherwise("question").alias("kind"))


@q("fil21_answer_language", f"WITH {RESULTS} SELECT id, CASE WHEN regexp_matches(lower(question), '\\bin hindi\\b|हिंदी में') THEN 'hi' WHEN regexp_matches(lower(question), '\\bin english\\b') THEN 'en' WHEN regexp_matches(question, '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS lang FROM results WHERE question IS NOT NULL")
def fil21(spark, d):
    lang = F.when(F.lower("question").rlike(r"\bin hindi\b|हिंदी में"), "hi").when(F.lower("question").rlike(r"\bin english\b"), "en").when(F.col("question").rlike("[ऀ-ॿ]"), "hi").otherwise("en")
    return results(spark, d).where("question is not null").select("id", lang.alias("lang"))


@q("win17_throttled_events", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 2")
def win17(spark, d):
    return keyed.trailing_counts(table(spark, d, "events"), "user_id", "ts", 900).where("n >= 2").select("event_id")


@q(
    "agg12_latency_percentiles",
    """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, min(CASE WHEN k = CAST(ceil(0.95 * n) AS BIGINT) THEN value END) AS p95, min(CASE WHEN k = 1 + CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN value END) AS p95_round,
    round(avg(CASE WHEN k IN ((n + 1) // 2, n // 2 + 1) THEN value END), 6) AS p50 FROM e GROUP BY event_type""",
)
def agg12(spark, d):
    """The median and the 95th percentile by both definitions, the value of rank ceil(0.95 n) and that of rank 1 + round(0.95 (n - 1)), halves
    to even. Ranks come from counts per value, added up by blocks of values, so that no type is sorted in one task."""
    e = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("m"))
    e = cut(e.repartitionByRange("event_type", "value").withColumn("block", F.spark_partition_id()))
    per = e.groupBy("event_type", "block").agg(F.sum("m").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("event_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("event_type", "block", before.alias("before"), F.sum("held").over(Window.partitionBy("event_type")).alias("n"))
    inside = F.sum("m").over(Window.partitionBy("event_type", "block").orderBy("value"))
    r = e.withColumn("upto", inside).join(F.broadcast(per), ["event_type", "block"]).withColumn("upto", F.col("upto") + F.col("before"))
    of = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    n = F.col("n")
    p = r.groupBy("event_type").agg(of(F.ceil(0.95 * n)).alias("p95"), of(1 + F.bround(0.95 * (n - 1)).cast("long")).alias("p95_round"), of(F.expr("(n + 1) div 2")).alias("a"), of(F.expr("n div 2 + 1")).alias("b"))
    return p.select("event_type", "p95", "p95_round", F.round((F.col("a") + F.col("b")) / 2, 6).alias("p50"))


@q("agg11_means_of_what_is_there", f"WITH {RESULTS} SELECT type, count(*) AS n, count(facts) AS with_facts, round(avg(facts), 6) AS facts, round(avg(cite_valid), 6) AS cite_valid, round(avg(CASE WHEN hit5 THEN 1.0::DOUBLE WHEN NOT hit5 THEN 0 END), 6) AS hit_share FROM results GROUP BY type")
def agg11_nulls(spark, d):
    """Means and shares over the rows that have a value; null if none has."""
    r = results(spark, d)
    hit = F.avg(F.when(F.col("hit5"), 1.0).when(~F.col("hit5"), 0.0))
    return r.groupBy("type").agg(F.count("*").alias("n"), F.count("facts").alias("with_facts"), F.round(F.avg("facts"), 6).alias("facts"), F.round(F.avg("cite_valid"), 6).alias("cite_valid"), F.round(hit, 6).alias("hit_share"))


@q("joi24_customers_of_orders", "SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def joi24(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("agg11_means_and_shares", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM lineitem GROUP BY ALL")
def agg11(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), 6).alias("share"))


@q("joi22_before_and_after", "SELECT o_custkey, count(*) AS n, count(b.o_orderkey) AS earlier FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01') a LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY o_custkey) b ON a.o_custkey = b.k GROUP BY o_custkey")
def joi22(spark, d):
    o = table(spark, d, "orders")
    before = o.where("o_orderdate < timestamp_ntz'1995-01-01'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    return o.where("o_orderdate >= timestamp_ntz'1995-01-01'").join(before, "o_custkey", "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("first").alias("earlier"))
