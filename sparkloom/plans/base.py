"""Tables as the queries read them, and the same as common table expressions for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import cut, is_small, spread, table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once, as last downloaded.

    Few chunks come twice: their ids are found by a count of the ids alone, and only their rows are grouped; the others stay where the scan
    put them. Should the repeated ids be too many to send around, all rows are grouped by id.
    """
    t = spread(table(spark, sf_dir, "chunk").where("chunk_id is not null"))
    rest = [c for c in t.columns if c not in ("chunk_id", "date_downloaded")]

    def last(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("chunk_id").agg(F.max(F.struct("date_downloaded", *rest)).alias("r"))
        return best.select("chunk_id", *(F.col(f"r.{c}").alias(c) for c in t.columns if c != "chunk_id"))

    again = cut(t.groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    if not is_small(again):
        return last(t)
    again = F.broadcast(again)
    once = t.join(again, "chunk_id", "left_anti").select("chunk_id", *(c for c in t.columns if c != "chunk_id"))
    return once.unionByName(last(t.join(again, "chunk_id", "left_semi")))


def in_ranges(c: DataFrame, parts: int | None = None) -> DataFrame:
    """``c`` with ``block``: ranges of (source, chunk id) in string order, so that blocks and the rows in them have one order.

    The ranges are cut by a sample of the ids, so a large source spans many blocks. Written once, as another sample would cut otherwise.
    """
    by = ("source_id", "chunk_id")
    return cut((c.repartitionByRange(parts, *by) if parts else c.repartitionByRange(*by)).withColumn("block", F.spark_partition_id()))


CHUNKS = "chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY date_downloaded DESC) AS rn FROM chunk) WHERE rn = 1)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation row once."""
    t = table(spark, sf_dir, "results_quick").where("id is not null")
    return t.groupBy("id").agg(F.max(F.struct(*[c for c in t.columns if c != "id"])).alias("r")).select("id", "r.*")


RESULTS = "results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY answer DESC) AS rn FROM results_quick) WHERE rn = 1)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question): the questions whose number is divisible by 50; searches answer them against all rows."""
    r = table(spark, sf_dir, "results_quick").where("question is not null and cast(substring(id, 2) as bigint) % 50 = 0")
    return r.groupBy(F.col("id").alias("query_id")).agg(F.max("question").alias("question"))


ASKED = "asked AS (SELECT id AS query_id, max(question) AS question FROM results_quick WHERE question IS NOT NULL AND CAST(substr(id, 2) AS BIGINT) % 50 = 0 GROUP BY id)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a number, each (session, number) once, as last delivered."""
    t = table(spark, sf_dir, "turns").where("session_id is not null and turn_no is not null")
    keyed = t.withColumn("session_id", F.lower(F.trim("session_id"))).groupBy("session_id", "turn_no")
    return keyed.agg(F.max(F.struct("created_at", "role", "text", "intent", "citations_json")).alias("r")).select("session_id", "turn_no", "r.*")


TURNS = (
    "turn AS (SELECT session_id, turn_no, created_at, role, text, intent, citations_json FROM (SELECT lower(trim(session_id)) AS session_id, turn_no, created_at, role, text, intent, citations_json, "
    "row_number() OVER (PARTITION BY lower(trim(session_id)), turn_no ORDER BY created_at DESC NULLS LAST, role DESC NULLS LAST, text DESC NULLS LAST, intent DESC NULLS LAST, citations_json DESC NULLS LAST) AS rn FROM turns WHERE session_id IS NOT NULL AND turn_no IS NOT NULL) WHERE rn = 1)"
)


def sql_words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_replaced(expression: str, *pairs: tuple[str, str]) -> str:
    """Nested regexp_replace over all matches."""
    for p, r in pairs:
        quoted = p.replace("'", "''")
        expression = f"regexp_replace({expression}, '{quoted}', '{r}', 'g')"
    return expression
