"""The queries pN_ of the training-data problems, over their whole tables and with production parameters.

None has SQL: each is tested against brute force, an exact round trip or labelled cases in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import answers, conversations, language, mixing, pages, repeats, scans, spans, tokens
from sparkloom.plans.registry import Registry
from sparkloom.runtime import table

REGISTRY = Registry()


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.out_of_order(table(spark, sf_dir, "turns"))


@REGISTRY.add("p1_conversations")
def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "turns"))


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, sf_dir, "chunk"))


@REGISTRY.add("p2_text")
def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "chunk"))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.relabelled(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "lang_samples"))


@REGISTRY.add("p3_languages")
def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "lang_samples")).distinct()


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.surroundings(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "download"))


@REGISTRY.add("p4_text")
def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_bodies(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "download"))


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repairs(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "parsed"))


@REGISTRY.add("p5_text")
def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "parsed"))


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.defects(table(spark, sf_dir, "results_quick"), table(spark, sf_dir, "lang_samples"))


@REGISTRY.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@REGISTRY.add("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pairs_found(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p9_shared")
def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p9_text")
def p9_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_later(table(spark, sf_dir, "documents"), "doc_id", "text")
