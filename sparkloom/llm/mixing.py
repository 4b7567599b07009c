"""Mixing sources to target weights (problem 8).

The mix's size is the largest at which every source reaches its share without a document being used more often than allowed (or a size the
caller asks for; sources that fall short then say so). Each source's target over its tokens gives certain whole copies of all its documents
and a remainder, which is filled by Pareto order sampling: documents have unequal inclusion odds, proportional to a power of their size, and
are taken in the order of random odds divided by inclusion odds until the remainder is full.

The order needs no global sort and no window over a source: ranks are cut into bins, the bins' token sums are added up, and only within a bin
are documents ordered. Bins are those of the rank times the source's own odds, brought into (0, 1), which is nearly uniform at any rate, so
that no bin holds much more than its part; their number grows with the source (``BIN_DOCUMENTS``).

Defined results: documents of sources without a target, null sources, and documents without a token are not used; a target source without
documents, or with share zero, has 0 documents; repeated doc_ids are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.tokens import TOKENIZERS, token_counts
from sparkloom.runtime import cut

#: Bins of a source, at least, and documents for each bin beyond that.
LEAST_BINS = 4096
BIN_DOCUMENTS = 20_000
SEED = 20_240_601
#: Inclusion odds grow with this power of a document's tokens.
POWER = 0.25


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def allocation(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeat, documents, tokens, mean_weight, target_tokens, whole, remainder, rate) of each target source.

    target_share is that of the shares that can be met: those of sources with documents, made to sum to 1.
    """
    weight = F.pow(F.col("n_tokens"), F.lit(POWER))
    per = sizes.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.avg(weight).alias("mean_weight"))
    t = targets.where("source is not null").join(per, "source", "left").na.fill(0, ["documents", "tokens"])
    usable = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeat") > 0), F.col("target_share"))
    sums = t.agg(
        F.sum(usable).alias("met"),
        F.min(F.when(usable.isNotNull(), F.col("tokens") * F.col("max_repeat") / F.col("target_share"))).alias("largest"),
    )
    # One row; the size is that of the whole mix once the shares sum to 1.
    size = F.lit(float(total)) if total is not None else F.coalesce(F.col("largest") * F.col("met"), F.lit(0.0))
    share = F.coalesce(usable / F.col("met"), F.lit(0.0))
    goal = F.least(share * size, F.col("tokens") * F.col("max_repeat"))
    out = t.crossJoin(F.broadcast(sums)).withColumn("share", share).withColumn("target_tokens", goal)
    per_document = F.when(F.col("tokens") > 0, F.col("target_tokens") / F.col("tokens")).otherwise(0.0)
    out = out.withColumn("whole", F.floor(per_document + 1e-9)).withColumn("remainder", F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("whole") * F.col("tokens")))
    rate = F.when(F.col("tokens") > 0, F.col("remainder") / F.col("tokens")).otherwise(0.0)
    return out.select("source", "target_share", "share", "max_repeat", "documents", "tokens", "mean_weight", "target_tokens", "whole", "remainder", rate.alias("rate"))


def ranked(sizes: DataFrame, plan: DataFrame | None, seed: int = SEED) -> DataFrame:
    """``sizes`` with the columns of ``plan`` (joined on the source unless None), each document's rank ``r`` (null where no remainder is
    drawn), and its ``bin``; bins are in the order of ranks."""
    rows = sizes if plan is None else sizes.join(F.broadcast(plan.select("source", "documents", "mean_weight", "whole", "remainder", "rate")), "source")
    u = uniform(seed, F.col("doc_id"), F.col("source"))
    # Inclusion odds are the source's own times the document's weight over the mean weight.
    rate = F.least(F.col("rate"), F.lit(0.999999))
    odds = rate / (1 - rate) * F.pow(F.col("n_tokens"), F.lit(POWER)) / F.col("mean_weight")
    order = F.when(F.col("rate") > 1e-12, (u / (1 - u)) / odds)
    # Times the source's odds the ranks are about u / (1 - u); x / (1 + x) brings them near u, in the same order.
    scaled = F.col("r") * (rate / (1 - rate))
    bins = F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("documents") / BIN_DOCUMENTS))
    return rows.withColumn("r", order).withColumn("bin", F.floor(bins * (scaled / (1 + scaled))))


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies) of the documents used, the report of ``report``)."""
    names = targets.where("source is not null").select("source")
    # mix_targets has one row for each source and doesn't grow with the documents.
    chosen = documents.join(F.broadcast(names), "source", "left_semi")
    sizes = cut(token_counts(chosen, ["doc_id", "source"], "text", tokenizers=tokenizers))
    plan = cut(allocation(sizes, targets, total))
    rows = sizes.where("n_tokens > 0").join(F.broadcast(plan.where("target_tokens > 0").select("source", "documents", "mean_weight", "whole", "remainder", "rate")), "source")
    ranks = ranked(rows, None, seed)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ranks.where("r is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).select("source", "bin", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bin").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sampled = (
        ranks.where("r is not null")
        .join(bins, ["source", "bin"])
        .withColumn("held", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        # The document on the border is taken if that comes nearer to the remainder.
        .withColumn("extra", F.when(F.col("held") + F.col("n_tokens") / 2 <= F.col("remainder"), 1).otherwise(0))
        .select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies"))
    )
    certain = ranks.where("r is null").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    used = cut(sampled.unionByName(certain).where("copies > 0").withColumn("copies", F.col("copies").cast("int")))
    return used, report(used, plan)


def report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each target source: documents, distinct documents used, copies at most, tokens used, target and actual share of the mix."""
    per = used.groupBy("source").agg(F.count("*").alias("used"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("used_tokens").alias("all_tokens"))
    return (
        plan.join(F.broadcast(per), "source", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "source",
            "target_share",
            "max_repeat",
            "documents",
            F.coalesce("used", F.lit(0)).alias("documents_used"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce("used_tokens", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
