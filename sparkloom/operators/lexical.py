"""BM25 over a token column: statistics, postings and scores for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.kept import Best
from sparkloom.runtime import broadcast_if_small, cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries scored at once by ``search``; their terms and weights are what is sent to the partitions.
BLOCK = 256


def tokenised(df: DataFrame, id_col: str, **texts: Column) -> dict[str, DataFrame]:
    """(id, tokens, dl) of the documents with at least one token, for each of ``texts``.

    All are cut into tokens in one pass and written once, as statistics, vocabulary and postings read them. They are written side by side
    (no token holds a space), which takes less than half the disk of lists; lengths are written too, as a filter on lists would be moved
    below them and work them out twice.
    """
    lists = df.select(F.col(id_col).alias("id"), *(T.tokens(text).alias(name) for name, text in texts.items()))
    written = cut(lists.select("id", *(F.struct(F.concat_ws(" ", name).alias("said"), F.size(name).alias("dl")).alias(name) for name in texts)))
    return {name: of_written(written, f"{name}.said", f"{name}.dl") for name in texts}


def of_written(written: DataFrame, said: str, dl: str) -> DataFrame:
    """(id, tokens, dl) of the documents with at least one token, from tokens written side by side and their number."""
    return written.where(F.col(dl) > 0).select("id", F.split(said, " ").alias("tokens"), F.col(dl).alias("dl"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def inverse_frequencies(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of the whole vocabulary; a negative idf becomes EPSILON times the mean idf."""
    df = cut(docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    # The vocabulary is read for the mean and again for the weights: written once. One row on the right: broadcast.
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of the positive scores. ``queries``: (query_id, tokens); a token asked twice counts twice.

    Only postings of asked terms are kept: tokens are filtered against the asked terms before they are counted.
    """
    stats = collection_stats(docs)
    idf = inverse_frequencies(docs, stats)
    wanted = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = broadcast_if_small(cut(wanted.join(idf, "term")))
    terms = asked.select("term").distinct()
    postings = docs.select("id", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    weighted = postings.join(asked, "term").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighted.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")


class Weights:
    """What the queries ask, by blocks of ``BLOCK``: term numbers, queries' numbers and weights, and the mean length of the collection."""

    def __init__(self, corpus: DataFrame, queries: DataFrame) -> None:
        stats = collection_stats(corpus)
        idf = inverse_frequencies(corpus, stats)
        wanted = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        weights = wanted.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).crossJoin(F.broadcast(stats.select("avgdl")))
        self.avgdl = 1.0
        self.terms: dict[str, int] = {}
        self.blocks: list[tuple[list, list[tuple[int, int, float]]]] = []
        for r in weights.orderBy("query_id", "term").toLocalIterator():
            self.avgdl = r.avgdl
            if not self.blocks or self.blocks[-1][0][-1] != r.query_id:
                if not self.blocks or len(self.blocks[-1][0]) == BLOCK:
                    self.blocks.append(([], []))
                self.blocks[-1][0].append(r.query_id)
            ids, entries = self.blocks[-1]
            entries.append((self.terms.setdefault(r.term, len(self.terms)), len(ids) - 1, r.weight))

    def scored(self, batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[list, int, np.ndarray]]:
        """Of batches of (id, dl, tokens): the ids of some rows, the number of a block, and the rows' scores (rows by queries) for it."""
        known = pa.array(list(self.terms), pa.string())
        dense = []
        for ids, entries in self.blocks:
            t, q, w = (np.array(x) for x in zip(*entries, strict=True))
            own, at = np.unique(t, return_inverse=True)
            place = np.full(len(self.terms), -1)
            place[own] = np.arange(len(own))
            matrix = np.zeros((len(own), len(ids)))
            matrix[at, q] = w
            dense.append((place, matrix))
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                n, dl, tokens = part.num_rows, part.column(1).to_numpy(), part.column(2)
                of = np.repeat(np.arange(n), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                at = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = at >= 0
                key, tf = np.unique(at[hit] * n + of[hit], return_counts=True)
                term, doc = np.divmod(key, n)
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / self.avgdl))
                ids = part.column(0).to_pylist()
                for k, (place, matrix) in enumerate(dense):
                    own = place[term]
                    here, col = np.unique(own[own >= 0], return_inverse=True)
                    said = np.zeros((n, len(here)))
                    said[doc[own >= 0], col] = value[own >= 0]
                    yield ids, k, said @ matrix[here]


def search(docs: DataFrame, queries: DataFrame, n: int, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank from 0): the best ``n`` documents of each query, ties by id.

    The same scores as ``scores``, but no list of all matches is made: the asked terms with their weights are sent to the partitions, each
    keeps its best ``n`` of every query, and only those are shuffled. Statistics are of ``corpus`` (``docs`` if none is given), so that a
    filter on ``docs`` doesn't change them. What is sent is the query set, in blocks of ``BLOCK`` queries.
    """
    weights = Weights(docs if corpus is None else corpus, queries)
    kind_q, kind_id = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(n, len(ids), 0.0) for ids, _ in weights.blocks]
        for ids, k, s in weights.scored(batches):
            best[k].add(ids, s.T)
        for (q_ids, _), kept in zip(weights.blocks, best, strict=True):
            q, found, score = kept.rows()
            yield pa.RecordBatch.from_arrays([pa.array([q_ids[i] for i in q], to_arrow(kind_q)), pa.array(found, to_arrow(kind_id)), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    found = docs.select("id", "dl", "tokens").mapInArrow(run, f"query_id {kind_q}, id {kind_id}, score double")
    return top(found, n)


def totals(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, matches, total): how many documents score above zero for each query that any does, and the sum of their scores.

    The pairs of ``scores`` grow with the product of documents and queries, so they are added up where they arise: of each partition one row
    for a query is shuffled.
    """
    weights = Weights(docs, queries)
    kind_q = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(ids))) for ids, _ in weights.blocks]
        for _, k, s in weights.scored(batches):
            sums[k] += np.count_nonzero(s > 0, axis=0), np.maximum(s, 0.0).sum(axis=0)
        for (q_ids, _), (matches, total) in zip(weights.blocks, sums, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids, to_arrow(kind_q)), pa.array(matches.astype(np.int64)), pa.array(total)], names=["query_id", "matches", "total"])

    parts = docs.select("id", "dl", "tokens").mapInArrow(run, f"query_id {kind_q}, matches bigint, total double")
    return parts.groupBy("query_id").agg(F.sum("matches").alias("matches"), F.sum("total").alias("total")).where("matches > 0")


def to_arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def top(scored: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of each query with their rank from 0; ties by id. Scores are compared at 9 places, as sums differ in the last bits."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)
