"""Vector search: a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.kept import Best

#: Queries multiplied at once; a block of their vectors is all that is broadcast.
BLOCK = 4096


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")


def norm(a: str) -> Column:
    return F.expr(f"sqrt(aggregate({a}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))")


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, n: int | None, label: str | None = None, least: float = -2.0) -> DataFrame:
    """(query_id, id, score, rank from 0): for each query the ``n`` rows of highest cosine, at least ``least``, ties by id; all if n is None.

    With ``label`` only rows of another label count. Queries are collected in blocks of ``BLOCK`` vectors; each partition multiplies its rows
    with a block and keeps ``n`` per query, so that only n * queries rows of a partition are shuffled. Null and zero vectors match nothing.
    """
    keep = ["query_id", vector, *([label] if label else [])]
    known = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), vector, *([label] if label else []))
    asked = queries.where(F.col(vector).isNotNull()).select(*keep).orderBy("query_id").toLocalIterator()
    parts, block = [], []

    def unit(vectors: list) -> np.ndarray:
        m = np.array([np.asarray(v, np.float64) for v in vectors])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)

    def matched(found: list) -> DataFrame:
        q_ids, q = [r.query_id for r in found], unit([r[vector] for r in found])
        q_labels = np.array([r[label] for r in found], object) if label else None

        def matches(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sims = q @ unit(part[vector]).T
                sims[np.isnan(sims)] = -9
                if label:
                    sims[q_labels[:, None] == part[label].to_numpy(object)[None, :]] = -9
                yield part["id"].to_numpy(), sims

        def frame(i: list | np.ndarray, ids: list | np.ndarray, scores: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"query_id": [q_ids[x] for x in i], "id": ids, "score": scores})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(n, len(q_ids), least, including=True) if n else None
            for pdf in batches:
                for ids, sims in matches(pdf):
                    if best:
                        best.add(ids, sims)
                    else:
                        i, j = np.nonzero(sims >= least)
                        yield frame(i, ids[j], sims[i, j])
            if best:
                i, ids, scores = best.rows()
                for at in range(0, len(i), 10_000):
                    yield frame(i[at : at + 10_000], ids[at : at + 10_000], scores[at : at + 10_000])

        kind_q, kind_id = queries.schema["query_id"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
        return known.mapInPandas(run, f"query_id {kind_q}, id {kind_id}, score double")

    for r in asked:
        block.append(r)
        if len(block) == BLOCK:
            parts.append(matched(block))
            block = []
    if block or not parts:
        parts.append(matched(block) if block else known.where("false").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w) - 1)
    return ranked if n is None else ranked.where(F.col("rank") < n)
