"""Term graph: co-occurrence in fixed windows, association measures, similarity of association rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.runtime import broadcast_if_small, cut

WINDOW, MIN_DF, MAX_DF = 25, 3, 0.08


def windows(df: DataFrame, id_col: str, text: Column, size: int = WINDOW, least: int = 10) -> DataFrame:
    """(win, term), distinct: stems of words of four letters and more, in windows of ``size`` words with at least ``least``."""
    words = F.transform(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(T.STOPWORDS)), T.stem)
    cuts = F.expr(f"transform(sequence(0, greatest(0, cast((size(w) - 1) div {size} as int))), i -> slice(w, i * {size} + 1, {size}))")
    w = df.select(F.col(id_col).alias("id"), words.alias("w")).where(f"size(w) >= {least}")
    per = w.select("id", F.posexplode(cuts).alias("k", "terms")).where(f"size(terms) >= {least}")
    return per.select(F.xxhash64("id", "k").alias("win"), F.explode(F.array_distinct("terms")).alias("term"))


def vocabulary(wins: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> tuple[DataFrame, DataFrame]:
    """((term, df) of the terms neither rare nor everywhere, one row with the number of windows)."""
    n = wins.agg(F.count_distinct("win").alias("n"))
    df = wins.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).where(f"df >= {min_df} and df <= {max_df} * n").select("term", "df"), n


def associations(wins: DataFrame) -> DataFrame:
    """(a, b, co, npmi, ppmi) of the terms that share a window, both directions.

    Pairs arise within a window only, of at most its 25 words, and are summed in partitions before the shuffle.
    """
    vocab, n = (cut(x) for x in vocabulary(wins))
    vocab = broadcast_if_small(vocab)
    kept = wins.join(vocab, "term").groupBy("win").agg(F.array_sort(F.collect_list("term")).alias("t"))
    pair = kept.select(F.explode(F.expr("flatten(transform(sequence(1, size(t)), i -> transform(slice(t, i + 1, size(t)), y -> struct(t[i - 1] as a, y as b))))")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("co"))
    x, y = (vocab.select(F.col("term").alias(s), F.col("df").alias(f"df_{s}")) for s in "ab")
    m = pair.join(x, "a").join(y, "b").crossJoin(F.broadcast(n))
    pmi = F.ln(F.col("co") * F.col("n") / (F.col("df_a") * F.col("df_b")))
    one = m.select(
        "a", "b", "co",
        F.when(F.col("co") >= 3, pmi / -F.ln(F.col("co") / F.col("n"))).otherwise(0.0).alias("npmi"),
        F.when(F.col("co") >= 2, F.greatest(pmi, F.lit(0.0))).otherwise(0.0).alias("ppmi"),
    )
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "co", "npmi", "ppmi"))


def best_rows(rows: DataFrame, top: int, least: float, block: int = 512) -> DataFrame:
    """(a, b, score): of each row of a sparse matrix (a, c, v, npmi) the ``top`` others of the highest score of at least ``least``, ties by b.

    A score is half the product of the two rows, half the clipped npmi of their names (that of the entry at (a, b)). Joined entry by entry,
    frequent columns would give the square of their entries; so rows are cut into blocks of about ``block`` terms, each pair of blocks is
    multiplied once, some columns at a time, for both directions, and only the best of each row leave the task.
    """
    n = max(1, -(-rows.select("a").distinct().count() // block))
    of = F.pmod(F.xxhash64("a"), F.lit(n)).cast("int")
    entries = ["a", "c", "v", "npmi"]
    left = rows.select(*entries, of.alias("i")).select(*entries, "i", F.explode(F.sequence(F.col("i"), F.lit(n - 1))).alias("j"))
    right = rows.select(*(F.col(c).alias(c) for c in entries), of.alias("j")).select(*entries, F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"), "j")

    def picked(score: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        """The best of each row of ``score``; the columns are in the order of b."""
        rounded = np.round(score, 6)
        at = np.argsort(-rounded, axis=1, kind="stable")[:, :top]
        i = np.repeat(np.arange(len(a)), at.shape[1])
        j = at.ravel()
        ok = score[i, j] >= least
        return pd.DataFrame({"a": a[i[ok]], "b": b[j[ok]], "score": score[i[ok], j[ok]]})

    def multiplied(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "str", "b": "str", "score": "float64"})
        na, nb = pd.Index(sorted(x["a"].unique())), pd.Index(sorted(y["a"].unique()))
        columns = pd.Index(x["c"].unique()).intersection(y["c"].unique())
        product = np.zeros((len(na), len(nb)))
        at = [(p, names.get_indexer(p["a"]), columns.get_indexer(p["c"])) for p, names in ((x, na), (y, nb))]
        for k in range(0, len(columns), 8 * block):
            dense = []
            for (p, row, col), names in zip(at, (na, nb), strict=True):
                inside = (col >= k) & (col < k + 8 * block)
                m = np.zeros((len(names), min(8 * block, len(columns) - k)))
                m[row[inside], col[inside] - k] = p["v"].to_numpy()[inside]
                dense.append(m)
            product += dense[0] @ dense[1].T
        near = np.zeros_like(product)
        beside = nb.get_indexer(x["c"])
        near[na.get_indexer(x["a"])[beside >= 0], beside[beside >= 0]] = x["npmi"].to_numpy()[beside >= 0]
        score = 0.5 * product + 0.5 * np.clip(near, 0.0, 1.0)
        same = nb.get_indexer(na)
        score[np.flatnonzero(same >= 0), same[same >= 0]] = -1.0
        a, b = na.to_numpy(object), nb.to_numpy(object)
        out = [picked(score, a, b)]
        if x["i"].iloc[0] != x["j"].iloc[0]:
            out.append(picked(score.T, b, a))
        return pd.concat(out)

    part = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(multiplied, "a string, b string, score double")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 6)), "b")
    return part.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).drop("k")


def related(assoc: DataFrame, top: int = 8, least: float = 0.15) -> DataFrame:
    """(term, related, score): half the cosine of the association rows, half the clipped npmi; the best ``top`` of at least ``least``."""
    # An entry without ppmi has no positive npmi either.
    rows = cut(assoc.where("ppmi > 0").select("a", "b", "ppmi", "npmi"))
    size = rows.groupBy("a").agg(F.sqrt(F.sum(F.col("ppmi") * F.col("ppmi"))).alias("size"))
    unit = cut(rows.join(size, "a").select("a", F.col("b").alias("c"), (F.col("ppmi") / (F.col("size") + 1e-9)).alias("v"), "npmi"))
    return best_rows(unit, top, least).select(F.col("a").alias("term"), F.col("b").alias("related"), "score")
