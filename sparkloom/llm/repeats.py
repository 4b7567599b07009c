"""Lines repeated across the documents of one source (problem 2).

1. Each chunk's lines become 64-bit digests of their normal form, in the scan; nothing else of the text is moved.
2. Each partition keeps a heavy-hitter summary per source: counts of digests, pruned by subtracting a common amount whenever a source has
   more counters than its budget. What is subtracted is the summary's error. Summaries merge by adding counts and errors.
3. A line on at least ``share`` of a source's chunks keeps count + error of at least that share, since each partition's error stays
   below ``share`` of its chunks; all such digests are candidates, and none of the wanted lines is lost.
4. A second pass counts the candidates' distinct chunks exactly. Confirmed digests are broadcast while they are few, else joined.

No step groups a source's rows in one task: counts are kept per (source, digest) and combined in partitions first.

Two lines are the same if they agree in lower case when all but letters and digits is dropped and each run of digits is one sign. Defined
results: null texts have no lines but their chunks count for the source; a null source is a source of its own; a chunk given twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.pages import once
from sparkloom.runtime import broadcast_if_small, cut

MIN_LETTERS = 12
MIN_CHUNKS = 5
SHARE = 0.10
#: Digests a worker gathers before it summarises them.
GATHERED = 1_000_000


def normal_lines(text: str) -> str:
    """SQL of the text with each line in its normal form; line breaks stay."""
    letters = rf"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{Nd}}\\p{{Nl}}\\p{{No}}\\n]+', '')"
    return rf"regexp_replace({letters}, '[\\p{{Nd}}\\p{{Nl}}\\p{{No}}]+', '#')"


def line_digests(chunks: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(chunk_id, source_id, lines): of each line its digest, null where fewer than ``min_letters`` letters are left."""
    lines = F.expr(f"split({normal_lines('text')}, '\\n')")
    return chunks.where("chunk_id is not null").select(
        "chunk_id",
        "source_id",
        F.transform(lines, lambda s: F.when(F.length(F.replace(s, F.lit("#"), F.lit(""))) >= min_letters, F.xxhash64(s))).alias("lines"),
    )


def summaries(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """(source_id, digest, n): partitions' counters, and their errors as rows whose digest is null."""

    def pruned(source: np.ndarray, digest: np.ndarray, n: np.ndarray, weight: np.ndarray, chunks: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counters by (source, digest); of a source with more than its budget the counters are lowered by the first one beyond it.

        With w occurrences in m chunks and a budget of 2 w / (share m) counters, an amount subtracted from more than that many counters is
        less than half of share times m. (Budgets follow w / m as it is when they are needed; should errors still add up to a source's
        bound, ``repeated`` counts all lines of that source.)
        """
        order = np.lexsort((-n, source))
        source, digest, n = source[order], digest[order], n[order]
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(source)))
        of = source[starts]
        budget = np.ceil(2 * weight[of] / (share * np.maximum(chunks[of], 1))).astype(np.int64)
        over = sizes > budget
        cut_at = np.where(over, n[np.minimum(starts + budget, len(n) - 1)], 0)
        error[of] += cut_at
        n = n - np.repeat(cut_at, sizes)
        keep = n > 0
        return source[keep], digest[keep], n[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str | None, int] = {}
        weight, chunks, error = (np.zeros(0, np.int64) for _ in range(3))
        S, D, N = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> None:
            nonlocal S, D, N, held, size
            if not held:
                return
            s = np.concatenate([S, *(x for x, _ in held)])
            d = np.concatenate([D, *(y for _, y in held)])
            n = np.concatenate([N, np.ones(len(s) - len(S), np.int64)])
            order = np.lexsort((d, s))
            s, d, n = s[order], d[order], n[order]
            first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))) if len(s) else np.zeros(0, np.int64)
            S, D, N = pruned(s[first], d[first], np.add.reduceat(n, first) if len(first) else n, weight, chunks, error)
            held, size = [], 0

        for batch in batches:
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            if len(names) > len(chunks):
                more = np.zeros(len(names) - len(chunks), np.int64)
                weight, chunks, error = (np.concatenate([x, more]) for x in (weight, chunks, error))
            np.add.at(chunks, codes, 1)
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            np.add.at(weight, codes, sizes)
            held.append((np.repeat(codes, sizes), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(held[-1][0])
            if size > GATHERED:
                fold()
        fold()
        of = list(names)
        bad = np.flatnonzero(error)
        source = pa.array([of[k] for k in [*S.tolist(), *bad.tolist()]], pa.string())
        digest = pa.concat_arrays([pa.array(D, pa.int64()), pa.nulls(len(bad), pa.int64())])
        yield pa.RecordBatch.from_arrays([source, digest, pa.array(np.concatenate([N, error[bad]]))], names=["source_id", "digest", "n"])

    known = lines.select("source_id", F.expr("array_distinct(filter(lines, x -> x is not null))").alias("lines"))
    return known.mapInArrow(run, "source_id string, digest long, n long")


def repeated(lines: DataFrame, share: float = SHARE, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """(source_id, digest): the lines repeated excessively, counted exactly. ``lines`` are those of ``line_digests``, cut."""
    size = lines.groupBy("source_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    size = cut(size)
    merged = summaries(lines, share).groupBy("source_id", "digest").agg(F.sum("n").alias("n"))
    merged = cut(merged)
    error = merged.where("digest is null").select("source_id", F.col("n").alias("error"))
    same = lambda a, b: a["source_id"].eqNullSafe(b["source_id"])
    bound = size.join(error, same(size, error), "left").select(size["source_id"].alias("s"), "chunks", F.coalesce("error", F.lit(0)).alias("error"))
    counted = merged.where("digest is not null")
    candidates = counted.join(broadcast_if_small(bound), counted["source_id"].eqNullSafe(F.col("s"))).where(
        f"n + error >= {min_chunks} and n + error >= {share} * chunks"
    )
    candidates = cut(candidates.select("source_id", "digest", "chunks"))
    exploded = lines.select("chunk_id", F.col("source_id").alias("s"), F.explode(F.expr("array_distinct(filter(lines, x -> x is not null))")).alias("d"))
    few = broadcast_if_small(candidates)
    hits = exploded.join(few, exploded["s"].eqNullSafe(few["source_id"]) & (exploded["d"] == few["digest"]))
    # Where a summary's error reaches the bound, every line of the source is counted; no source of the given data needs it.
    loose = cut(bound.where(f"error >= {share} * chunks").select(F.col("s").alias("source_id"), "chunks"))
    if not loose.isEmpty():
        whole = exploded.join(loose, exploded["s"].eqNullSafe(loose["source_id"])).select("chunk_id", "s", "d", "source_id", F.col("d").alias("digest"), "chunks")
        hits = hits.join(loose.select(F.col("source_id").alias("x")), F.col("s").eqNullSafe(F.col("x")), "left_anti").unionByName(whole)
    exact = hits.groupBy("source_id", "digest").agg(F.count_distinct("chunk_id").alias("k"), F.first("chunks").alias("chunks"))
    return exact.where(f"k >= {min_chunks} and k >= {share} * chunks").select("source_id", "digest")


def repeated_lines(chunks: DataFrame, share: float = SHARE, min_chunks: int = MIN_CHUNKS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(chunk_id, line_no) of each line repeated excessively in its source."""
    lines = cut(line_digests(chunks, min_letters))
    confirmed = broadcast_if_small(cut(repeated(lines, share, min_chunks)))
    each = lines.select("chunk_id", F.col("source_id").alias("s"), F.posexplode("lines").alias("at", "d")).where("d is not null")
    found = each.join(confirmed, each["s"].eqNullSafe(confirmed["source_id"]) & (each["d"] == confirmed["digest"]))
    return found.select("chunk_id", (F.col("at") + 1).alias("line_no")).distinct()


def without_repeats(chunks: DataFrame, share: float = SHARE, min_chunks: int = MIN_CHUNKS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(chunk_id, source_id, text) with the repeated lines removed; each chunk once, a null text stays null."""
    found = repeated_lines(chunks, share, min_chunks, min_letters).groupBy("chunk_id").agg(F.collect_list("line_no").alias("gone"))
    found = cut(found)
    each = once(chunks.where("chunk_id is not null").select("chunk_id", "source_id", "text"), "chunk_id")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> gone is null or not array_contains(gone, i + 1)), '\\n')")
    return each.join(broadcast_if_small(found), "chunk_id", "left").select("chunk_id", "source_id", F.when(F.col("text").isNotNull(), kept).alias("text"))
