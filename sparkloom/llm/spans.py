"""Long spans that stand letter for letter in more than one record (problem 9).

Units are hashed and their digests grouped globally; the earliest occurrence of a shared span is kept, later ones can be removed, and all
offsets are those of the original text. Units are lines: ``unit`` characters from a line break on. Whole lines wouldn't do, as short ones stand
everywhere and a span can lie within a long one: of the lines that begin within ``min_chars - unit + 1`` places the one with the least hash is a
unit, and where no line begins in that reach, a long line is cut at the place with the least hash. Every span of ``min_chars`` characters holds the
same unit wherever it stands. Units aren't normalised further, as spans agree letter for letter. Digests only propose pairs; the characters
around the units decide.

Exact copies are collapsed first: one document of each class of equal texts takes part, and the pairs of the others follow from membership.

Defined results: null texts and texts shorter than ``min_chars`` share nothing; positions count code points from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.tokens import powers, slices
from sparkloom.runtime import broadcast_if_small, cut

MIN_CHARS = 250
UNIT = 110
#: Characters hashed at once.
BLOCK = 500_000
#: Units that stand more often than this are taken apart into all windows of ``min_chars`` characters around them.
HOT = 200


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least of every ``w`` neighbouring hashes, each position once."""
    n = len(h)
    pad = -n % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], fore[w - 1 : n])
    # A window takes each of its positions that holds its least value: ties are all kept, so the choice depends on content only.
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    picked = []
    ends = np.append(change[1:], len(least)) + w - 1
    for a, b, v in zip(change.tolist(), ends.tolist(), least[change], strict=True):
        picked.append(a + np.flatnonzero(h[a:b] == v))
    return np.unique(np.concatenate(picked))


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` characters."""
    n = len(codes)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _units(text: str, min_chars: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests and positions of a text's units; very long texts go block by block, with overlap."""
    w = min_chars - unit + 1
    digests, places = [], []
    for at in range(0, max(1, len(text) - min_chars + 1), BLOCK):
        part = text[at : at + BLOCK + min_chars - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = _window_hashes(codes, unit).view(np.uint64)
        # Windows that begin at a line break come first, whatever their hash. That depends on the window's own characters only.
        p = _least((h >> np.uint64(1)) | (codes[: len(h)] != 10).astype(np.uint64) << np.uint64(63), w)
        digests.append(h[p])
        places.append(p + at)
    d, p = np.concatenate(digests), np.concatenate(places)
    if len(digests) > 1:
        p, first = np.unique(p, return_index=True)
        d = d[first]
    return d.view(np.int64), p


def units(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, unit: int = UNIT) -> DataFrame:
    """(digest, id, at): the content-defined units of each text of at least ``min_chars`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out_d, out_i, out_p = [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t is not None and len(t) >= min_chars:
                        d, p = _units(t, min_chars, unit)
                        out_d.append(d)
                        out_p.append(p)
                        out_i.append(np.full(len(d), i, np.int64))
                if out_d:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_d, out_i, out_p)], names=["digest", "id", "at"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "digest long, id long, at long")


def windows_around(places: DataFrame, docs: DataFrame, min_chars: int, unit: int) -> DataFrame:
    """(digest, id, at): all windows of ``min_chars`` characters that hold one of the units at ``places`` (id, at)."""
    per = places.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 100):
                out_d, out_i, out_p = [], [], []
                for i, ats, t in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    begins = [(max(0, a - (min_chars - unit)), min(a, len(t) - min_chars)) for a in ats]
                    at = -1
                    for lo, hi in begins:
                        lo = max(lo, at + 1)
                        if lo <= hi:
                            codes = np.frombuffer(t[lo : hi + min_chars].encode("utf-32-le", "surrogatepass"), np.uint32)
                            out_d.append(_window_hashes(codes, min_chars))
                            out_p.append(np.arange(lo, hi + 1))
                            out_i.append(np.full(hi + 1 - lo, i, np.int64))
                            at = hi
                if out_d:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_d, out_i, out_p)], names=["digest", "id", "at"])

    return per.join(docs, "id").select("id", "ats", "t").mapInArrow(run, "digest long, id long, at long")


def classes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, rep): each long enough document and the least id among the documents of the same text (equal SHA-256 of the text)."""
    keyed = df.where(F.length(text_col) >= min_chars).select(F.col(id_col).cast("long").alias("id"), F.sha2(text_col, 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # Only hashes that occur more than once need the join back.
    return keyed.join(first.where("n > 1").drop("n"), "h").select("id", "rep")


def single_texts(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, t) of one document of each class of equal texts that are long enough, and (id, rep) of the documents that have equal ones."""
    same = cut(classes(df, id_col, text_col, min_chars))
    docs = df.where(F.length(text_col) >= min_chars).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return docs.join(broadcast_if_small(same.where("id != rep").select("id")), "id", "left_anti"), same


def confirmed(pairs: DataFrame, texts: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, at_a, at_b, length): the common runs of at least ``min_chars`` characters within the stretches (a, b, d, start, n), where
    ``n`` characters from ``start`` in a stand against those from ``start + d`` in b."""
    pairs = cut(pairs)
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut(texts.join(broadcast_if_small(cut(need)), "id", "left_semi"))
    stretch = lambda at: F.expr(f"substring(t, cast({at} + 1 as int), cast(n as int))")
    with_a = pairs.join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "d", "start", "n", stretch("start").alias("ta"))
    with_b = with_a.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "d", "start", "ta", stretch("start + d").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, d, start, s, t in pdf[["a", "b", "d", "start", "ta", "tb"]].itertuples(index=False):
                n = min(len(s), len(t))
                u, v = (np.frombuffer(z[:n].encode("utf-32-le", "surrogatepass"), np.uint32) for z in (s, t))
                off = np.flatnonzero(np.concatenate([[True], u != v, [True]]))
                gap = np.diff(off) - 1
                # The stretch may stop short of where a run goes on, but not before min_chars of it.
                for k in np.flatnonzero(gap >= min_chars):
                    p = int(start + off[k])
                    rows.append((a, b, p, p + d, int(gap[k])))
            yield pd.DataFrame(rows, columns=["a", "b", "at_a", "at_b", "length"]).astype("int64")

    return with_b.mapInPandas(run, "a long, b long, at_a long, at_b long, length long")


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, unit: int = UNIT, hot_units: int = HOT, earliest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans shared by different texts, and the classes of equal texts.

    Returns (a, b, at_a, at_b, length), a < b representatives, each a longest common run of at least ``min_chars`` characters on one
    alignment, and (id, rep) of the documents that have equal ones. With ``earliest``, spans that hold a hot unit are not given for all
    pairs but for each record and the earliest occurrence (see ``first_met``), so that rows grow with the text and not with its square.
    """
    single, same = single_texts(df, id_col, text_col, min_chars)
    found = cut(units(single, "id", "t", min_chars, unit))

    def aligned(u: DataFrame, size: int) -> DataFrame:
        """One line for each alignment of two texts: where its units begin and end in a. The join is on the digest; AQE splits hot ones."""
        x, y = (u.select("digest", F.col("id").alias(i), F.col("at").alias(f"at_{i}")) for i in "ab")
        lines = x.join(y, "digest").where("a < b").groupBy("a", "b", (F.col("at_b") - F.col("at_a")).alias("d"))
        return lines.agg(F.min("at_a").alias("first"), (F.max("at_a") + size - unit).alias("last"))

    # A unit of a notice that stands in very many texts would pair them all, though they share no span long enough. Such units are taken
    # apart into all their possible windows of full length: then only texts that do share a span meet.
    hot = cut(found.groupBy("digest").count().where(F.col("count") > hot_units).select("digest"))
    # Only the stretch that can belong to a span travels: from before the first unit to behind the last.
    reach = min_chars - unit
    begin = F.greatest(F.lit(0), F.col("first") - reach, -F.col("d"))
    stretches = lambda p: p.select("a", "b", "d", begin.alias("start"), (F.col("last") + unit + reach - begin).alias("n"))
    if hot.isEmpty():
        return confirmed(stretches(aligned(found, unit)), single, min_chars), same
    few = broadcast_if_small(hot)
    whole = windows_around(found.join(few, "digest", "left_semi").select("id", "at"), single, min_chars, unit)
    cold = aligned(found.join(few, "digest", "left_anti"), unit)
    if earliest:
        return confirmed(stretches(cold).unionByName(first_met(cut(whole), min_chars)), single, min_chars), same
    pairs = cold.unionByName(aligned(whole, min_chars)).groupBy("a", "b", "d").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return confirmed(stretches(pairs), single, min_chars), same


def pairs_found(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, unit: int = UNIT, hot_units: int = HOT) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: each pair of records that share a span of at least ``min_chars`` characters.

    Pairs of representatives are expanded by membership in both classes; each class gives its own pairs.
    """
    spans, same = shared_spans(df, id_col, text_col, min_chars, unit, hot_units)
    reps = cut(spans.select("a", "b").distinct())
    touched = reps.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    of = same.select("rep", "id").unionByName(touched.join(same.select("rep").distinct(), "rep", "left_anti").select("rep", F.col("rep").alias("id")))
    x, y = (of.select(F.col("rep").alias(i), F.col("id").alias(f"id_{i}")) for i in "ab")
    across = reps.join(x, "a").join(y, "b").select("id_a", "id_b")
    s, t = (same.select("rep", F.col("id").alias(f"id_{i}")) for i in "ab")
    within = s.join(t, "rep").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()


def first_met(whole: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, d, start, n): stretches of the windows ``whole`` (digest, id, at) beside their earliest occurrence.

    Every window that stands in several records is met once with the least (id, position) it stands at, never with all its others, so that
    a passage in k records gives k rows. Rows where a = b are a record's own repeats of a window that other records have too.
    """
    first = whole.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("f"), F.max("id").alias("y")).where("f.id != y").select("digest", F.col("f.id").alias("a"), F.col("f.at").alias("at_a"))
    met = whole.join(first, "digest").where("id != a or at != at_a").select("a", F.col("id").alias("b"), (F.col("at") - F.col("at_a")).alias("d"), "at_a")
    # Neighbouring windows on one alignment are one stretch.
    w = Window.partitionBy("a", "b", "d").orderBy("at_a")
    runs = met.withColumn("g", F.col("at_a") - F.row_number().over(w)).groupBy("a", "b", "d", "g").agg(F.min("at_a").alias("start"), (F.max("at_a") + min_chars - F.min("at_a")).alias("n"))
    return runs.drop("g")


def without_later(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, unit: int = UNIT, hot_units: int = HOT) -> DataFrame:
    """(doc_id, text, removed_chars): the texts without the stretches that a record with a lesser id has; null texts stay null.

    Of equal texts only that of the least id stays.
    """
    later = shared_share(df, id_col, text_col, min_chars, unit, hot_units).where("repeated_chars > 0").select("doc_id", "later", "repeated_chars")
    # What is kept lies between one stretch's end and the next one's begin.
    kept = """array_join(transform(sequence(0, size(later)), i -> substring(t,
      cast(if(i = 0, 0, later[greatest(i - 1, 0)].end) + 1 as int),
      cast(if(i = size(later), n, later[least(i, size(later) - 1)].begin) - if(i = 0, 0, later[greatest(i - 1, 0)].end) as int))), '')"""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.length(text_col).alias("n"))
    return docs.join(later, "doc_id", "left").select("doc_id", F.when(F.col("later").isNull(), F.col("t")).otherwise(F.expr(kept)).alias("text"), F.coalesce("repeated_chars", F.lit(0)).alias("removed_chars"))


def shared_share(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, unit: int = UNIT, hot_units: int = HOT) -> DataFrame:
    """For each record: how much of it is shared, the share, what would be removed if the earliest occurrence is kept, and its class.

    ``shared_chars`` counts the characters inside spans shared with any other record; ``repeated_chars`` those that some record with a
    lesser id already has; ``spans`` are the shared stretches as (begin, end), end exclusive, with original offsets, and ``later`` those of
    them to remove if the earliest occurrence is kept; ``rep`` is the least id of the records of the same text. Records that share nothing have 0 and an empty list.
    """
    spans, same = shared_spans(df, id_col, text_col, min_chars, unit, hot_units, earliest=True)
    spans = cut(spans)
    ends = spans.select(F.col("a").alias("rep"), F.col("at_a").alias("s"), (F.col("at_a") + F.col("length")).alias("e"), F.lit(0).alias("later")).unionByName(
        spans.select(F.col("b").alias("rep"), F.col("at_b").alias("s"), (F.col("at_b") + F.col("length")).alias("e"), F.when(F.col("a") != F.col("b"), 1).otherwise(0).alias("later"))
    )
    # Merging intervals: the edges of all spans of a record, summed by place (partial sums first), give its cover.
    edges = ends.select("rep", F.explode(F.expr("array(struct(s as p, 1 as c, later as l), struct(e as p, -1 as c, -later as l))")).alias("x")).groupBy("rep", F.col("x.p").alias("p")).agg(F.sum("x.c").alias("c"), F.sum("x.l").alias("l"))
    merged = edges.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("p", "c", "l"))).alias("edges"))
    scan = """aggregate(edges, named_struct('n', 0L, 'm', 0L, 'at', 0L, 'open', 0L, 'lopen', 0L, 'begin', 0L, 'lbegin', 0L, 'out', cast(array() as array<struct<begin:bigint,end:bigint>>), 'lout', cast(array() as array<struct<begin:bigint,end:bigint>>)),
      (acc, x) -> named_struct(
        'n', acc.n + if(acc.open > 0, x.p - acc.at, 0L),
        'm', acc.m + if(acc.lopen > 0, x.p - acc.at, 0L),
        'at', x.p, 'open', acc.open + x.c, 'lopen', acc.lopen + x.l,
        'begin', if(acc.open = 0, x.p, acc.begin), 'lbegin', if(acc.lopen = 0, x.p, acc.lbegin),
        'out', if(acc.open > 0 and acc.open + x.c = 0, concat(acc.out, array(named_struct('begin', acc.begin, 'end', x.p))), acc.out),
        'lout', if(acc.lopen > 0 and acc.lopen + x.l = 0, concat(acc.lout, array(named_struct('begin', acc.lbegin, 'end', x.p))), acc.lout)))"""
    cover = merged.select("rep", F.expr(scan).alias("z")).select("rep", F.col("z.n").alias("n"), F.col("z.m").alias("m"), F.col("z.out").alias("out"), F.col("z.lout").alias("lout"))
    all_docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return (
        all_docs.join(same.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .withColumn("copied", F.col("rep").isNotNull())
        .withColumn("rep", F.coalesce("rep", "doc_id"))
        .join(cover, "rep", "left")
        .select(
            "doc_id",
            "rep",
            "n_chars",
            F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0))).alias("shared_chars"),
            F.when(F.col("copied") & (F.col("rep") != F.col("doc_id")), F.col("n_chars")).otherwise(F.coalesce("m", F.lit(0))).alias("repeated_chars"),
            F.when(F.col("copied"), F.expr("array(named_struct('begin', 0L, 'end', n_chars))")).otherwise(F.coalesce("out", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"))).alias("spans"),
            F.when(F.col("copied") & (F.col("rep") != F.col("doc_id")), F.expr("array(named_struct('begin', 0L, 'end', n_chars))")).otherwise(F.coalesce("lout", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"))).alias("later"),
        )
        .withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
    )
