"""Repair of text recognised from scanned pages (problem 5).

1. Skip-gram vectors with negative sampling are learned on the words of the scanned pages (``learned``): pair counts within ``WINDOW`` places
   add up over partitions; each partition trains the vectors of its own words on mini-batches of its pairs, and the context vectors of all
   partitions are averaged after each round. The vocabulary is that of the frequent words (``FREQUENT`` and ``FREQUENT_SHARE``), so the
   vectors are bounded: at most 1 / ``FREQUENT_SHARE`` words.
2. Words much rarer than a frequent word that differs only by plausible glyph edits are candidates for it. Both have the same *skeleton*, a
   spelling in which glyphs that are mistaken for each other are one, so candidates meet in an equi-join.
3. A rare word is linked to a candidate that is a neighbour of it: over the contexts of all its occurrences the candidate's vector scores
   above ``NEAR``. Each occurrence is then corrected in its own context, to the linked word with the best frequency and score there.
4. Furniture (running heads and feet, printed page numbers) is found by its repetition at the edges of a source's pages, counted over all
   pages, and by the page's number; then split words are joined and lines reflowed into paragraphs.

Defined results: null and blank texts give nothing; a chunk given twice counts once; a source missing from the page list has no scans; an
occurrence without a frequent neighbour is corrected as its word's other occurrences say, and a word that never has one stays.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.pages import once
from sparkloom.runtime import broadcast_if_small, cut

DIMS = 24
WINDOW = 2
#: A word is rare next to one this many times as frequent.
RARER = 15
#: A frequent word stands at least so often, and makes up at least this share of all words.
FREQUENT = 15
FREQUENT_SHARE = 2e-6
#: Rounds of training, passes over the pairs in each, noise words for each pair, pairs in a mini-batch, step.
ROUNDS, PASSES, NOISE, BATCH, STEP = 2, 5, 4, 20_000, 0.25
#: Mean score over its contexts above which a candidate is a neighbour of a rare word (0 is that of the average word), and what a score
#: weighs beside the log frequency.
NEAR = 0.0
CONTEXT = 2.0
#: Share of a source's scanned chunks whose edge a running head or foot must take.
EDGE_SHARE = 0.2

HYPHENS = "-‐‑¬­"
LIGATURES = re.compile("[ﬀ-ﬆ]")
WORD = re.compile(r"[^\s.,;:()\[\]{}\"“”/<>=+*#_—–\-‐‑¬­]+")
PAGE_LINE = re.compile(r"^\W*(?P<page>(?:page|pg|p)\b\.?)?\W*(?P<n>[\dlIOoSB|!]{1,5})\W*(?:of\W*[\dlIOoSB|!]{1,5}\W*)?$", re.I)
# Letters and signs that stand for another glyph, and pairs of letters that look like one (fixed values).
ONE = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "6": "b", "!": "l", "|": "l", "§": "s", "¢": "c", "i": "l", "c": "e", "b": "h", "f": "t", "q": "g"})
PAIRS = (("rn", "m"), ("vv", "w"), ("rl", "n"), ("el", "d"), ("ll", "u"))
# Where pairs overlap ("rll" for "ru" or for "nl") either may be meant, so each word has a spelling in either order.
ORDERS = (PAIRS, PAIRS[::-1])
DIGIT_FOR = str.maketrans({"O": "0", "o": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "S": "5", "s": "5", "§": "5", "B": "8", "Z": "2", "z": "2", "G": "6", "b": "6", "q": "9", "g": "9"})


def skeleton(word: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> str:
    """One spelling for all words that recognition could turn into each other."""
    w = unicodedata.normalize("NFKD", word.lower())
    w = "".join(c for c in w if not unicodedata.combining(c) or not c < "Ͱ")
    # "c" before "e" so that "cl" and "el" agree; the second pass maps what the first produced ("8" to "b" to "h").
    w = w.translate(ONE).translate(ONE)
    # To the end, as one pair can make another ("rri" is "rn" is "m").
    before = None
    while w != before:
        before = w
        for pair, one in pairs:
            w = w.replace(pair, one)
    return w


def tokens_of(line: str) -> list[str]:
    """Words of a line without marks; a sign inside a word stays."""
    return [w for t in WORD.findall(line) if (w := t.strip("'‘’?").rstrip("!|"))]


def bad_number(token: str) -> bool:
    """A number in which a letter or sign stands for a digit."""
    if not any(c.isdigit() for c in token) or token.isdigit():
        return False
    return len(token) > 1 and token.translate(DIGIT_FOR).isdigit()


def scanned(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """The chunks that stand on a scanned page of their source, each once."""
    pages = parsed.where("source_id is not null").select("source_id", F.explode("ocr_pages").alias("page")).where("page is not null").distinct()
    rows = chunks.where("page is not null and chunk_id is not null and text is not null").select("chunk_id", "source_id", "page", "text")
    return once(cut(rows.join(broadcast_if_small(cut(pages)), ["source_id", "page"])), "chunk_id")


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) over all chunks, in lower case; counted within partitions before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            words: Counter = Counter()
            for raw, n in counts.items():
                for w in tokens_of(raw):
                    if any(c.isalpha() for c in w):
                        words[w.lower()] += n
            counts.clear()
            return pd.DataFrame({"word": list(words), "n": list(words.values())}).astype({"word": "str", "n": "int64"})

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                counts.update(" ".join(t for t in pdf["text"].iloc[at : at + 500] if t).split())
            if len(counts) > 400_000:
                yield out()
        yield out()

    return chunks.where("text is not null").select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> dict[str, tuple[int, int]]:
    """(id, n) of each frequent word, ids in order of the words; at most 1 / ``FREQUENT_SHARE`` words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(FREQUENT, FREQUENT_SHARE * total)).orderBy("word").collect()
    return {r.word: (i, r.n) for i, r in enumerate(rows)}


def sequences(pages: DataFrame, ids: dict[str, tuple[int, int]]) -> DataFrame:
    """(chunk_id, words, ids, lines, nexts, lefts): the words of each page in order, with their ids among the frequent ones (else -1) and
    their lines. A split word is one word; nexts and lefts are the line it goes on in and the part before the split, else null."""
    known = pages.sparkSession.sparkContext.broadcast({w: i for w, (i, _) in ids.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for pdf in batches:
            rows = []
            for cid, text in pdf[["chunk_id", "text"]].itertuples(index=False):
                lines = [(k, s) for k, line in enumerate(text.split("\n"), 1) if (s := line.strip(" \t\r ​﻿　"))]
                words, nos, nexts, lefts, skip = [], [], [], [], False
                for at, (no, s) in enumerate(lines):
                    own = [w.lower() for w in tokens_of(s)][int(skip) :]
                    skip = _goes_on(s, at + 1 < len(lines))
                    if skip:
                        behind = tokens_of(lines[at + 1][1])
                        left = own.pop() if own else ""
                        words += [*own, left + (behind[0].lower() if behind else "")]
                        nexts += [None] * len(own) + [lines[at + 1][0]]
                        lefts += [None] * len(own) + [left]
                        nos += [no] * (len(own) + 1)
                    else:
                        words += own
                        nexts += [None] * len(own)
                        lefts += [None] * len(own)
                        nos += [no] * len(own)
                rows.append((cid, words, [get(w, -1) for w in words], nos, nexts, lefts))
            yield pd.DataFrame(rows, columns=["chunk_id", "words", "ids", "lines", "nexts", "lefts"])

    return pages.select("chunk_id", "text").mapInPandas(run, "chunk_id string, words array<string>, ids array<int>, lines array<int>, nexts array<int>, lefts array<string>")


def pair_counts(seqs: DataFrame, size: int) -> DataFrame:
    """(w, c, n): how often the frequent word c stands within ``WINDOW`` places of the frequent word w; all pairs of w in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                seq = np.concatenate([np.append(x, [-1] * WINDOW) for x in pdf["ids"].iloc[at : at + 500]]).astype(np.int64)
                more = []
                for k in range(1, WINDOW + 1):
                    a, b = seq[:-k], seq[k:]
                    ok = (a >= 0) & (b >= 0)
                    more += [a[ok] * size + b[ok], b[ok] * size + a[ok]]
                new = np.concatenate(more)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(back, weights=np.concatenate([times, np.ones(len(new))]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield pd.DataFrame({"w": keys // size, "c": keys % size, "n": times})
                    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"w": keys // max(size, 1), "c": keys % max(size, 1), "n": times})

    part = seqs.select("ids").mapInPandas(run, "w long, c long, n long")
    return part.repartition("w").groupBy("w", "c").agg(F.sum("n").alias("n"))


def trained(w: np.ndarray, c: np.ndarray, n: np.ndarray, words: np.ndarray, contexts: np.ndarray, noise: np.ndarray, seed: int) -> None:
    """Skip-gram with negative sampling on weighted pairs, in place. Each word's pairs weigh 1 together, and steps shrink as a row moves."""
    rng = np.random.default_rng(seed)
    weight = (n / np.bincount(w, weights=n, minlength=len(words))[w]).astype(np.float32)
    moved = [np.full(len(words), 1e-3, np.float32), np.full(len(words), 1e-3, np.float32)]

    def step(matrix: np.ndarray, rows: np.ndarray, gradient: np.ndarray, past: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
        g, at = np.add.reduceat(gradient[order], first, axis=0), rows[order][first]
        past[at] += (g * g).mean(axis=1)
        matrix[at] += STEP * g / np.sqrt(past[at])[:, None]

    for _ in range(PASSES):
        order = rng.permutation(len(w))
        for k in range(0, len(w), BATCH):
            x = order[k : k + BATCH]
            a, b, t = w[x], c[x], weight[x]
            false = np.searchsorted(noise, rng.random((len(x), NOISE), np.float32)).clip(max=len(words) - 1)
            va, vb, vf = words[a], contexts[b], contexts[false]
            up = t * (1 - _sigmoid((va * vb).sum(1)))
            down = t[:, None] * -_sigmoid(np.einsum("ij,ikj->ik", va, vf)) / 2
            step(words, a, up[:, None] * vb + np.einsum("ik,ikj->ij", down, vf), moved[0])
            # A context's gradient is of all words beside it: weighed as often as these are.
            step(contexts, np.concatenate([b, false.ravel()]), np.concatenate([up[:, None] * va, (down[:, :, None] * va[:, None, :]).reshape(-1, va.shape[1])]), moved[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learned(seqs: DataFrame, ids: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the frequent words, as words and as contexts. Both are bounded by the vocabulary; the pairs never leave their partitions."""
    size = len(ids)
    rng = np.random.default_rng(1)
    words, contexts = (rng.standard_normal((size, DIMS)).astype(np.float32) * 0.2 for _ in range(2))
    if not size:
        return words, contexts
    often = np.array([n for _, n in ids.values()], np.float64) ** 0.75
    noise = np.cumsum(often / often.sum()).astype(np.float32)
    pairs = cut(pair_counts(seqs, size))
    sc = seqs.sparkSession.sparkContext
    for at in range(ROUNDS):
        now = sc.broadcast((words, contexts, noise))

        def run(batches: Iterator[pd.DataFrame], now=now, at=at) -> Iterator[pd.DataFrame]:
            parts = [p for p in batches if len(p)]
            if not parts:
                return
            w, c, n = (np.concatenate([p[k].to_numpy() for p in parts]) for k in ("w", "c", "n"))
            order = np.lexsort((c, w))
            w, c, n = w[order], c[order], n[order]
            mine, beside, q = (x.copy() for x in now.value)
            trained(w, c, n, mine, beside, q, at)
            own = np.unique(w)
            met, back = np.unique(c, return_inverse=True)
            yield pd.DataFrame({"kind": 0, "id": own, "k": 1.0, "v": list(mine[own].astype(np.float64))})
            # Contexts are averaged by how often they were met.
            k = np.bincount(back, weights=n)
            yield pd.DataFrame({"kind": 1, "id": met, "k": k, "v": list(beside[met].astype(np.float64) * k[:, None])})

        new = pairs.mapInPandas(run, "kind int, id long, k double, v array<double>").groupBy("kind", "id")
        new = new.agg(F.sum("k").alias("k"), F.array(*[F.sum(F.col("v")[d]) for d in range(DIMS)]).alias("v")).toPandas()
        words, contexts = words.copy(), contexts.copy()
        for kind, matrix in ((0, words), (1, contexts)):
            rows = new[new["kind"] == kind]
            if len(rows):
                matrix[rows["id"].to_numpy()] = np.stack(rows["v"].to_list()) / rows["k"].to_numpy()[:, None]
        now.unpersist()
    # Scores against the average word: a context then speaks for a word, not for words as such.
    return words - words.mean(axis=0), contexts


def _skeletons(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf.assign(skeleton=[f"{k}{skeleton(w, pairs)}" for w in pdf["word"]]) for k, pairs in enumerate(ORDERS)])

    return df.mapInPandas(run, "word string, n long, skeleton string")


def candidates(counts: DataFrame, seqs: DataFrame, ids: dict[str, tuple[int, int]]) -> DataFrame:
    """(word, fix, n_fix): the words of the scanned pages with the frequent words of the same skeleton that are ``RARER`` times as frequent."""
    here = seqs.select(F.explode("words").alias("word")).where(F.col("word").rlike(r"\p{L}")).distinct()
    least = min((n for _, n in ids.values()), default=(1 << 63) - 1)
    keyed = cut(_skeletons(counts.where(F.length("word") > 1)))
    often = keyed.where(F.col("n") >= least).select(F.col("word").alias("fix"), F.col("n").alias("n_fix"), "skeleton")
    # Words joined from two lines may stand nowhere else, so they aren't in the counts.
    joined = _skeletons(here.join(counts, "word", "left_anti").select("word", F.lit(1).cast("long").alias("n")))
    rare = keyed.join(here, "word", "left_semi").unionByName(joined)
    return rare.join(often, "skeleton").where(f"word != fix and n_fix >= {RARER} * n").select("word", "fix", "n_fix").distinct()


def corrections(counts: DataFrame, seqs: DataFrame, ids: dict[str, tuple[int, int]], vectors: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(chunk_id, at, word, fix, line_no, next_line, l): the occurrences to be corrected, each in its own context."""
    found = broadcast_if_small(cut(candidates(counts, seqs, ids)))
    each = seqs.select("chunk_id", "ids", F.posexplode(F.arrays_zip("words", "lines", "nexts", "lefts")).alias("at", "x"))
    around = F.slice("ids", F.greatest(F.col("at") + 1 - WINDOW, F.lit(1)), F.least(F.col("at"), F.lit(WINDOW)))
    behind = F.slice("ids", F.col("at") + 2, F.lit(WINDOW))
    each = each.select("chunk_id", "at", F.col("x.words").alias("word"), F.col("x.lines").alias("line_no"), F.col("x.nexts").alias("next_line"), F.col("x.lefts").alias("l"), F.filter(F.concat(around, behind), lambda i: i >= 0).alias("near"))
    model = seqs.sparkSession.sparkContext.broadcast((*vectors, {w: i for w, (i, _) in ids.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, contexts, of = model.value
        for pdf in batches:
            score = [float(contexts[near].mean(axis=0) @ words[of[fix]]) if len(near) else None for fix, near in zip(pdf["fix"], pdf["near"], strict=True)]
            yield pdf.drop(columns="near").assign(score=np.array(score, object), next_line=pdf["next_line"].astype("Int64"))

    schema = "word string, chunk_id string, at int, line_no int, next_line int, l string, fix string, n_fix long, score double"
    scored = cut(each.join(found, "word").select("word", "chunk_id", "at", "line_no", "next_line", "l", "fix", "n_fix", "near").mapInPandas(run, schema))
    links = scored.groupBy("word", "fix").agg(F.avg("score").alias("mean")).where(f"mean > {NEAR}")
    linked = scored.join(broadcast_if_small(cut(links)), ["word", "fix"])
    fit = F.log("n_fix") + CONTEXT * F.coalesce("score", "mean")
    rest = ("line_no", "next_line", "l")
    best = linked.groupBy("chunk_id", "at", "word").agg(F.max_by(F.struct("fix", *rest), F.struct(fit, "fix")).alias("b"))
    return best.select("chunk_id", "at", "word", "b.*")


def analysed(pages: DataFrame) -> DataFrame:
    """One row for each line that is not blank, with what furniture, splits and glyphs are judged by.

    sig: the letters' skeleton without numbers; edge: whether one of the two outer lines; number: a printed page number or null; styled:
    whether it has marks or a word around it; split: ends within a word; glyph: holds a sign no print has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, sid, page, text in pdf[["chunk_id", "source_id", "page", "text"]].itertuples(index=False):
                lines = [(k, s) for k, line in enumerate(text.split("\n"), 1) if (s := line.strip(" \t\r ​﻿　"))]
                for at, (no, s) in enumerate(lines):
                    letters = "".join(c for w in s.split() if 2 * sum(map(str.isdigit, w)) < len(w) for c in w if c.isalnum() or c in "!|§¢")
                    m = PAGE_LINE.match(s)
                    number = None
                    if m and (d := m["n"].translate(DIGIT_FOR)).isdigit() and any(c.isdigit() for c in m["n"]):
                        number = int(d)
                    split = _goes_on(s, bool(lines[at + 1 :]))
                    glyph = bool(LIGATURES.search(s)) or any(bad_number(w) or _has_sign(w) for w in tokens_of(s))
                    rows.append((cid, sid, int(page), no, at < 2 or at >= len(lines) - 2, zlib.crc32(skeleton(letters).encode()) if letters else None, len(letters), number, bool(m and (m["page"] or not s.isalnum())), split, glyph))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE_SCHEMA.split(", ")]).astype({"sig": "Int64", "number": "Int64"})

    return pages.select("chunk_id", "source_id", "page", "text").mapInPandas(run, LINE_SCHEMA)


LINE_SCHEMA = "chunk_id string, source_id string, page int, line_no int, edge boolean, sig long, letters int, number long, styled boolean, split boolean, glyph boolean"


def _goes_on(line: str, more: bool) -> bool:
    """The line ends within a word: in a hyphen after a letter or digit, with more text behind."""
    return more and len(line) > 1 and line[-1] in HYPHENS and line[-2].isalnum()



def _has_sign(word: str) -> bool:
    """A sign inside a word of letters."""
    return any(c in "¢§!|" for c in word) and sum(c.isalpha() for c in word) >= 1 and len(word) > 1


def furniture(lines: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of running heads and feet and printed page numbers.

    A head or foot has the same skeleton at the edge of at least 2 chunks and ``EDGE_SHARE`` of the source's scanned chunks; wherever it then
    stands in the source it is one (a page can change inside a chunk). A number is one if it is that of the page or the next.
    """
    total = lines.groupBy("source_id").agg(F.count_distinct("chunk_id").alias("n"))
    edges = lines.where("edge and letters > 0").groupBy("source_id", "sig").agg(F.count_distinct("chunk_id").alias("k"), F.max("letters").alias("letters"))
    heads = edges.join(total, "source_id").where(f"k >= 2 and k >= {EDGE_SHARE} * n").select("source_id", "sig")
    repeated = lines.join(broadcast_if_small(cut(heads)), ["source_id", "sig"]).where("edge or letters >= 12")
    numbers = lines.where("number between page and page + 1")
    return repeated.select("chunk_id", "line_no").unionByName(numbers.select("chunk_id", "line_no")).distinct()


def glyph_lines(fixes: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of the words to be corrected; of a split word the line that holds the wrong glyph."""
    single = fixes.where("l is null").select("chunk_id", "line_no")
    # The line holds the wrong glyph if its part of the word isn't the beginning, or the end, of the right one.
    joined = fixes.where("l is not null")
    first = joined.where("not startswith(fix, l)").select("chunk_id", "line_no")
    second = joined.where("not endswith(fix, substring(word, length(l) + 1))").select("chunk_id", F.col("next_line").alias("line_no"))
    return single.unionByName(first).unionByName(second)


def prepared(chunks: DataFrame, parsed: DataFrame, vectors=learned) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, lines, furniture, corrections), each cut. ``vectors`` gives the vectors of words and contexts."""
    pages = scanned(chunks, parsed)
    lines = cut(analysed(pages))
    counts = cut(word_counts(chunks))
    ids = frequent(counts)
    seqs = cut(sequences(pages, ids))
    fixes = cut(corrections(counts, seqs, ids, vectors(seqs, ids)))
    return pages, lines, cut(furniture(lines)), fixes


def repairs(chunks: DataFrame, parsed: DataFrame, vectors=learned) -> DataFrame:
    """(chunk_id, line_no, kind): the lines to be repaired, kind furniture, split or glyph."""
    _, lines, out, fixes = prepared(chunks, parsed, vectors)
    kind = lambda df, k: df.select("chunk_id", "line_no", F.lit(k).alias("kind"))
    other = kind(lines.where("split"), "split").unionByName(kind(lines.where("glyph"), "glyph")).unionByName(kind(glyph_lines(fixes), "glyph"))
    return kind(out, "furniture").unionByName(other.join(out, ["chunk_id", "line_no"], "left_anti")).distinct()


def repaired(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """(chunk_id, text): the scanned chunks without furniture, with corrected words, split words joined, lines reflowed into paragraphs."""
    pages, lines, out, fixes = prepared(chunks, parsed)
    gone = out.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    wrong = fixes.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "line_no", "word", "fix"))).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "text": [reflow(t, set(() if g is None else g), [(x["line_no"], x["word"], x["fix"]) for x in (() if f is None else f)]) for t, g, f in zip(pdf["text"], pdf["gone"], pdf["fixes"], strict=True)]})

    return pages.join(gone, "chunk_id", "left").join(wrong, "chunk_id", "left").select("chunk_id", "text", "gone", "fixes").mapInPandas(run, "chunk_id string, text string")


def reflow(text: str, gone: set[int], fixes: list[tuple[int, str, str]]) -> str:
    """The paragraphs of a page: furniture dropped, words corrected, split words joined. A blank line or a heading parts paragraphs.

    ``fixes`` are (line, word, fix) in the page's order; a word's occurrences take theirs in turn.
    """
    left: dict[str, list[str]] = {}
    for no, word, fix in reversed(fixes):
        if no not in gone:
            left.setdefault(word, []).append(fix)

    def corrected(w: str) -> str:
        own = left.get(w.lower())
        if not own:
            return unicodedata.normalize("NFKC", w) if LIGATURES.search(w) else w.translate(DIGIT_FOR) if bad_number(w) else w
        fix = own.pop() if len(own) > 1 else own[0]
        return fix.upper() if w.isupper() and len(w) > 1 else fix.capitalize() if w[:1].isupper() or not w[:1].isalpha() and fix[:1].isupper() else fix

    paragraphs: list[str] = [""]
    for no, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if no in gone:
            continue
        if not s:
            if paragraphs[-1] and paragraphs[-1][-1] not in HYPHENS:
                paragraphs.append("")
            continue
        last = paragraphs[-1]
        if s.startswith("#") and last:
            paragraphs.append(s)
        elif last and last[-1] in HYPHENS and last[-2:-1].isalnum():
            # The word's own hyphen stays where both parts are words of their own, as far as this page shows.
            part = WORD.search(s)
            own = last[-1] == "-" and part is not None and not s[0].islower()
            paragraphs[-1] = last + s if own else last[:-1] + s
        else:
            paragraphs[-1] = f"{last} {s}" if last and not last.startswith("#") else s if not last else last + "\n" + s
    done = (WORD.sub(lambda m: corrected(m[0]), p) for p in paragraphs if p)
    return "\n\n".join(done)


