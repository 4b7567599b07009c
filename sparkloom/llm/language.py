"""Languages of documents and of the passages of mixed ones (problem 3).

Word-first backoff. The model is fitted on the labelled sentences of ``lang_samples``: a known word scores by its log frequency in each
language; an unseen word falls back to the log frequencies of its character n-grams, the longest that were seen, down to single
characters. A line's scores are the sum over its words; within a text a dynamic programme over the lines charges for each change of language,
so that a short line without evidence of its own goes with its neighbours.

The languages are those of the sample, which is bounded (``MAX_SAMPLES``, a documented parameter: of each language as many sentences, drawn by a
hash, as its part of that); everything else runs over all rows, in place, without a shuffle.

Defined results: blank texts and texts without a word of any language have no passage; designations such as ``IS 1234`` or ``S.O. 12(E)``
have no language; a line of designations only belongs to none. Confidence is the posterior probability of the language over the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.tokens import slices

#: Labelled sentences used to fit the model, at most.
MAX_SAMPLES = 20_000
#: Words a worker keeps scored before it starts anew.
KEPT_WORDS = 300_000
#: Cost of a change of language between two lines, in nats.
CHANGE = 3.0

# Usual names and codes of the languages (fixed values).
NAMES = {
    "en": "en eng english anglais englisch angrezi अंग्रेज़ी अंग्रेजी इंग्रजी",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "mr": "mr mar marathi मराठी",
    "bn": "bn ben bengali bangla বাংলা",
    "ta": "ta tam tamil தமிழ்",
    "fr": "fr fra fre french français francais französisch",
    "de": "de deu ger german deutsch allemand",
}
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}

# Designations of standards, orders and schemes, with what belongs to them; numbers and addresses.
DESIGNATION = re.compile(
    r"\bIS[ :-]*\d[\d:]*(?: ?\(Part[^()\n]*\))?|\b(?:S\.O\.|G\.S\.R\.) ?\d+ ?\(E\)|\bScheme-[IVX]+|https?://\S+|\([^()\s]{0,3}\)|\bRs\. ?[\d,]+"
)
EDGES = ".,;:!?()[]{}|\"'*#>•/=_~`“”‘’«»…—–-।"


def label(text: str | None, others: frozenset[str] = frozenset()) -> str | None:
    """The code that a label names in any usual spelling (case, blanks, region, script or full name), else None. ``others`` are codes that
    are known besides those with names here."""
    if text is None:
        return None
    t = text.strip().lower()
    for x in (t, re.split(r"[-_ ,(]", t, maxsplit=1)[0]):
        if (code := CODE_OF.get(x, x if x in others else None)) is not None:
            return code
    return None


class Model:
    """Log frequencies of words and character n-grams in each language."""

    LONGEST = 5
    #: What a word or n-gram that a language lacks is taken to have been seen there.
    UNSEEN = 0.05

    def __init__(self, samples: list[tuple[str, str]]):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in samples:
            words[lang].update(w for raw in DESIGNATION.sub(" ", text).split() if (w := bare(raw)))
        self.langs = sorted(words)
        self.word = self._table({code: words[code] for code in self.langs})
        self.grams = []
        for n in range(1, self.LONGEST + 1):
            counted = {code: Counter() for code in self.langs}
            for code in self.langs:
                for w, k in words[code].items():
                    padded = f"^{w}$"
                    for i in range(len(padded) - n + 1):
                        counted[code][padded[i : i + n]] += k
            self.grams.append(self._table(counted))

    def _table(self, counts: dict[str, Counter]) -> dict[str, np.ndarray]:
        total = [sum(counts[c].values()) + 1 for c in self.langs]
        keys = set().union(*counts.values())
        return {k: np.array([math.log((counts[c][k] + self.UNSEEN) / t) for c, t in zip(self.langs, total, strict=True)]) for k in keys}

    def score(self, word: str) -> np.ndarray:
        """Of one word, by language, shifted so that the best is 0. Known words have full weight; n-grams are averaged."""
        if (known := self.word.get(word)) is not None:
            s = known
        else:
            padded = f"^{word}$"
            found: list[np.ndarray] = []
            at = 0
            # The longest n-gram seen at each place; shorter ones where it is unseen.
            while at < len(padded):
                for n in range(min(self.LONGEST, len(padded) - at), 0, -1):
                    if (g := self.grams[n - 1].get(padded[at : at + n])) is not None:
                        found.append(g * (1.0 if n > 2 else 0.5 if n == 2 else 0.25))
                        break
                at += 1
            if not found:
                return np.zeros(len(self.langs))
            s = np.mean(found, axis=0) * min(1.0, len(found) / 8)
        return np.maximum(s - s.max(), -8.0)


def bare(raw: str) -> str:
    """A word in lower case without marks at its ends; empty if it has a digit or no letter."""
    w = raw.strip(EDGES).lower()
    return w if w and not any(c.isdigit() for c in w) and any(c.isalpha() for c in w) else ""


class Detector:
    """Scores lines by words, keeping the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.rows: list[np.ndarray] = [np.zeros(len(self.model.langs) + 1)]
        self.matrix = np.zeros((1, len(self.model.langs) + 1))

    def _learn(self, raw: str) -> int:
        w = bare(raw)
        if not w:
            self.cache[raw] = 0
            return 0
        # Compounds count part by part, so that "low-voltage" needs no entry of its own.
        scored = np.append(sum(self.model.score(p) for p in re.split(r"[-/|]", w) if p), 1.0) if w not in self.model.word else np.append(self.model.score(w), 1.0)
        self.rows.append(scored)
        self.cache[raw] = len(self.rows) - 1
        return len(self.rows) - 1

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines of the texts: scores by language, counted words, and the index of each text's first line."""
        if len(self.cache) > KEPT_WORDS:
            self._reset()
        cleaned = DESIGNATION.sub(" ", "\n".join(texts)).split("\n")
        per_line = [line.split() for line in cleaned]
        sizes = np.fromiter(map(len, per_line), np.int64, len(per_line))
        get = self.cache.get
        codes = [c if (c := get(w)) is not None else self._learn(w) for ws in per_line for w in ws]
        if len(self.rows) > len(self.matrix):
            self.matrix = np.array(self.rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.zeros((len(sizes), len(self.model.langs) + 1))
        filled = np.flatnonzero(sizes)
        if len(filled):
            sums[filled] = np.add.reduceat(self.matrix[np.array(codes, np.int64)], ends[filled], axis=0)
        counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        return sums[:, :-1], sums[:, -1], np.cumsum(counts) - counts


def passages(scores: np.ndarray, words: np.ndarray) -> list[tuple[int, int, float]]:
    """(line, language, confidence) of each passage; lines without words of a language belong to none."""
    of = np.flatnonzero(words > 0)
    if not len(of):
        return []
    s = scores[of]
    best = s.argmax(axis=1)
    top2 = np.partition(s, -2, axis=1)[:, -2:]
    if len(of) > 1 and ((top2[:, 1] - top2[:, 0]) < 2 * CHANGE).any() and len(np.unique(best)) > 1:
        best = _smoothed(s)
    out, begin = [], 0
    for k in range(1, len(of) + 1):
        if k == len(of) or best[k] != best[begin]:
            total = s[begin:k].sum(axis=0)
            p = 1.0 / np.exp(np.clip(total - total[best[begin]], -60, 60)).sum()
            out.append((int(of[begin]) + 1, int(best[begin]), float(p)))
            begin = k
    return out


def _smoothed(s: np.ndarray) -> np.ndarray:
    """The likeliest languages of the lines when each change costs ``CHANGE``."""
    n = len(s)
    back = np.zeros(s.shape, np.int64)
    at = s[0]
    for k in range(1, n):
        j = int(at.argmax())
        moved = at[j] - CHANGE
        back[k] = np.where(at >= moved, np.arange(s.shape[1]), j)
        at = np.maximum(at, moved) + s[k]
    out = np.empty(n, np.int64)
    out[-1] = int(at.argmax())
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def labelled_sentences(samples: DataFrame, limit: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """(code, text) of at most ``limit`` labelled rows (sample_id, lang, text), in order; of each label the same share of its rows, and
    the rows with the least hashes, so that no language is left out."""
    rows = samples.where("text is not null and lang is not null").select("sample_id", "lang", "text")
    sizes = rows.groupBy("lang").count().collect()
    part = min(1.0, limit / max(1, sum(r["count"] for r in sizes)))
    # A few more than its share of each label by the hash, then exactly its share.
    want = {r["lang"]: max(1, int(part * r["count"])) for r in sizes}
    near = rows if part == 1.0 else rows.where(F.pmod(F.xxhash64("lang", "sample_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * part + 1e-4)))
    kept = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("lang", "sample_id", "text"), "sample_id")))
    found = [r for r in kept.where(F.col("k") <= limit).orderBy("sample_id", "lang", "text").collect() if r.k <= want[r.lang]]
    others = frozenset(r["lang"].strip().lower() for r in sizes if re.fullmatch(r"[a-z]{2,3}", r["lang"].strip().lower()))
    return [(code, r.text) for r in found if (code := label(r.lang, others))]


def fitted(sentences: list[tuple[str, str]]) -> Model:
    return Model(sentences)


def languages(df: DataFrame, samples: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each passage: id, line_no (of its first line), lang, confidence, n_passages of the text, and ``labelled``, the language
    that the old label names (null if none)."""
    model = df.sparkSession.sparkContext.broadcast(fitted(labelled_sentences(samples)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model.value)
        names_of, others = model.value.langs, frozenset(model.value.langs)
        labels: dict[str | None, str | None] = {}
        names = [id_col, "line_no", "lang", "confidence", "n_passages", "labelled"]
        kinds = [None, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string()]
        for batch in batches:
            for part in slices(batch, 500):
                ids, langs, texts = (part.column(k).to_pylist() for k in range(3))
                scores, words, at = detector.lines([t or "" for t in texts])
                ends = [*at[1:].tolist(), len(words)]
                out: list[tuple] = []
                for i, old, b, e in zip(ids, langs, at.tolist(), ends, strict=True):
                    found = passages(scores[b:e], words[b:e])
                    if old not in labels:
                        labels[old] = label(old, others)
                    out += [(i, line, names_of[code], p, len(found), labels[old]) for line, code, p in found]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t or part.schema.field(0).type) for c, t in zip(columns, kinds, strict=True)], names=names)

    return df.select(id_col, lang_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, line_no int, lang string, confidence double, n_passages int, labelled string")


def relabelled(df: DataFrame, samples: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The passages of texts whose label is missing, names no language or another than the text's, or that are in several languages."""
    found = languages(df, samples, id_col, text_col, lang_col)
    return found.where((F.col("n_passages") > 1) | F.col("labelled").isNull() | (F.col("labelled") != F.col("lang"))).select(id_col, "line_no", "lang").distinct()
