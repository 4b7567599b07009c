"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Speculate and verify. Within each Arrow batch the texts are cut into words with vectorised character classes, each distinct word is
proposed as tokens by greedy longest match, every adjacent pair of proposed tokens is tested for compatibility in one vectorised pass, and
only the words with an incompatible pair are merged exactly. Words repeat, so a worker keeps what it has encoded. Words are looked up by a
digest, and every word that is found is compared with the one kept character by character; a slice in which one differs is encoded by its
words' strings instead.

The vocabulary file is read by the driver and sent to the executors; its size doesn't depend on the data.

Defined results: a null and an empty text have an empty list; the text is otherwise taken as it is, special tokens' strings included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.json"

#: Characters handled at once; bounds a worker's memory whatever the length of the texts.
SLICE = 600_000
#: Distinct words, and characters of them, that a worker keeps encoded before it starts anew.
KEPT_WORDS, KEPT_CHARS = 400_000, 8_000_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space, other."""
    of = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            of[c] = LETTER
        elif kind == "N":
            of[c] = NUMBER
    # The characters with Unicode's White_Space property (fixed values).
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    of[spaces] = SPACE
    return of


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash's odd base and of its inverse modulo 2**64."""
    return _powers(1 << max(10, (n - 1).bit_length()))


class Vocabulary:
    """Token ids, the merges behind them, and the arrays for the vectorised tests."""

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        # Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in byte_of for c in s)}
        n = max(self.ids.values()) + 1
        self.left, self.right, self.born = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            z = self.ids[raw(a) + raw(b)]
            self.merge.setdefault((x, y), (rank, z))
            if not self.born[z]:
                self.left[z], self.right[z], self.born[z] = x, y, rank + 1
        keys = np.fromiter((x << 32 | y for x, y in self.merge), np.int64, len(self.merge))
        ranks = np.fromiter((r + 1 for r, _ in self.merge.values()), np.int64, len(self.merge))
        order = np.argsort(keys)
        self.pair_keys, self.pair_born = keys[order], ranks[order]
        self.longest = max(map(len, self.ids))
        self.compatible: dict[int, bool] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left; every single byte is a token, so it always ends."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := self.ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def verify(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether the tokens ``a`` and ``b`` stay apart when their joined bytes are merged.

        Undoes the later of the two tokens' last merges step by step; a merge across the border that would have come before the undone one
        (or, with the same rank, further left) refutes the pair.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crosses = (self.pair_keys[at] == key) & (self.pair_born[at] < limit[live])
            ok[live[crosses]] = False
            live = live[~crosses]
            x, y = a[live], b[live]
            bx, by = self.born[x], self.born[y]
            goes_on = (bx > 0) | (by > 0)
            live, x, y, bx, by = live[goes_on], x[goes_on], y[goes_on], bx[goes_on], by[goes_on]
            undo_left = bx > by
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, bx, by + 1)
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals; for the words whose proposal failed."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 200:
            return self._merged_long(parts)
        while len(parts) > 1:
            best = min(((m[0], i, m[1]) for i in range(len(parts) - 1) if (m := self.merge.get((parts[i], parts[i + 1])))), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long words."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            if gone[i] or parts[i] != x or (j := after[i]) >= n or parts[j] != y:
                continue
            parts[i], gone[j], after[i] = z, True, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge.get((z, parts[after[i]])):
                    heapq.heappush(heap, (m[0], i, z, parts[after[i]], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((parts[h], z))):
                heapq.heappush(heap, (m[0], h, parts[h], z, m[1]))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Proposals for all words, one compatibility test for all their adjacent pairs, exact merging for the words that fail."""
        out = [self.propose(w) for w in words]
        many = [k for k, p in enumerate(out) if len(p) > 1]
        if many:
            flat = np.concatenate([np.array(out[k], np.int64) for k in many])
            of = np.repeat(np.array(many), [len(out[k]) for k in many])
            inside = of[1:] == of[:-1]
            pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
            fits = self.verify(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            for k in set(of[1:][inside][~fits].tolist()):
                out[k] = self.merged(words[k])
        return out


@lru_cache(2)
def vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def vocabulary_file(path: str | None = None, tokenizers: str = TOKENIZERS) -> bytes:
    with open(path or os.path.join(tokenizers, BYTE_BPE_50K), "rb") as f:
        return f.read()


_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")


def _pieces(text: str) -> list[str]:
    """A very long text cut where a letter, a blank and a letter meet: a word always starts at that blank."""
    out, at = [], 0
    while len(text) - at > 2 * SLICE:
        cut = next((m.end() for m in _SAFE.finditer(text, at + SLICE)), None)
        if cut is None:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a word starts, by the published pattern of the tokenizer (see ``public_tokenizers.PATTERN``).

    ``first`` is true at the first character of each text. Runs of one class are words; a blank joins the run after it; of other white space
    before a run the last character stands alone; an apostrophe of its own takes s, t, m, d, re, ve or ll with it.
    """
    n = len(codes)
    kind = _classes()[codes]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | first[1:]
    after_space = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after_space - 1] = True
    start[after_space] = codes[after_space - 1] != 32
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    one = quote[np.isin(codes[quote + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]
    two = quote[quote + 2 < n]
    two = two[~first[two + 2]]
    x, y = codes[two + 1], codes[two + 2]
    two = two[((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))]
    for at, length in ((one, 1), (two, 2)):
        start[at + 1] = False
        end = at + 1 + length
        start[end[end < n]] = True
    return start


class Encoder:
    """Encodes batches of texts; keeps the words it has met."""

    def __init__(self, file: bytes):
        self.vocab = vocabulary(file)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        # The kept words' characters, and where each word's begin.
        self.chars = np.zeros(0, np.uint32)
        self.char_at = np.zeros(0, np.int64)
        self.char_n = np.zeros(0, np.int64)

    def _learn(self, digests: np.ndarray, words: list[bytes], codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        coded = self.vocab.encode_words(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))
        at = np.cumsum(sizes) - sizes + len(self.flat)
        known = np.concatenate([self.known, digests])
        order = np.argsort(known)
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]
        self.flat = np.concatenate([self.flat, flat])
        char_at = np.cumsum(length) - length
        chars = codes[np.repeat(begin - char_at, length) + np.arange(int(length.sum()))]
        self.char_at = np.concatenate([self.char_at, char_at + len(self.chars)])[order]
        self.char_n = np.concatenate([self.char_n, length])[order]
        self.chars = np.concatenate([self.chars, chars])

    def _slice(self, texts: list[str], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the texts, and all their ids in a row."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        total = np.zeros(len(texts), np.int64)
        if not joined:
            return total, np.zeros(0, np.int32)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        offsets = np.cumsum(lengths) - lengths
        first = np.zeros(n, bool)
        first[offsets[lengths > 0]] = True
        s = np.flatnonzero(word_starts(codes, first))
        e = np.append(s[1:], n)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            digest = (sums[e] - sums[s]) * down[s]
        del sums
        found, back_at, back = np.unique(digest, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS or len(self.chars) > KEPT_CHARS:
            self._forget()
        at = np.searchsorted(self.known, found)
        hit = np.zeros(len(found), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == found[inside]
        if not hit.all():
            new = np.flatnonzero(~hit)
            where = back_at[new]
            self._learn(found[new], [joined[i:j].encode("utf-8", "surrogatepass") for i, j in zip(s[where].tolist(), e[where].tolist(), strict=True)], codes, s[where], (e - s)[where])
            at = np.searchsorted(self.known, found)
        text_of = np.searchsorted(offsets, s, side="right") - 1
        kept = at[back]
        # Two words may have one digest: each is compared with the word kept under it.
        if not ((self.char_n[kept] == e - s).all() and (self.chars[np.repeat(self.char_at[kept] - s, e - s) + np.arange(n)] == codes).all()):
            return self._by_strings(joined, s.tolist(), e.tolist(), text_of, len(texts), counts_only)
        size = self.size[at][back]
        total = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        if counts_only:
            return total, np.zeros(0, np.int32)
        ends = np.cumsum(size)
        begin = np.repeat(self.at[at][back] - (ends - size), size)
        return total, self.flat[begin + np.arange(ends[-1] if len(ends) else 0)]

    def _by_strings(self, joined: str, begin: list[int], end: list[int], text_of: np.ndarray, n: int, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``_slice`` without digests."""
        words = [joined[i:j] for i, j in zip(begin, end, strict=True)]
        once = list(dict.fromkeys(words))
        ids = dict(zip(once, self.vocab.encode_words([w.encode("utf-8", "surrogatepass") for w in once]), strict=True))
        total = np.bincount(text_of, weights=[len(ids[w]) for w in words], minlength=n).astype(np.int64)
        return total, np.zeros(0, np.int32) if counts_only else np.array([i for w in words for i in ids[w]], np.int32)

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the texts, and all ids in a row (none with ``counts_only``)."""
        counts, flats = np.zeros(len(texts), np.int64), []
        batch: list[str] = []
        of: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal batch, of, held
            if batch:
                c, f = self._slice(batch, counts_only)
                np.add.at(counts, of, c)
                flats.append(f)
            batch, of, held = [], [], 0

        for k, t in enumerate(texts):
            for piece in _pieces(t) if t else ():
                batch.append(piece)
                of.append(k)
                held += len(piece)
                if held >= SLICE:
                    flush()
        flush()
        return counts, np.concatenate(flats) if flats else np.zeros(0, np.int32)


def encoded(df: DataFrame, id_col: str, text_col: str, path: str | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and the column ``ids``, the token ids of ``text_col``. Rows stay in their partitions; nothing is shuffled."""
    file = df.sparkSession.sparkContext.broadcast(vocabulary_file(path, tokenizers))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(file.value)
        for batch in batches:
            for part in slices(batch):
                counts, flat = coder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str, path: str | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of tokens of ``text_col`` (0 for null and empty texts)."""
    file = df.sparkSession.sparkContext.broadcast(vocabulary_file(path, tokenizers))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(file.value)
        for batch in batches:
            for part in slices(batch):
                counts, _ = coder.encode(part.column(len(keep)).to_pylist(), counts_only=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts)], names=[*keep, "n_tokens"])

    return df.select(*keep, text_col).mapInArrow(run, f"{schema}, n_tokens long")


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``rows`` rows, so that texts are turned into Python strings a few at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


if sys.byteorder != "little":  # pragma: no cover
    raise ImportError("code points are read as little-endian")
