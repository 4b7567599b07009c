"""Defects of prompt and response pairs (problem 6).

For each pair: a suffix automaton of the prompt measures how much of the response is copied from it (built only where the response holds one
of the blocks of which any long enough copied stretch must hold one); an automaton of refusal phrases finds the sentences that decline, and
whether anything else is said; a stack of delimiters and the last sentence's end tell a broken-off text; stopwords vote for the languages of
both sides, and where too few of them agree all words do. Stopwords and words are those of the labelled sentences of ``lang_samples``. Pairs are
judged in place, row by row in Arrow batches, without a shuffle; equal rows are reported once.

Defined results: a null answer is empty; a null question can neither be copied nor set a language; must_refuse null counts as false. The first
defect that applies of empty, copy, refusal, truncated, language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from sparkloom.llm.language import CODE_OF, DESIGNATION, EDGES, KEPT_WORDS, Detector, bare, fitted, labelled_sentences

COPIED = 0.85
#: The share of the prompt that one copied stretch must reach for a response to be a copy of it.
STRETCH = 0.5
#: Nats by which a language must lead the prompt's before it counts as another.
MARGIN = 6.0
#: Stopwords of a language, at most; nats that each votes with; votes by which the leader must lead for stopwords to decide alone.
STOPWORDS, VOTE, LEAD = 60, 4.0, 2

# Headings of source and link lists, and labels of answers and questions, in the languages of the tables (fixed values).
SOURCE_HEADS = "sources|source|references|official links|links|स्रोत|संदर्भ|आधिकारिक लिंक|लिंक|quellen|quellenverzeichnis|liens|liens officiels|références|उगम|সূত্র|உசாத்துணை|ஆதாரங்கள்"
LABELS = (
    "short answer|answer|details|detail|question|you asked|q|a|reply|response|note|संक्षिप्त उत्तर|उत्तर|विवरण|प्रश्न|आपने पूछा|प्रश्न था|kurze antwort|antwort|einzelheiten|frage|"
    "réponse courte|réponse|réponse brève|détails|question posée|थोडक्यात उत्तर|तपशील|संक्षिप्त उत्तर|উত্তর|বিবরণ|প্রশ্ন|பதில்|விவரங்கள்|கேள்வி|chhota jawab|jawab|vivaran|sawal"
)
PLACEHOLDERS = set("n/a na none null nil todo tbd tba unknown undefined nan placeholder answer empty pending xxx".split()) | {"no answer", "no response", "lorem ipsum", "not available", "to be done"}
ERROR = re.compile(r"^\W*(?:(?:internal )?(?:error|exception|traceback|fehler|erreur)\b|\w+(?:error|exception)\b|http ?(?:error )?[45]\d\d|[45]\d\d\b.*error|timeout\b|rate ?limit)", re.I)
# What a refusal says, and what may stand beside it without answering, in lower case (fixed values).
REFUSALS = """can't help|cannot help|can not help|unable to|not able to|won't be able|will not be able|i must decline|have to decline|i decline|rather not|not be appropriate
not appropriate for me|not covered in the|not_covered|do not contain|does not contain|don't contain|no information|enough information|cannot answer|can't answer|cannot give|can't give
cannot provide|can't provide|cannot say|can't say|no answer can be given|no reply is given|leave this question open|not possible for me|do not let me reply|doesn't let me|could be answered
nothing in the indexed|none of the retrieved|goes beyond what i|only the bureau itself|outside what i|outside my|beyond my|my knowledge ends|not permitted to|not allowed to
are silent on|is silent on|say nothing|says nothing|cannot comment|can't comment|cannot advise|can't advise|don't know|do not know|cannot assist|can't assist|could not find|couldn't find|no mention of
संभव नहीं|उत्तर मेरे दस्तावेज़ों में नहीं|दस्तावेज़ों में नहीं|दायरे से बाहर|उत्तर नहीं दिया जा|उत्तर नहीं दे सकता|उत्तर नहीं दे सकती|जानकारी नहीं मिली|जानकारी नहीं है|जानकारी उपलब्ध नहीं|बता नहीं सकता|नहीं बता सकता|उत्तर देना संभव|सहायता नहीं कर सकता|मदद नहीं कर सकता
mein nahin hai|nahin de sakta|nahin bata sakta|jaankari nahin|jankari nahin|sambhav nahin|madad nahin kar|dayre se bahar|jawab nahin
kann ich nicht|nicht beantworten|keine auskunft|keine angaben|nicht möglich|je ne peux pas|ne puis|impossible de répondre|aucune information|pas en mesure
सांगू शकत नाही|माहिती नाही|उत्तर देता येत नाही|বলতে পারছি না|উত্তর দিতে পারছি না|তথ্য নেই|கூற இயலாது|பதிலளிக்க இயலாது|தகவல் இல்லை"""
BESIDES = """kindly rephrase|please rephrase|please write to|write to the|you could check|you may check|please check|try asking|please contact|you may wish to ask|please ask|you could ask|please consult
i looked through|thank you for|hmm|i apologise|i apologize|apologies|sorry|unfortunately|regrettably|i am afraid|i'm afraid|as an assistant|as an ai|please try
क्षमा करें|खेद है|कृपया|धन्यवाद|maaf kijiye|kripya|khed hai|leider|bitte wenden|bitte|désolé|malheureusement|veuillez|माफ करा|দুঃখিত|மன்னிக்கவும்"""
# Of a refusal in the first person: who speaks, what denies, and what isn't done; any of each in turn.
WHO = ("i ", "we ", "i'm ", "i am ", "we're ", "we are ")
DENIES = ("cannot ", "can't ", "can not ", "could not ", "couldn't ", "won't ", "will not ", "unable to ", "not able to ", "not in a position to ", "not going to ", "not allowed to ", "not permitted to ", "refuse to ", "decline to ", "must decline to ", "would rather not ", "prefer not to ", "would prefer not to ", "do not wish to ")
UNDONE = "help assist answer respond reply say tell give provide share comment advise discuss speak address offer disclose comply guess speculate support fulfil".split()
FIRST_PERSON = "\n".join(w + d + u for w in WHO for d in DENIES for u in UNDONE)
_HEAD = re.compile(rf"^\W*(?:{SOURCE_HEADS})\W*:?\W*$", re.I)
_LABEL = re.compile(rf"^[\s*_>#\-•\"'“]*(?:{LABELS})[*_\s]*[:：][*_\s]*|^[\s*_>#\-•]*\*\*(?:{LABELS})\s*:?\*\*[:\s]*|^\W*(?:{LABELS})\W*$", re.I)
_CITES = re.compile(r"\s*(?:\[\d+(?:\s*[,–-]\s*\d+)*\]|【\d+[^】]*】)")
_SOURCE_LINE = re.compile(r"^\W*\[?\d+\]?\W.*(?:https?://|\bp\. ?\d+)|^[\s*>•-]*(?:[^:\n]{0,60}:)?\s*<?https?://\S+\s*$", re.I)
_INVISIBLE = re.compile("[\\s­​-‏⁠-⁯﻿⠀ㅤ]+")
_ASKED = re.compile(r"(?:answer|reply|respond|write|explain|tell me|please)?\W*\b(?:in|auf|en|mein|में)\W+(?P<after>[\w]+)\b|(?P<before>[\w]+)\s+(?:mein|में|भाषा में|மொழியில்|ভাষায়)\s*(?:\w+\s*)?(?:jawab|bata|likh|उत्तर|जवाब|बता|लिख|reply|answer)", re.I)


def automaton(phrases: str) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in re.split(r"[|\n]", phrases):
        found.add_word(p, len(p))
    found.make_automaton()
    return found


class SuffixAutomaton:
    """Of one text: how long a stretch of it ends at each place of another."""

    def __init__(self, text: str):
        self.to: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            new = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.to[p]:
                self.to[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.to[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(self.length[p] + 1, dict(self.to[q]))
                    self.link[copy] = self.link[q]
                    self.link[q] = self.link[new] = copy
                    while p >= 0 and self.to[p].get(c) == q:
                        self.to[p][c] = copy
                        p = self.link[p]
            last = new

    def _state(self, length: int, to: dict[str, int]) -> int:
        self.to.append(to)
        self.link.append(-1)
        self.length.append(length)
        return len(self.to) - 1

    def covered(self, other: str, least: int) -> tuple[int, int]:
        """Characters of ``other`` inside common stretches of at least ``least``, and the longest stretch."""
        at = n = longest = 0
        reach, total = -1, 0
        for i, c in enumerate(other):
            while at and c not in self.to[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.to[at]:
                at, n = self.to[at][c], n + 1
            if n >= least:
                begin = max(reach, i - n)
                total += i - begin
                reach = i
            longest = max(longest, n)
        return total, longest


def body(answer: str) -> str:
    """The answer without its source and link lists."""
    kept, listing = [], False
    for line in answer.split("\n"):
        if _HEAD.match(line):
            listing = True
        elif listing and line.strip() and not _SOURCE_LINE.match(line):
            listing = False
        if not listing and not (_SOURCE_LINE.match(line) and "http" in line):
            kept.append(line)
    return "\n".join(kept)


def unlabelled(text: str) -> str:
    """Without labels at the beginning of lines, quoting marks and citations."""
    lines = []
    for line in _CITES.sub("", text).split("\n"):
        while (m := _LABEL.match(line)) and m.end():
            line = line[m.end() :]
        lines.append(line)
    return "\n".join(lines)


_UNSAID = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def plain(text: str) -> str:
    """Letters, marks and digits in one case."""
    return _UNSAID.sub("", unicodedata.normalize("NFKC", text).casefold())


@lru_cache(1000)
def prompt_automaton(asked: str) -> SuffixAutomaton:
    return SuffixAutomaton(asked)


def may_copy(asked: str, said: str) -> bool:
    """Whether ``said`` holds a block of ``asked``: each stretch of ``STRETCH`` of it holds one of the blocks of half that length."""
    size = (int(np.ceil(STRETCH * len(asked))) + 1) // 2
    return any(asked[k : k + size] in said for k in range(0, len(asked) - size + 1, size))


def stopwords(sentences: list[tuple[str, str]], most: int = STOPWORDS) -> dict[str, str]:
    """Words that stand in many sentences of one language, and in hardly any of the others."""
    of: dict[str, Counter] = defaultdict(Counter)
    size: Counter = Counter(lang for lang, _ in sentences)
    for lang, text in sentences:
        of[lang].update({w for raw in DESIGNATION.sub(" ", text).split() if (w := bare(raw))})
    share = lambda lang, w: of[lang][w] / size[lang]
    out = {}
    for lang, counts in of.items():
        common = sorted((w for w, n in counts.items() if n >= 3), key=lambda w: (-counts[w], w))
        for w in [w for w in common if share(lang, w) >= 5 * max((share(o, w) for o in of if o != lang), default=0)][:most]:
            out[w] = lang
    return out


_BREAK = re.compile(r"(?<!\bRs)(?<!\bNo)(?<!\bS\.O)(?<!\bG\.S\.R)(?<!\bp)[.!?।॥]+(?:\s+|$)|\n+")


class Judge:
    """Judges pairs; holds the automata and the language model."""

    def __init__(self, model, stops: dict[str, str]):
        self.detector = Detector(model)
        self.langs = model.langs
        self.stops = {w: self.langs.index(code) for w, code in stops.items()}
        self.votes_of: dict[str, int] = {}
        self.refusals, self.besides = automaton(f"{REFUSALS}\n{FIRST_PERSON}"), automaton(BESIDES)

    def refuses(self, text: str) -> bool:
        """Some sentence declines and none says anything else."""
        declined = False
        if not any(True for _ in self.refusals.iter(text.lower().replace("’", "'"))):
            return False
        for sentence in _BREAK.split(text):
            s = (sentence or "").strip(" *_>#-•\"'“”").lower().replace("’", "'")
            if not plain(s):
                continue
            if any(True for _ in self.refusals.iter(s)):
                declined = True
            elif not any(end - n + 1 < 25 for end, n in self.besides.iter(s)):
                return False
        return declined

    def languages(self, text: str) -> np.ndarray:
        """Votes for each language; quoted labels have none. Stopwords decide where one language leads, else all words vote."""
        if any(c in text for c in "\"“«'"):
            text = re.sub(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|'[^'\n]{3,80}'(?=\W|$)", " ", text)
        votes = np.zeros(len(self.langs), np.int64)
        for raw in text.split():
            # "IS" is a designation, not the word.
            if (k := self.votes_of.get(raw)) is None:
                k = self.votes_of[raw] = -1 if raw == "IS" else self.stops.get(raw.strip(EDGES).lower(), -1)
                if len(self.votes_of) > KEPT_WORDS:
                    self.votes_of.clear()
            if k >= 0:
                votes[k] += 1
        first, second = np.sort(votes)[::-1][:2] if len(votes) > 1 else (votes.max(initial=0), 0)
        if first - second >= LEAD:
            return VOTE * votes
        scores, words, _ = self.detector.lines([text])
        return scores.sum(axis=0)

    def broken_off(self, text: str) -> bool:
        """An open delimiter, or a last line that doesn't end as a sentence does."""
        lines = [s for line in text.split("\n") if (s := line.strip(" \t\r​﻿"))]
        if not lines:
            return False
        last = lines[-1]
        cited = bool(re.search(r"(?:\[\d+\]\s*)+$", last))
        s = _CITES.sub("", last).rstrip(" \t")
        if s.endswith("**") and s.count("**") % 2 or s.endswith(("(", "[", "{", "„", "“", "«")):
            return True
        stack = []
        for c in _CITES.sub("", text):
            if c in "([{":
                stack.append(c)
            elif c in ")]}" and stack and "([{".index(stack[-1]) == ")]}".index(c):
                stack.pop()
        core = s.rstrip("*_\"'”»)")
        if stack and not core.endswith((".", "!", "?", "।", "॥")):
            return True
        if core.endswith(("…", "...")):
            return True
        if re.search(r"(?:\b(?:Rs|No|Nr|Art|Sec|Cl|vs|e\.g|i\.e|S\.O|G\.S\.R|Dr|Mr))\.$", core) and not cited:
            return plain(core) not in ("no",)
        if core.endswith((".", "!", "?", "।", "॥", "؟", "。")):
            return False
        if cited and core and (core[-1].isalnum() or unicodedata.category(core[-1])[0] == "M" or s.endswith(")")):
            return False
        # A short answer of a figure or a designation is complete without a stop.
        said = unlabelled(text).strip()
        rest = DESIGNATION.sub(" ", said)
        if len(said.split()) <= 6 and not re.search(r"[^\W\d_]{3,}", rest.replace("Part", "").replace("Sec", "")) and s[-1:] not in ",:;-(":
            return False
        if len(said.split()) <= 2 and s[-1:] not in ",:;-(" and plain(said) in ("yes", "no", "हाँ", "नहीं", "ja", "nein", "oui", "non", "haan", "nahin"):
            return False
        return True

    def asked_language(self, question: str) -> str | None:
        for m in _ASKED.finditer(question):
            word = (m["after"] or m["before"] or "").lower()
            if len(word) > 2 and (code := CODE_OF.get(word)):
                return code
        return None

    def defect(self, question: str | None, answer: str | None, must_refuse: bool) -> str | None:
        text = body(answer or "")
        said = unlabelled(text)
        bare = said.strip().strip("*_.-–—…'\"`<>[]() \n").lower()
        letters = plain(said)
        if not _INVISIBLE.sub("", letters) or bare in PLACEHOLDERS or ERROR.match(said.strip()):
            return "empty"
        asked = plain(question or "")
        if asked and len(letters) >= STRETCH * len(asked) and may_copy(asked, letters):
            auto = prompt_automaton(asked)
            total, longest = auto.covered(letters, max(6, min(len(asked) // 4, 20)))
            if total >= COPIED * len(letters) and longest >= STRETCH * len(asked):
                return "copy"
        if self.refuses(said):
            return None if must_refuse else "refusal"
        if self.broken_off(text):
            return "truncated"
        if question:
            votes = self.languages(said)
            got = self.langs[int(votes.argmax())]
            wanted = self.asked_language(question)
            if wanted is None:
                mine = self.languages(question)
                if np.ptp(mine) == 0:
                    return None
                wanted = self.langs[int(mine.argmax())]
            if got != wanted and votes.max() - (votes[self.langs.index(wanted)] if wanted in self.langs else 0) >= MARGIN:
                return "language"
        return None


def defects(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, defect) of each defective pair. ``samples`` are the labelled sentences that the language votes are fitted on."""
    sentences = labelled_sentences(samples)
    model = pairs.sparkSession.sparkContext.broadcast((fitted(sentences), stopwords(sentences)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*model.value)
        for pdf in batches:
            found = [(i, d) for i, q, a, r in pdf[["id", "question", "answer", "must_refuse"]].itertuples(index=False) if (d := judge.defect(q, a, bool(r) and r == r))]
            yield pd.DataFrame(found, columns=["id", "defect"])

    return pairs.select("id", "question", "answer", "must_refuse").mapInPandas(run, "id string, defect string").distinct()
