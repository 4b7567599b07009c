"""Text expressions on columns. All stay inside the JVM; patterns are in a dialect that ANSI engines with RE2 read too, where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOPWORDS = (
    "a an and are as at be by can do does for from has have how i if in is it its of on or that the this to was what when where which who why will with "
    "my me we you your our under shall"
).split()

# Official numbers, however they are typed, become one token.
ID_PATTERNS = [
    (r"\bis(?:\s*/\s*(?:iec|iso))?\s*[:\-]?\s*(\d{1,5})", " is{1} {1} "),
    (r"\bs\.?\s*o\.?\s*(?:no\.?\s*)?(\d{1,5})\s*\(\s*e\s*\)", " so{1}e "),
    (r"\bg\.?\s*s\.?\s*r\.?\s*(?:no\.?\s*)?(\d{1,5})\s*\(\s*e\s*\)", " gsr{1}e "),
]
TOKEN = r"[a-z0-9]+|[ऀ-ॿ]+"

# What people write and the word that documents use.
SYNONYMS = [
    (r"\bisi\b", "standard mark"),
    (r"\blicen[cs]e\b", "licence license"),
    (r"\bregistration\b", "registration licence application"),
    (r"\bcomplain(ed|ing|s)?\b", "complaint"),
    (r"\brenew(ed|ing|s)?\b", "renewal"),
    (r"\bapply(ing)?\b|\bapplied\b", "application"),
    (r"\bcancel(l?ed|l?ing|s)?\b", "cancellation"),
    (r"\bsuspend(ed|ing|s)?\b", "suspension"),
    (r"\binspect(ed|ing|s)?\b", "inspection"),
    (r"\bregister(ed|ing|s)?\b", "registration"),
    (r"\bcertif(y|ied|ying)\b", "certification"),
    (r"\btest(ed|ing)?\b", "testing test report"),
    (r"\bfake|counterfeit|misuse\b", "misuse"),
]

# Number words and units.
NUMBER_WORDS = dict(
    one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9", ten="10", fifteen="15", twenty="20", thirty="30", ninety="90"
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    """All patterns replaced in turn."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def normalize_ids(c: Column) -> Column:
    """Lower case, with IS / S.O. / G.S.R. numbers in one spelling."""
    return replaced(F.lower(c), *((p, r.replace("{1}", "$1")) for p, r in ID_PATTERNS))


def tokens(c: Column) -> Column:
    """Search tokens in order, without stop words."""
    found = F.regexp_extract_all(normalize_ids(c), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def expanded(c: Column) -> Column:
    """A query with the documents' words for what it says appended."""
    extra = F.concat_ws(" ", *(F.when(F.lower(c).rlike(p), F.lit(r)) for p, r in SYNONYMS))
    return F.when(extra != "", F.concat(c, F.lit(" "), extra)).otherwise(c)


def embed_text(title: Column, section: Column, text: Column) -> Column:
    """Title and section, where there are any, above the text."""
    head = F.concat_ws(" | ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)


def stem(w: Column) -> Column:
    """Plural to singular, nothing more."""
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when((n > 5) & w.rlike("(xes|ches|shes|sses)$"), F.regexp_replace(w, "es$", ""))
        .when((n > 4) & w.endswith("s") & ~w.rlike("(ss|us|is|as)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def language(c: Column) -> Column:
    """hi if more than 30 % of the letters are Devanagari, else en."""
    hi, en = F.regexp_count(c, F.lit("[ऀ-ॿ]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(hi > 0.3 * F.greatest(hi + en, F.lit(1)), "hi").otherwise("en")


def words_with_vowel_signs(c: Column) -> tuple[Column, Column]:
    """Devanagari words, and those that start with a dependent vowel sign, as texts extracted from legacy fonts do."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w.rlike("[ऀ-ॿ]"))), F.size(F.filter(words, lambda w: w.rlike("^[ा-्]")))


# Lines of a gazette's masthead and furniture.
MASTHEAD = "|".join(
    [
        r"^\s*(the\s+)?gazette\s+of\s+india\s*[:：]?\s*(extraordinary)?\s*$",
        r"^\s*(extraordinary|published by authority|प्राधिकार से प्रकाशित|असाधारण)\s*$",
        r"^\s*(भारत\s+का\s+राजपत्र).*$",
        r"^\s*\[?\s*part\s+[ivx]+\s*[-—–]\s*sec(tion)?\.?\s*\d.*$",
        r"^\s*\[?\s*भाग\s+[ivx]+.*खण्ड.*$",
        r"^\s*(registered\s+no|regd\.?\s*no)\.?.*$",
        r"^\s*(सी\.\s*जी\.|cg-[a-z]{2}-e-\d+|xxxgidexxx|xxxgidhxxx).*$",
        r"^\s*uploaded by dte\.? of printing.*$",
        r"^\s*digitally signed by.*$",
        r"^\s*(date|signature not verified|reason|location)\s*:.*$",
        r"^\s*no\.\s*\d+\]\s*new delhi,.*$",
        r"^\s*सं\.\s*\d+\]\s*नई\s*दिल्ली.*$",
        r"^\s*sec\.\s*\d+\s*(\(\w+\))*\s*\]?\s*$",
        r"^\s*\d+\s*$",
        r"^\s*page\s+\d+\s+(of\s+\d+)?\s*$",
    ]
)


def clean_page(c: Column) -> Column:
    """A page without soft hyphens, ligatures, bidi marks, hyphenated line breaks, masthead lines and runs of blanks."""
    t = replaced(c, ("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("[​﻿]+", " "), ("[‪-‮⁦-⁩]", ""), (r"([\p{L}\p{N}_])-\n\s*([\p{L}\p{N}_])", "$1$2"))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(s, r"\s+$", "")), lambda s: ~F.lower(s).rlike(MASTHEAD))
    return F.regexp_replace(replaced(F.array_join(lines, "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")


def redacted(c: Column) -> Column:
    """E-mail addresses, 12-digit ids and mobile numbers masked."""
    return replaced(c, (r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]"), (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[id number]"), (r"(^|\D)(?:\+?91[\s-]?)?[6-9]\d{9}(\D|$)", "$1[phone]$2"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sentences(c: Column) -> Column:
    """Sentences, not split behind abbreviations. The abbreviations' stops are masked, so that no look-behind is needed."""
    masked = F.regexp_replace(c, r"\b([Rr]s|No|S\.O|e\.g|i\.e|viz|Sr)\.", "$1\x02")
    marked = F.regexp_replace(masked, r"([.!?।])\s+([A-Z0-9\"'(*ऀ-ॿ])", "$1\x01$2")
    return F.transform(F.split(marked, "\x01"), lambda s: F.replace(s, F.lit("\x02"), F.lit(".")))


def uncited(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\[\d+\]", " ")


def numbers(c: Column) -> Column:
    """The numbers a text states, as digits; number words count, citation marks don't."""
    t = uncited(c)
    digits = F.transform(F.regexp_extract_all(t, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    words = F.filter(F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(list(NUMBER_WORDS)))
    mapped = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    return F.array_distinct(F.concat(digits, F.transform(words, lambda w: mapped[w])))


UNITS = r"(days?|months?|years?|weeks?|working days?|lakh|crore|%|per cent)"


def quantities(c: Column) -> Column:
    """Numbers with their units: '3 months' is '3 month'."""
    t = reduce(lambda x, p: F.regexp_replace(x, rf"\b{p[0]}\b", p[1]), NUMBER_WORDS.items(), uncited(c))
    found = F.regexp_extract_all(t, F.lit(rf"(\d[\d,]*\s*(?:\(\s*\d+\s*\)\s*)?{UNITS})"), F.lit(1))
    number = lambda s: F.replace(F.regexp_extract(s, r"^(\d[\d,]*)", 1), F.lit(","), F.lit(""))
    unit = lambda s: F.replace(F.regexp_replace(F.regexp_extract(s, UNITS + "$", 1), "s+$", ""), F.lit("working day"), F.lit("day"))
    return F.array_distinct(F.transform(found, lambda s: F.concat(number(s), F.lit(" "), unit(s))))


def cleaned_output(c: Column) -> Column:
    """A model's text without thinking blocks, foreign citation marks and its own source list."""
    t = replaced(c, (r"(?s)<think>.*?</think>", ""), (r"【(\d+)[^】]*】", "[$1]"), (r"\[\^(\d+)\]", "[$1]"), (r"\[[Ee]xcerpt (\d+)\]", "[$1]"))
    return F.trim(t)


def without_sources(c: Column) -> Column:
    """The text before the list of sources."""
    marked = F.regexp_replace(c, r"\n\s*(?:\*\*)?(?:Sources|स्रोत)(?:\*\*)?\s*:?\s*(?:\*\*)?\s*\n", "\x01")
    return F.regexp_replace(F.split(marked, "\x01")[0], r"^\s+|\s+$", "")


def name_words(c: Column) -> Column:
    """Words of a name for overlap: more than two characters, no stop words, without a final s."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2)), lambda w: F.regexp_replace(w, "s+$", "")))


# Number words in key facts.
FACT_WORDS = {"ninety": "90", "thirty": "30", "twenty one": "21", "five thousand": "5000", "two": "2", "five": "5", "ten": "10"}


def fact_form(c: Column) -> Column:
    """A text in the form in which key facts are looked for."""
    t = reduce(lambda x, p: F.regexp_replace(x, rf"\b{p[0]}\b", p[1]), FACT_WORDS.items(), F.lower(c))
    return replaced(t, (r"[\s,.\-]", ""), ("₹", "rs"))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def snippet(c: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def letters_key(c: Column, n: int = 220) -> Column:
    """What near-duplicate passages share: their first Latin letters."""
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z]", ""), 1, n)


DATE_PATTERNS = [
    r"(\d{1,2})(?:st|nd|rd|th)?\s*(?:day of\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s*,?\s*(\d{4})",
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})",
    r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b",
]


def first_date(c: Column, reach: int = 6000) -> Column:
    """The earliest plausible date of the first ``reach`` characters, of the first match of each of three patterns; null if none."""
    t = F.lower(F.substring(c, 1, reach))
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3))
    found = []
    for k, p in enumerate(DATE_PATTERNS):
        g = [F.regexp_extract(t, p, i) for i in range(4)]
        d, m, y = ((g[1], month(g[2]), g[3]), (g[2], month(g[1]), g[3]), (g[1], g[2], g[3]))[k]
        d, m, y = (F.try_to_number(x, F.lit("9999")).cast("int") if k == 2 or x is not m else x.cast("int") for x in (d, m, y))
        ok = (g[0] != "") & y.between(1950, 2030) & m.between(1, 12) & d.between(1, 31)
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        found.append(F.when(ok, F.struct(F.instr(t, g[0]).alias("at"), text.alias("date"))))
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["date"]
