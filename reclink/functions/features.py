"""Token features as column expressions; rules are data, so that one list serves every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions.text import let

# Classes and pattern features of whole tokens, as the feature definitions give them.
DATE, PRICE, STAR = r"\d+/\d+(?:/\d+)?", r"\$\d+(?:\.\d+)?", r"\d+(?:\.\d+)?\*"
#: Hotel classes; the first that matches counts.
HOTEL_CLASSES = [
    ("$DATE$", DATE),
    ("$PRICE$", PRICE),
    ("$DIGITS$", r"\d+"),
    ("$DAY$", r"(?:mon|tues?|wed(?:nes)?|thurs?|fri|satu?r?|sun)(?:day)?"),
    ("$MONTH$", r"january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|apr|jun|jul|aug|sep|sept|oct|nov|dec"),
]
HOTEL_FLAGS = [
    ("CONTAINS_STAR_PATTERN", STAR),
    ("CONTAINS_PLUS", r"(?s).*\+.*"),
    ("CONTAINS_SLASH", "(?s).*/.*"),
    ("CONTAINS_COMMA", "(?s).*,.*"),
    ("CONTAINS_DASH", "(?s).*-.*"),
    ("CONTAINS_PUNC", r"[,.;:?!()\"\-'`]"),
]
#: Citation classes; the first that matches counts.
CITATION_CLASSES = [
    ("<YEARNOTINPARENS>", r"(?:19|20|['`])\d\d[a-z]?"),
    ("<YEARINPARENS>", r"\(\s*(?:19|20)\d\d[a-z]?\s*\)"),
    ("<PAGES>", r"\d{3,}\s*[\-{#]+\s*\d{3,}|\d+\s*[\-{#]{2,}\d+"),
    ("<VOLUME_NUMBER>", r"\d\d?\s*\(\d?\)"),
    ("<VOLUME>", r"\(\s*\d\d?\s*\)"),
    ("<NUMERIC>", r"\d[\d,]+\.?\d*"),
    ("<DOFTW>", r"(?:Mon|Tues?|Wed(?:nes)?|Thurs?|Fri|Satu?r?|Sun)day"),
    ("<MONTH>", r"January|February|March|April|May|June|July|August|September|October|November|December|Mar|Jan|Feb|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"),
    ("<CARDINAL-DIRECTION>", r"(?i)(?:north|south|east|west)\s*(?:east|west)?"),
]
#: Citation pattern features.
CITATION_PATTERNS = [
    ("CONTAINSDOTS", r"[^.]*\..*"),
    ("CONTAINSCOMMA", r".*,.*"),
    ("CONTAINSDASH", r"[A-Za-z0-9]+-[A-Za-z0-9]*"),
    ("ACRO", r"[A-Z][A-Z.]*\.[A-Z.]*"),
    ("URL1", r"www\..*|https?://.*|ftp\..*|.*\.edu/?.*"),
    ("PossiblePage", r"\d+\s*[\-{#]+\s*\d+"),
    ("PossibleVol", r"\d\d?\s*\(\d+\)"),
    ("5+digit", r"\d{5,}"),
    ("HasDigit", r".*\d.*"),
    ("AllDigits", r"\d+"),
    ("ORDINAL1", r"(?i)\d+(?:st|nd|rd|th)"),
    (
        "ORDINAL2",
        r"(?i)(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|thirtieth|fou?rtieth|fiftieth|sixtieth|seventieth|eightieth|nine?tieth|hundredth)",
    ),
    ("Punc", r"[,.;:?!()\"'`]"),
    ("LeadQuote", "[\"'`]"),
    ("EndQuote", "[\"'`][^s]?"),
    ("MultiHyphen", r"\S*-\S*-\S*"),
    ("ContainsPunc", r"[\-,:;]"),
    ("StopPunc", r"[!?.\"']"),
    ("LONELYINITIAL", r"[A-Z]\."),
    ("CAPLETTER", r"[A-Z]"),
    ("ALLCAPS", r"[A-Z]+"),
    ("INITCAP", r"[A-Z].*"),
    ("HASEDITOR", r"ed\.|editor|editors|eds\."),
    ("HASINSTITUTE", r"University|Universite|Universiteit|Univ\.?|Dept\.?|Institute|Corporation|Department|Laboratory|Laboratories|Labs"),
]
#: Words around which a segment may end; and the text features of neighbours at these offsets.
BORDER_WORDS = r"and|et.?|vol.?|no.?|pp.?|pages"
OFFSETS = (1, -1, 2, -2)
OOV = "$OOV$"


def full_match(token: Column, pattern: str) -> Column:
    """Whether the whole token matches."""
    return token.rlike(rf"\A(?:{pattern})\z")


def _first_class(token: Column, classes: list[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    for name, pattern in reversed(classes):
        out = F.when(full_match(token, pattern), name).otherwise(out)
    return out


def simplify_hotel(token: Column) -> Column:
    return _first_class(token, HOTEL_CLASSES, token)


def simplify_citation(token: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(token), r"\s+", " "), r"\d", "1"), r"[^a-z0-9\s()\[\]]+", "")
    return _first_class(token, CITATION_CLASSES, F.when(plain == "", token).otherwise(plain))


def hotel_features(token: Column) -> Column:
    """Feature strings of a hotel token; capitals count as punctuation in WNOPUNC."""
    plain = F.trim(F.regexp_replace(token, "[^a-z0-9]+", " "))
    return F.array_compact(F.array(F.concat(F.lit("WNOPUNC="), plain), F.concat(F.lit("SIMPLIFIED="), simplify_hotel(token)), *[F.when(full_match(token, p), n) for n, p in HOTEL_FLAGS]))


def shape(token: Column, most: int = 5) -> Column:
    """Classes of the first ``most`` characters: capitals A, other letters a, digits 1, others as they are."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "1"), 1, most)


def pattern_features(token: Column) -> Column:
    return F.array_compact(F.array(*[F.when(full_match(token, p), F.lit(f"REGEX={n}")) for n, p in CITATION_PATTERNS]))


def pattern_present(token: Column, name: str, pattern: str) -> Column:
    """REGEX_PRESENT_name=true or false."""
    return F.concat(F.lit(f"REGEX_PRESENT_{name}="), full_match(token, pattern).cast("string"))


def token_text(token: Column, name: str, fn=lambda c: c) -> Column:
    return F.concat(F.lit(name), fn(token))


def lexicon_key(token: Column, lower: bool = True) -> Column:
    """The form in which a token is looked up: without outer punctuation, null if it has 3 characters or fewer."""
    plain = F.regexp_replace(F.lower(token) if lower else token, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    return F.when(F.length(plain) > 3, plain)


def lexicon_features(tokens: DataFrame, lexicon: DataFrame, name: str, lower: bool = True) -> DataFrame:
    """``tokens`` (with column token) and ``in_lexicon``: LEXICON=name or null.  The lexicon (entry) is distinct and joined by key."""
    entries = lexicon.select((F.lower("entry") if lower else F.col("entry")).alias("lexicon_key")).distinct().withColumn("in_lexicon", F.lit(f"LEXICON={name}"))
    return tokens.withColumn("lexicon_key", lexicon_key(F.col("token"), lower)).join(entries, "lexicon_key", "left").drop("lexicon_key")


def conjunctions(features: Column, offsets: tuple[int, ...] = OFFSETS) -> Column:
    """Features of each token and, marked by the offset, of its neighbours (arrays of arrays)."""
    def joined(all_: Column) -> Column:
        def near(i: Column, k: int) -> Column:
            own = F.when(i + k >= 0, F.get(all_, i + k))
            return F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda f: F.concat(f, F.lit(f"@{k}")))

        return F.transform(all_, lambda own, i: F.concat(own, *[near(i, k) for k in offsets]))

    return let(joined, features)


def possible_ends(words: Column) -> Column:
    """For each j from 0 to the number of words: may a segment end before word j?"""
    def ends(w: Column) -> Column:
        def at(j: Column) -> Column:
            before, after = F.get(w, j - 1), F.get(w, j)
            border = before.rlike(r"[^A-Za-z0-9\-]\z") | after.rlike(r"\A[^A-Za-z0-9\-]") | full_match(F.lower(before), BORDER_WORDS) | full_match(F.lower(after), BORDER_WORDS)
            switch = (before.rlike(r"[A-Za-z]\z") & after.rlike(r"\A[0-9]")) | (before.rlike(r"[0-9]\z") & after.rlike(r"\A[A-Za-z]"))
            return F.when(j == 0, F.lit(False)).when(j == F.size(w), F.lit(True)).otherwise(border | switch)

        return F.transform(F.sequence(F.lit(0), F.size(w)), at)

    return let(ends, words)
