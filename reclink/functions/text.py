"""Tokens, phrases, markup and segments as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Alternatives in order: star ratings, dates, prices, letters, punctuation, anything else.
HOTEL_LEXER = r"\d+(?:\.\d+)?\*|\d+/\d+(?:/\d+)?|\$\d+(?:\.\d+)?|[A-Za-z]+|[()\"'\-.,]+|\S+"
TAG = r"</?[A-Za-z][^>]*>"
NOT_TEXT = r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
#: Citation markup: fixed replacements, in this order.
CITATION_RULES = [
    ("</?ref-marker>", " "),
    ("</?authors>", " "),
    ("</?author-(?:first|middle|last)>", " "),
    ("</?reference-hlabeled>", " "),
    ("<(/?)conference>", "<$1booktitle>"),
    ("<(/?)thesis>", "<$1tech>"),
    ("</?(?:sub|sup|tt|i|b)>", " "),
    ("<(/?)number>", "<$1volume>"),
    ("<(/?)address>", "<$1location>"),
    ("</?web>", " "),
    ("</?note>", " "),
    ("<isbn>[^<]*</isbn>", " "),
    ("<crossref>[^<]*</crossref>", " "),
    ("&amp;", " and "),
    (r"^\s+", ""),
]


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of values that are worked out once, however often its inner functions use them."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda x: body(*[x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lex(text: Column, lexer: str = HOTEL_LEXER) -> Column:
    """Tokens of an ordered alternation."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(lexer), F.lit(0))


def strip_markup(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments; runs of white space are one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NOT_TEXT, " "), TAG, " "), r"\s+", " "))


def markup_parts(text: Column, lexer: str = HOTEL_LEXER) -> Column:
    """Tags and tokens in order, for ``tag_of`` and ``is_tag``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{TAG}|{lexer}"), F.lit(0))


def is_tag(part: Column) -> Column:
    return part.rlike(rf"\A(?:{TAG})\z")


def tag_of(part: Column) -> Column:
    """The label that a tag starts: its name in lower case, or O after a closing tag."""
    return F.when(part.startswith("</"), "O").otherwise(F.lower(F.regexp_extract(part, r"<([A-Za-z][A-Za-z0-9\-]*)", 1)))


def normalise_citation(sgml: Column) -> Column:
    """Citation markup with the tags that later steps know."""
    for pattern, by in CITATION_RULES:
        sgml = F.regexp_replace(sgml, pattern, by)
    return F.trim(sgml)


def to_bio(labels: Column) -> Column:
    """B-, I- and O marks of a label for each token."""
    return let(lambda own: F.transform(own, lambda x, i: F.when(x == "O", x).otherwise(F.concat(F.when((i > 0) & (F.get(own, i - 1) == x), "I-").otherwise("B-"), x))), labels)


def bare(bio: Column) -> Column:
    """Label of a BIO mark."""
    return F.when(bio == "O", bio).otherwise(F.substring(bio, 3, 1 << 30))


def from_bio(bio: Column) -> Column:
    """Segments (begin, end, label) of BIO marks; each O is a segment; an I- of another label than before starts one."""
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), bio), F.lit(1), F.size(bio))
    marks = F.zip_with(bio, before, lambda x, p: F.struct(bare(x).alias("l"), ((x == "O") | x.startswith("B-") | p.isNull() | ~bare(p).eqNullSafe(bare(x))).alias("s")))
    starts = F.filter(F.transform(marks, lambda m, i: F.when(m["s"], F.struct(i.alias("i"), m["l"].alias("l")))), lambda m: m.isNotNull())
    ends = F.concat(F.transform(F.slice(starts, 2, 1 << 30), lambda m: m["i"]), F.array(F.size(bio)))
    # without marks there is an end too many
    paired = F.zip_with(starts, ends, lambda m, e: F.when(m.isNotNull(), F.struct(m["i"].alias("begin"), e.alias("end"), m["l"].alias("label"))))
    return F.filter(paired, lambda s: s.isNotNull())


def phrase_string(phrase: Column) -> Column:
    """Words in lower case, runs of what isn't a letter or digit as one space, joined by a space, not trimmed."""
    return F.array_join(F.transform(phrase, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", " ")), " ")


def term_set(phrase: Column) -> Column:
    """Distinct terms: words in lower case with other characters as spaces, trimmed, not empty."""
    return F.array_distinct(F.filter(F.transform(phrase, lambda w: F.trim(F.regexp_replace(F.lower(w), "[^a-z0-9]+", " "))), lambda t: t != ""))


def phrase_slice(phrase: Column, begin: Column, end: Column) -> Column:
    """phrase[begin:end]."""
    return F.slice(phrase, begin + 1, F.greatest(end - begin, F.lit(0)))


def valid_word(word: Column) -> Column:
    """Whether a word has an ASCII letter or digit."""
    return word.rlike("[A-Za-z0-9]")


def citation_lines(words_: Column, labels: Column) -> Column:
    """label, tab, word for each token."""
    return F.zip_with(labels, words_, lambda a, b: F.concat(a, F.lit("\t"), b))
