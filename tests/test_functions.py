"""Values that follow from the definitions of text, hash, feature and similarity functions."""

import pytest
from corpus import one
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reclink.functions import features as T
from reclink.functions import hashing, similarity
from reclink.functions import text as X


@pytest.mark.parametrize(
    ("key", "phrase", "expected"),
    [
        ("unigram", ["Red", "Lion", "-"], {"red", "lion"}),
        ("bigram", ["Red", "Lion", "-"], {"$begin$#red", "red#lion", "lion#$end$"}),
        ("bigram", [], {"$begin$#$end$"}),
        ("trigram", ["Red", "Lion"], {"$begin2$#$begin$#red", "$begin$#red#lion", "red#lion#$end$", "lion#$end$#$end2$"}),
        ("trigram", [], {"$begin2$#$begin$#$end$", "$begin$#$end$#$end2$"}),
        ("char_bigram", ["4.5*"], {"$begin$#4", "4#5", "5#$end$"}),
        ("char_trigram", ["4.5*"], {"$begin2$#$begin$#4", "$begin$#4#5", "4#5#$end$", "5#$end$#$end2$"}),
        ("none", ["a", "b"], set()),
        ("title", ["The", "Art", "of", "War"], {"$DOUBLE$=art#war"}),
        ("title", ["A"], {"$EMPTY$"}),
        ("title", ["joint", "record", "linkage", "models"], {"$TRIPLE$=joint#record#linkage", "$TRIPLE$=record#linkage#models"}),
        ("author", ["J.", "O'Brien"], {"obrien"}),
    ],
)
def test_hash_keys(spark, key, phrase, expected):
    found = one(spark, hashing.REGISTRY[key](F.col("w")), w=phrase)
    assert set(found) == expected and len(found) == len(expected)


def test_phrases(spark):
    assert one(spark, X.phrase_string(F.col("w")), w=["Ph.D.", '"X"']) == "ph d   x "
    assert set(one(spark, X.term_set(F.col("w")), w=["Ph.D.", '"-"', "X"])) == {"ph d", "x"}
    assert one(spark, X.phrase_slice(F.col("w"), F.lit(1), F.lit(3)), w=["a", "b", "c", "d"]) == ["b", "c"]
    assert [one(spark, X.valid_word(F.lit(x))) for x in ("a", "ü", "", "-1")] == [True, False, False, True]


@pytest.mark.parametrize(
    ("measure", "a", "b", "expected"),
    [("jaccard", "a b", "b c", 1 / 3), ("cosine", "a b", "b c", 1 / 2), ("dice", "a b", "b c", 1 / 2), ("soft_dice", "", "a", 0.0), ("soft_dice", "san diego", "san diego", 1.0), ("soft_cosine", "san diego", "san diego", 1.0), ("soft_dice", "san diego", "san", 2 / 3), ("soft_cosine", "san diego", "san", 0.5**0.5)],
)
def test_similarities(spark, measure, a, b, expected):
    assert one(spark, similarity.REGISTRY[measure](F.col("a"), F.col("b")), a=a.split(), b=b.split()) == pytest.approx(expected)


def test_jaro_winkler_published_examples():
    assert similarity.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("DWAYNE", "DUANE") == pytest.approx(0.84, abs=1e-6)
    assert similarity.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)


@given(st.lists(st.text("abcd", max_size=6), max_size=6), st.lists(st.text("abcd", max_size=6), max_size=6))
def test_soft_common_against_all_pairs(source, target):
    expected = 0.0
    for t in target:
        best = 1.0 if t in source else max((similarity.jaro_winkler(s, t) for s in source), default=0.0)
        expected += best if best >= 0.8 else 0.0
    assert similarity.soft_common(source, target, 0.8) == pytest.approx(expected)


def test_soft_measures_may_exceed_one():
    assert similarity.soft_dice(["aaaaaaaaaa"], ["aaaaaaaaab", "aaaaaaaaac"], 0.9) > 1


@pytest.mark.parametrize(
    ("short", "full", "expected"),
    [("dwntn", "downtown", True), ("d.", "downtown", True), ("d", "downtown", True), ("dt", "downtown", True), ("downtown", "downtown", False), ("Dwntn", "downtown", False), ("dx", "downtown", False)],
)
def test_abbreviation_of_a_word(short, full, expected):
    assert similarity.is_abbreviation(short, full) is expected


@pytest.mark.parametrize(("short", "words", "expected"), [("dm", "del mar", True), ("d.m", "del mar", True), ("d.m.", "del mar", False), ("dx", "del mar", False), ("dm", "del mar north", False)])
def test_abbreviation_of_words(short, words, expected):
    assert similarity.is_initials(short, words.split()) is expected


@pytest.mark.parametrize(("token", "expected"), [("4/25", "$DATE$"), ("$65", "$PRICE$"), ("65", "$DIGITS$"), ("fri", "$DAY$"), ("sept", "$MONTH$"), ("mar", "mar"), ("Fri", "Fri")])
def test_hotel_classes(spark, token, expected):
    assert one(spark, T.simplify_hotel(F.lit(token))) == expected


@pytest.mark.parametrize(
    ("token", "expected"),
    [("1998", "<YEARNOTINPARENS>"), ("(1998)", "<YEARINPARENS>"), ("123-456", "<PAGES>"), ("12--15", "<PAGES>"), ("1,234", "<NUMERIC>"), ("98", "<NUMERIC>"), ("Monday", "<DOFTW>"), ("Mon", "mon"), ("7", "1"), ("J.", "j"), ("--", "--")],
)
def test_citation_classes(spark, token, expected):
    assert one(spark, T.simplify_citation(F.lit(token))) == expected


def test_possible_ends(spark):
    assert one(spark, T.possible_ends(F.col("w")), w=["Smith", ",", "Title"]) == [False, True, True, True]
    assert one(spark, T.possible_ends(F.col("w")), w=[]) == [False]


def test_features(spark):
    assert one(spark, T.hotel_features(F.lit("4.5*"))) == ["WNOPUNC=4 5", "SIMPLIFIED=4.5*", "CONTAINS_STAR_PATTERN"]
    assert "REGEX=INITCAP" in one(spark, T.pattern_features(F.lit("Smith")))
    assert one(spark, T.shape(F.lit("Ab1-cDef"))) == "Aa1-a"
    assert one(spark, T.lexicon_key(F.lit("(Univ.)"))) == "univ"
    assert one(spark, T.lexicon_key(F.lit("abc"))) is None
    assert one(spark, T.conjunctions(F.transform(F.col("w"), lambda w: F.array(w))), w=["a", "b"]) == [["a", "b@1"], ["b", "a@-1"]]


def test_markup(spark):
    sgml = "<authors><author>A</author></authors> &amp; <number>3</number>"
    assert one(spark, X.normalise_citation(F.lit(sgml))) == "<author>A</author>   and  <volume>3</volume>"
    assert one(spark, X.strip_markup(F.lit("<p>a<script>x<b></script> b</p><!-- c -->"))) == "a b"
    assert one(spark, X.lex(F.lit("4.5* 4/25 $6.5 ab, c#"))) == ["4.5*", "4/25", "$6.5", "ab", ",", "c", "#"]


def test_bio_round_trip(spark):
    labels = ["O", "a", "a", "b", "O", "O", "b"]
    assert one(spark, X.to_bio(F.col("w")), w=labels) == ["O", "B-a", "I-a", "B-b", "O", "O", "B-b"]
    found = one(spark, X.from_bio(X.to_bio(F.col("w"))), w=labels)
    assert [(s["begin"], s["end"], s["label"]) for s in found] == [(0, 1, "O"), (1, 3, "a"), (3, 4, "b"), (4, 5, "O"), (5, 6, "O"), (6, 7, "b")]
    assert one(spark, X.from_bio(F.col("w")), w=[]) == []
    stray = one(spark, X.from_bio(F.col("w")), w=["I-a", "I-b", "B-b"])
    assert [(s["begin"], s["end"], s["label"]) for s in stray] == [(0, 1, "a"), (1, 2, "b"), (2, 3, "b")]
