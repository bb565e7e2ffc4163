"""Tokenising and word functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import PIECE, STOP_WORDS


def tokenize(text: Column, pattern: str = PIECE) -> Column:
    """The text's pieces in order; their concatenation is the text. Null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def question_words(text: Column) -> Column:
    """Words of a question: letters, digits, _ and inner dots; each once, by lower case, in first spelling."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.]+"), F.lit(0)), lambda w: F.rtrim(w, F.lit(".")))
    own = F.filter(raw, lambda w: w != "")
    low = F.transform(own, F.lower)
    return F.filter(own, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def word_present(word: Column, text: Column) -> Column:
    """The word starts in the text where no ASCII letter or digit stands before it; case is ignored."""
    return F.coalesce(F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(word), F.lit("\\E"))), F.lit(False))


def flexible_pattern(phrase: Column) -> Column:
    """A pattern that finds the phrase with any white space between its words, ignoring case."""
    parts = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?iU)"), F.array_join(F.transform(parts, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "\\s+"))


def slug(name: Column, most: int = 40) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", ""), 1, most), F.lit("")), F.lit("doc"))


def normalized_contains(text: Column, phrase: Column) -> Column:
    """Self-reference test: both sides stripped to lower-case letters, digits and spaces."""
    own = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    return F.contains(own(text), own(phrase))


def url_segments(text: Column) -> Column:
    """URLs in the text without the punctuation that ends a sentence."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"]+$", ""))
