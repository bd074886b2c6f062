"""Text columns: cleaning, first non-empty, escaping, extractive summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.once import bound

# Unicode white space plus the four ASCII separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
_SENTENCE_MARK = "\u0001"
SENTENCE_WORDS = 25


def clean_text(value: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null becomes ``""``."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), WHITESPACE, " "))


def first_non_empty(*values: Column) -> Column:
    """First value that is not empty after cleaning, else ``""``."""
    cleaned = [F.nullif(clean_text(v), F.lit("")) for v in values]
    return F.coalesce(*cleaned, F.lit(""))


def after_marker(text: Column, marker: str = "Content:") -> Column:
    """Text after the first marker, or the whole text, trimmed."""
    at = F.instr(text, marker)
    rest = F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)
    return F.regexp_replace(rest, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip(text: Column) -> Column:
    """White space of any kind cut at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def html_escape(text: Column) -> Column:
    """The five HTML special characters as entities; ``&`` first."""
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def first_words(text: Column, count: int) -> Column:
    """At most ``count`` leading words of the cleaned text."""
    return F.substring_index(clean_text(text), " ", count)


def best_sentences(text: Column, title: Column, count: int) -> Column:
    """The ``count`` best sentences of the whole cleaned text, in text order.

    A sentence scores two for each distinct title word in it and one for each of its words
    up to `SENTENCE_WORDS`; of equal ones the earlier is taken.
    """
    marked = F.regexp_replace(clean_text(text), r"([.!?]) ", f"$1{_SENTENCE_MARK}")
    sentences = F.split(marked, _SENTENCE_MARK)
    wanted = F.array_distinct(F.split(F.lower(clean_text(title)), " "))

    def scored(words_wanted: Column) -> Column:
        def score(sentence: Column, at: Column) -> Column:
            return bound(
                F.split(F.lower(sentence), " "),
                lambda words: F.struct(
                    (-2 * F.size(F.array_intersect(words_wanted, words)) - F.least(F.size(words), F.lit(SENTENCE_WORDS))).alias("score"),
                    at.alias("at"),
                    sentence.alias("text"),
                ),
            )

        return F.transform(sentences, score)

    best = F.slice(F.sort_array(bound(wanted, scored)), 1, count)
    in_order = F.sort_array(F.transform(best, lambda s: F.struct(s["at"], s["text"])))
    return F.array_join(F.transform(in_order, lambda s: s["text"]), " ")


def match_form(text: Column) -> Column:
    """Lower-cased words separated by single blanks, for whole-phrase matching."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
