"""Edit distances over words and characters, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(text: Column) -> Column:
    """Words between single spaces; none of an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def as_characters(words: str, place: str) -> str:
    """SQL for the array `words` as a text of one character a word, by the word's place (SQL over w, from 1); no surrogates."""
    return f"array_join(transform({words}, w -> decode(unhex(lpad(hex({place} + if({place} <= 35000, 19968, 30536)), 8, '0')), 'UTF-32')), '')"


def word_edits(ref: str, hyp: str) -> Column:
    """Substitutions, deletions and insertions between the word arrays in columns ref and hyp.

    Each word becomes one character, numbered within the pair, and the native character distance does the rest. Numbers skip the
    surrogates, so a pair can have a million different words.
    """
    place = f"array_position(array_distinct(concat({ref}, {hyp})), w)"
    return F.expr(f"levenshtein({as_characters(ref, place)}, {as_characters(hyp, place)})").cast("long")


def char_edits(ref: Column, hyp: Column) -> Column:
    """Edits between characters, spaces included."""
    return F.levenshtein(ref, hyp).cast("long")
