"""Heuristic language identification from scripts and hint words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions.text import _col, contains_any, squeeze_ends


def script_counts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Hangul, Cyrillic, ASCII and total characters."""
    count = lambda cls: F.regexp_count(text, F.lit(cls))
    return (
        count(r"[\x{AC00}-\x{D7AF}]"),
        count(r"[\x{0400}-\x{04FF}]"),
        count(r"[\x00-\x7F]"),
        F.length(text),
    )


def _hits(text: Column) -> tuple[Column, Column, Column]:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(K.LATIN_WORD), F.lit(0))
    uz = F.size(F.filter(tokens, lambda t: t.isin(list(K.UZ_HINTS))))
    en = F.size(F.filter(tokens, lambda t: t.isin(list(K.EN_HINTS))))
    return F.size(tokens), uz, en


def detect(text: Column | str) -> Column:
    """uz, en, ru or ko."""
    t = squeeze_ends(_col(text))
    hangul, cyrillic, ascii_n, total = script_counts(t)
    n, uz, en = _hits(t)
    ratio = ascii_n / F.greatest(total, F.lit(1))
    return (
        F.when(t == "", "uz")
        .when((hangul > 0) & (hangul >= cyrillic), "ko")
        .when(cyrillic > 0, "ru")
        .when(n == 0, "uz")
        .when(contains_any(t, K.UZ_APOSTROPHE_MARKS) | (uz >= 2), "uz")
        .when((en >= 2) | ((en >= 1) & (ratio > 0.98) & (n >= 4) & (uz == 0)), "en")
        .otherwise("uz")
    )


def strong_english(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    hangul, cyrillic, ascii_n, total = script_counts(t)
    n, _, en = _hits(t)
    return (
        (total > 0) & (hangul == 0) & (cyrillic == 0) & (n >= 3) & (en >= 1)
        & (ascii_n / F.greatest(total, F.lit(1)) > 0.95)
    )


def looks_like(text: Column | str, language: Column) -> Column:
    """Whether a text already is in the wanted language."""
    t = squeeze_ends(_col(text))
    hangul, cyrillic, _, _ = script_counts(t)
    _, uz, en = _hits(t)
    latin = (hangul == 0) & (cyrillic == 0)
    uz_ok = (
        F.when(contains_any(t, K.UZ_APOSTROPHE_MARKS) | (uz >= 2), True)
        .when((en >= 2) & (uz == 0), False)
        .otherwise(uz >= en)
    )
    return (
        F.when(t == "", True)
        .when(language == "ko", hangul > 0)
        .when(language == "ru", cyrillic > 0)
        .when(language == "en", latin & strong_english(t))
        .when(language == "uz", latin & uz_ok)
        .otherwise(False)
    )
