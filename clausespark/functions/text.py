"""Text functions as Column builders: cleaning, tokens, stems, terms and scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark import constants as K

def _empty() -> Column:
    return F.array().cast("array<string>")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------ mojibake
# The code page comes from the interpreter's codec; byte values map to Latin-1 characters.
_CP1251 = {bytes([b]).decode("cp1251", "ignore"): chr(b) for b in range(128, 256)}
_CP1251.pop("", None)
_CP_CHARS = "".join(_CP1251)
_CP_BYTES = "".join(_CP1251.values())


def _java_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def mojibake_markers(value: Column | str) -> Column:
    """How many fragments look like UTF-8 that was read as windows-1251."""
    c = _col(value)
    return F.regexp_count(c, F.lit(K.CLASSIC_MOJIBAKE)) + F.regexp_count(c, F.lit(K.APOSTROPHE_MOJIBAKE))


def _reencode_cp1251(c: Column) -> Column:
    """Encode to windows-1251 and decode as UTF-8, dropping what does not fit either."""
    kept = F.regexp_replace(c, f"[^\\x00-\\x7F{_java_class(_CP_CHARS)}]", "")
    raw = F.encode(F.translate(kept, _CP_CHARS, _CP_BYTES), "ISO-8859-1")
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def repair_mojibake(value: Column | str) -> Column:
    """Repair text decoded with the wrong code page; rows without markers pass through untouched."""
    def repair(c: Column) -> Column:
        # plain substrings are looked for first, as most texts hold none
        marked = contains_any(c, K.MOJIBAKE_LEADS) & c.rlike(f"{K.CLASSIC_MOJIBAKE}|{K.APOSTROPHE_MOJIBAKE}")
        return F.when(marked, let(F.struct(c.alias("old"), _reencode_cp1251(c).alias("new")), choose)).otherwise(c)

    def choose(pair: Column) -> Column:
        old, new = pair["old"], pair["new"]
        better = (
            (new != "")
            & (mojibake_markers(new) <= mojibake_markers(old))
            & (F.length(new) >= F.floor(F.length(old) * 0.75))
        )
        return F.when(better, new).otherwise(old)

    return let(F.replace(F.coalesce(_col(value), F.lit("")), F.lit("﻿"), F.lit("")), repair)


def to_mojibake(value: Column | str) -> Column:
    """The damaged spelling of a term, used to match text that was stored damaged."""
    c = F.trim(F.coalesce(_col(value), F.lit("")))
    latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    undefined = "".join(chr(b) for b in range(128, 256) if chr(b) not in _CP_BYTES)
    return F.translate(F.translate(latin, undefined, ""), _CP_BYTES, _CP_CHARS)


# ------------------------------------------------------------- normalisation
@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(value: Column | str) -> Column:
    """Compatibility normalisation; only rows with non-ASCII characters travel to Python."""
    c = _col(value)
    return F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


#: Whitespace that is not one plain space already; the lookahead passes over printable ASCII.
_WS_RUN = f"(?=[^!-~])(?:{K.WS[:-1]}{{2,}}|{K.WS[:-2]}&&[^ ]])"


def squeeze(value: Column | str) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), _WS_RUN, " "))


def clean_text(value: Column | str) -> Column:
    return squeeze(repair_mojibake(value))


def fold_apostrophes(value: Column | str) -> Column:
    return F.translate(_col(value), K.APOSTROPHES, "'" * len(K.APOSTROPHES))


def lexical_fold(value: Column | str) -> Column:
    """Lower case with one apostrophe form; whitespace is kept."""
    return fold_apostrophes(F.lower(F.coalesce(_col(value), F.lit(""))))


def normalize_text(value: Column | str, compat: bool = False) -> Column:
    """Comparison form of questions and haystacks; ``compat`` adds NFKC for non-ASCII rows."""
    c = repair_mojibake(value)
    if compat:
        c = nfkc(c)
    return squeeze(lexical_fold(c))


def simple_norm(value: Column | str) -> Column:
    """Lower, two apostrophe forms folded, whitespace collapsed (numeric parsing)."""
    return squeeze(F.translate(F.lower(F.coalesce(_col(value), F.lit(""))), "’`", "''"))


def lower_squeeze(value: Column | str) -> Column:
    return squeeze(F.lower(F.coalesce(_col(value), F.lit(""))))


# --------------------------------------------------------------- token lists
# The leading lookahead rejects most positions before the wider lookbehind is tried.
_STEM_FIRST = "".join(sorted({s[0] for s in K.SUFFIXES}))
_STEM_STEP = (
    f"(?=[{_STEM_FIRST}])(?<={K.TOKEN_CHARS}{{4}})(?:{'|'.join(K.SUFFIXES)})(?!{K.TOKEN_CHARS})"
)
_STEM_PASSES = 6


def extract_tokens(value: Column | str) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(K.TOKEN), F.lit(0))


def stem_text(value: Column | str) -> Column:
    """Strip inflection suffixes from every token of a folded text.

    One pass removes one suffix per token, always the longest that leaves four characters; a text without a
    removable suffix is done. Rows that still hold a removable suffix after the unrolled passes go on until none is left.
    """
    def passes(x: Column, n: int, then) -> Column:
        for _ in range(n):
            x = F.regexp_replace(x, _STEM_STEP, "")
        return let(x, lambda y: F.when(y.rlike(_STEM_STEP), then(y)).otherwise(y))

    def finish(x: Column) -> Column:
        longest = F.array_max(F.transform(extract_tokens(x), F.length))
        return F.aggregate(F.sequence(F.lit(1), longest), x, lambda acc, _: F.regexp_replace(acc, _STEM_STEP, ""))

    # most texts are done after few passes, and many need none
    return passes(_col(value), 0, lambda x: passes(x, 2, lambda y: passes(y, _STEM_PASSES - 2, finish)))


def stem_tokens(folded: Column | str) -> Column:
    """Stems of the tokens longer than two characters, in text order, duplicates kept."""
    return F.filter(extract_tokens(stem_text(folded)), lambda t: F.length(t) > 2)


def tokenize(value: Column | str) -> Column:
    return stem_tokens(lexical_fold(value))


def ci_distinct(values: Column | str) -> Column:
    """Trimmed, non-empty values; the first spelling per lower-case key, in order."""
    arr = F.filter(F.transform(F.coalesce(_col(values), _empty()), lambda v: F.trim(v)), lambda v: v != "")

    def first_spellings(pair: Column) -> Column:
        return F.filter(
            pair["v"], lambda v, i: F.array_position(pair["k"], F.get(pair["k"], i)) == (i + 1).cast("bigint")
        )

    return let(arr, lambda a: let(F.struct(a.alias("v"), F.transform(a, F.lower).alias("k")), first_spellings))


def longest_first(values: Column) -> Column:
    """Stable order by falling length."""
    keyed = F.transform(values, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def _not_in(words: Sequence[str]):
    return lambda t: ~t.isin(list(words))


def query_terms(normalized: Column | str, limit: int = 8) -> Column:
    """Stemmed search terms without stopwords, first eight distinct."""
    stems = stem_tokens(normalized)
    return F.slice(F.array_distinct(F.filter(stems, _not_in(K.QUERY_STOPWORDS))), 1, limit)


def route_terms(normalized: Column | str) -> Column:
    return F.slice(F.array_distinct(stem_tokens(normalized)), 1, 8)


def plain_terms(simple: Column | str) -> Column:
    """Unstemmed distinct tokens longer than two characters, first twelve."""
    return F.slice(F.array_distinct(F.filter(extract_tokens(simple), lambda t: F.length(t) > 2)), 1, 12)


def unique_terms(value: Column | str) -> Column:
    return F.slice(F.array_distinct(tokenize(value)), 1, 10)


def priority_terms(value: Column | str) -> Column:
    def choose(terms: Column) -> Column:
        good = F.filter(terms, lambda t: (F.length(t) >= 4) & ~t.isin(list(K.PRIORITY_STOPWORDS)))
        longer = F.filter(terms, lambda t: F.length(t) >= 5)
        return F.slice(longest_first(F.when(F.size(good) > 0, good).otherwise(longer)), 1, 4)

    return let(F.array_distinct(tokenize(value)), choose)


def specific_terms(terms: Column) -> Column:
    """Distinctive terms of a ``query_terms`` list."""
    def choose(ts: Column) -> Column:
        good = F.filter(ts, lambda t: (F.length(t) >= 4) & ~t.isin(list(K.ANCHOR_STOPWORDS)))
        second = F.filter(ts, lambda t: (F.length(t) >= 4) & ~t.isin(list(K.SPECIFICITY_STOPWORDS)))
        return F.when(F.size(good) > 0, F.slice(longest_first(good), 1, 4)).otherwise(F.slice(second, 1, 2))

    return let(terms, choose)


def anchor_terms(specific: Column) -> Column:
    """One or two anchors of a ``specific_terms`` list."""
    def choose(ranked: Column) -> Column:
        strong = F.filter(ranked, lambda t: F.length(t) >= 8)
        return F.slice(F.when(F.size(strong) > 0, strong).otherwise(ranked), 1, 2)

    return let(longest_first(specific), choose)


def fingerprint(value: Column | str) -> Column:
    """Sorted distinct stems."""
    return F.array_sort(F.array_distinct(tokenize(value)))


# -------------------------------------------------------------------- scores
def occurrences(haystack: Column, term: Column) -> Column:
    """Non-overlapping substring count."""
    return ((F.length(haystack) - F.length(F.replace(haystack, term, F.lit("")))) / F.length(term)).cast("int")


def term_coverage(terms: Column, haystack: Column) -> Column:
    return let(haystack, lambda h: F.size(F.filter(terms, lambda t: F.contains(h, t))))


def term_frequency(terms: Column, haystack: Column) -> Column:
    return let(haystack, lambda h: F.aggregate(terms, F.lit(0), lambda acc, t: acc + occurrences(h, t)))


def keyword_score(terms: Column, haystack: Column) -> Column:
    """Share of terms contained in an already normalised haystack."""
    n = F.size(terms)
    return F.when((n > 0) & (haystack != ""), term_coverage(terms, haystack) / n).otherwise(F.lit(0.0))


def contains_any(haystack: Column, words: Sequence[str]) -> Column:
    out = F.contains(haystack, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(haystack, F.lit(word))
    return out


# ------------------------------------------------------------- small helpers
def preview(value: Column | str, limit: int) -> Column:
    """Squeezed text, cut with an ellipsis where it is longer than ``limit``."""
    c = squeeze(value)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def strip_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def first_sentence(value: Column) -> Column:
    return F.trim(F.split(value, K.SENTENCE_END, 2)[0])


def short_answer(value: Column | str) -> Column:
    """Text after the summary label, else the first sentence; at most 400 characters."""
    text = squeeze_ends(value)
    pattern = f"(?is)^.*?{K.SHORT_ANSWER_LABEL}(.*)$"
    labelled = squeeze_ends(F.regexp_extract(text, pattern, 1))
    sentence = first_sentence(text)
    return F.left(
        F.when(labelled != "", labelled).when(sentence != "", sentence).otherwise(text), F.lit(400)
    )


def squeeze_ends(value: Column | str) -> Column:
    """Trim any whitespace at both ends."""
    return F.regexp_replace(F.coalesce(_col(value), F.lit("")), f"^{K.WS}|{K.WS}$", "")


def looks_like_no_answer(value: Column | str) -> Column:
    return contains_any(normalize_text(value), K.NO_ANSWER_MARKERS)


def image_url(value: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(_col(value), F.lit("")), f"(?i){K.IMAGE_URL}", 1)
    return F.nullif(F.rtrim(found, F.lit(").,;")), F.lit(""))


def sentences(value: Column | str) -> Column:
    return F.split(_col(value), r"(?<=[.!?])\s+")


def relevant_sentence(snippet: Column | str, evidence: Column | str) -> Column:
    """First sentence that holds the evidence, else the first sentence."""
    parts = sentences(squeeze_ends(repair_mojibake(snippet)))
    target = F.lower(F.trim(F.coalesce(_col(evidence), F.lit(""))))

    def choose(b: Column) -> Column:
        hits = F.filter(b["parts"], lambda s: F.contains(F.lower(s), b["target"]))
        first = F.get(b["parts"], F.lit(0))
        return squeeze_ends(F.when(b["target"] != "", F.coalesce(F.get(hits, F.lit(0)), first)).otherwise(first))

    return let(F.struct(parts.alias("parts"), target.alias("target")), choose)


def direct_answer(snippet: Column, evidence: Column, code: Column, clause_number: Column) -> Column:
    """Two labelled parts built from the relevant sentence and its source."""
    ev = F.coalesce(evidence, F.lit(""))
    sentence = relevant_sentence(snippet, ev)
    raw = F.left(squeeze_ends(snippet), F.lit(220))
    detail = F.when(sentence != "", sentence).when(raw != "", raw).otherwise("Kontekstda normativ band topildi.")
    detail = F.when(detail.endswith("."), detail).otherwise(F.concat(detail, F.lit(".")))
    doc = F.trim(F.coalesce(code, F.lit("")))
    doc = F.when(doc == "", "SHNQ").otherwise(doc)
    num = F.trim(F.coalesce(clause_number, F.lit("")))
    label = F.when(num != "", F.concat(doc, F.lit(", "), num, F.lit("-band"))).otherwise(doc)
    short = F.when(ev != "", F.concat(ev, F.lit(" ("), label, F.lit(")."))).otherwise(
        F.concat(label, F.lit(" bo'yicha norma topildi."))
    )
    return F.concat(F.lit("Batafsil: "), detail, F.lit("\nQisqa qilib aytganda: "), short)


def cleanup_answer(value: Column | str) -> Column:
    """Remove numbered scaffolding and force the two labelled parts with a short second part."""
    empty = "Kontekstda aniq javob topilmadi."
    c = squeeze_ends(value)
    blank = c == ""
    c = F.regexp_replace(c, r"(?i)\(\s*1\s*\)\s*[^.\n:]*[:.]?\s*.*?(?:\n|$)", "")
    c = F.regexp_replace(c, r"(?i)\(\s*2\s*\)\s*[^.\n:]*[:.]?\s*.*?(?:\n|$)", "")
    c = F.regexp_replace(c, r"(?i)\(\s*3\s*\)\s*[^.\n:]*[:.]?\s*", "Batafsil: ")
    c = F.regexp_replace(c, r"(?i)\(\s*4\s*\)\s*[^.\n:]*[:.]?\s*", "\nQisqa qilib aytganda: ")
    c = F.regexp_replace(c, r"(?i)details?\s*:", "Batafsil:")
    c = F.regexp_replace(c, r"(?i)in\s*short\s*:", "Qisqa qilib aytganda:")
    c = F.regexp_replace(c, r"(?im)^\s*manba\s*:\s*.*$", "")
    c = squeeze_ends(F.regexp_replace(c, r"\n{3,}", "\n\n"))

    def label_detail(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("Batafsil:")), x).otherwise(F.concat(F.lit("Batafsil: "), x))

    def label_short(x: Column) -> Column:
        body = squeeze_ends(F.replace(x, F.lit("Batafsil:"), F.lit("")))
        short = squeeze_ends(F.split(body, K.SENTENCE_END, 2)[0])
        short = F.when(short == "", empty).otherwise(short)
        return F.when(F.contains(x, F.lit("Qisqa qilib aytganda:")), x).otherwise(
            F.concat(x, F.lit("\nQisqa qilib aytganda: "), short, F.lit("."))
        )

    def cap(tail: Column) -> Column:
        words = F.split(squeeze(tail), " ")
        capped = F.concat(strip_chars(F.array_join(F.slice(words, 1, 12), " "), " ,;:-"), F.lit("."))
        return F.when(F.size(words) > 14, capped).otherwise(tail)

    def assemble(x: Column) -> Column:
        cut = F.locate("Qisqa qilib aytganda:", x)
        detail = squeeze_ends(F.replace(F.substring(x, F.lit(1), cut - 1), F.lit("Batafsil:"), F.lit("")))
        tail = squeeze_ends(F.substring(x, cut + len("Qisqa qilib aytganda:"), F.length(x)))
        tail = squeeze_ends(F.regexp_extract(tail, r"^[^\n\r]*", 0))
        return F.concat(F.lit("Batafsil: "), detail, F.lit("\nQisqa qilib aytganda: "), let(tail, cap))

    done = let(let(let(c, label_detail), label_short), assemble)
    return F.when(blank, empty).otherwise(done)


def html_to_text(markdown: Column | str, html: Column | str) -> Column:
    """Markdown where present, else the HTML with its tags blanked."""
    md = squeeze_ends(markdown)
    stripped = squeeze(F.regexp_replace(F.coalesce(_col(html), F.lit("")), "<[^>]+>", " "))
    return F.when(md != "", md).otherwise(stripped)


def clause_quality(cleaned: Column) -> Column:
    """Usefulness of a cleaned clause text as source of questions."""
    low = F.lower(cleaned)
    terms = sum((F.contains(low, F.lit(t)).cast("int") for t in K.QUALITY_TERMS), F.lit(0))
    score = (
        F.least(F.lit(3), F.regexp_count(cleaned, F.lit(r"\d"))) * 0.12
        + terms * 0.08
        + F.least(F.length(cleaned), F.lit(900)) / 900 * 0.25
    )
    return F.when(cleaned == "", 0.0).otherwise(score)


def table_quality(haystack: Column) -> Column:
    low = F.lower(haystack)
    terms = sum((F.contains(low, F.lit(t)).cast("int") for t in K.QUALITY_TERMS), F.lit(0))
    score = F.least(F.lit(6), F.regexp_count(haystack, F.lit(r"\d"))) * 0.06 + terms * 0.08 + 0.3
    return F.when(haystack == "", 0.0).otherwise(score)


def clause_number(value: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(value), K.LEADING_NUMBER, 1), F.lit(""))


def canonical_clause_number(value: Column | str) -> Column:
    """First dotted number with leading zeros removed from each part; empty when there is none."""
    raw = F.replace(F.coalesce(_col(value), F.lit("")), F.lit(","), F.lit("."))
    found = F.regexp_extract(raw, r"\d+(?:\.\d+){0,3}", 0)
    return F.regexp_replace(found, r"(^|\.)0+(?=\d)", "$1")


def json_salvage(value: Column | str) -> Column:
    """Valid JSON text of a model reply: as is, or between the outermost brackets; else null."""
    c = squeeze_ends(value)
    c = F.when(
        c.startswith("```"), F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    ).otherwise(c)
    inner = F.regexp_extract(c, r"(?s)[{\[].*[}\]]", 0)
    valid = lambda x: F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull()
    return F.when(valid(c), c).when(valid(inner), inner)


def choice_parse(raw: Column | str, candidates: Column) -> Column:
    """The allowed code named by a recorded choice: its JSON ``code``, else the first found in the text."""
    compact = squeeze_ends(F.btrim(squeeze_ends(raw), F.lit("`")))
    compact = F.when(compact.startswith("json"), squeeze_ends(F.substr(compact, F.lit(5)))).otherwise(compact)
    key = lambda x: F.lower(F.regexp_replace(x, K.WS, ""))
    allowed = F.filter(F.coalesce(candidates, _empty()), lambda x: x != "")
    named = key(F.try_variant_get(F.try_parse_json(compact), "$.code", "string"))
    by_json = F.filter(allowed, lambda x: key(x) == named)
    by_text = F.filter(allowed, lambda x: F.contains(key(compact), key(x)))
    return F.coalesce(F.get(by_json, F.lit(0)), F.get(by_text, F.lit(0)))


def localized(base: Column, language: Column, variants: dict[str, tuple[Column, Column]], use_markdown: bool) -> Column:
    """Localised HTML or Markdown of a table when either exists for the language, else the base column."""
    nb = lambda x: squeeze_ends(x) != ""
    base = F.coalesce(base, F.lit(""))
    out = base
    for code, (html, md) in variants.items():
        pick = md if use_markdown else html
        hit = (F.lower(F.coalesce(language, F.lit("uz"))) == code) & (nb(html) | nb(md))
        out = F.when(hit, F.coalesce(F.nullif(pick, F.lit("")), base)).otherwise(out)
    return out
