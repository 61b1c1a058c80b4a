"""Intent rules, gate predicates and query expansion for question tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X


def classify(text: Column | str, refs: Column | None = None) -> Column:
    """Struct (intent, confidence, reason, numeric_query): the first rule that holds decides."""
    ref = R.exact_refs(X.lower_squeeze(text)) if refs is None else refs

    def bind(t: Column) -> Column:
        return X.let(F.struct(t.alias("t"), ref.alias("ref"), N.is_numeric(t).alias("numeric")), _rules)

    return X.let(X.lower_squeeze(text), bind)


def _rules(p: Column) -> Column:
    t, ref, numeric = p["t"], p["ref"], p["numeric"]
    linked = (F.size(ref["document_codes"]) >= 2) | X.contains_any(t, (" va ", " bilan "))
    compare = X.contains_any(t, K.COMPARE_TERMS) & linked
    numbered = (F.size(ref["table_numbers"]) > 0) | (F.size(ref["appendix_numbers"]) > 0)
    table = numbered | X.contains_any(t, K.INTENT_TABLE_TERMS)
    image = X.contains_any(t, K.IMAGE_TERMS)
    band = (F.size(ref["clause_numbers"]) > 0) & (X.contains_any(t, K.BAND_TERMS) | ref["has_explicit"])
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    topical = (words >= 4) & ~ref["has_explicit"]

    def outcome(intent: str, confidence: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(intent).alias("intent"),
            confidence.cast("double").alias("confidence"),
            reason.alias("reason"),
            numeric.alias("numeric_query"),
        )

    return (
        F.when(compare, outcome("compare_documents", F.lit(0.9), F.lit("compare_terms_detected")))
        .when(
            table,
            outcome("table_lookup", F.when(numbered, 0.88).otherwise(0.72), F.lit("table_reference_or_terms")),
        )
        .when(image, outcome("image_lookup", F.lit(0.82), F.lit("image_terms_detected")))
        .when(band, outcome("exact_band_reference", F.lit(0.9), F.lit("clause_reference_detected")))
        .when(
            topical,
            outcome(
                "topical_search",
                F.when(numeric, 0.76).otherwise(0.7),
                F.when(numeric, "numeric_norm_query").otherwise("descriptive_query_without_exact_reference"),
            ),
        )
        .otherwise(outcome("general_synthesis", F.lit(0.6), F.lit("default_fallback")))
    )


def gates(message: Column | str) -> dict[str, Column]:
    """Boolean gate columns of a message, keyed by name."""
    raw = F.coalesce(X._col(message), F.lit(""))
    n = X.normalize_text(X._col(message))
    out = {name: X.let(n, test) for name, test in _GATES.items()}
    out["direct_lookup"] = ~F.contains(raw, F.lit("?")) & X.let(n, lambda t: ~X.contains_any(t, K.TABLE_QUESTION_HINTS))
    out["clause_lookup"] = F.rlike(raw, F.lit("(?iU)" + K.CLAUSE_LOOKUP))
    return out


def _explicit(n: Column) -> Column:
    return R.first_table_number(n).isNotNull() | R.first_appendix_number(n).isNotNull()


def _table_word(n: Column) -> Column:
    return F.rlike(n, F.lit("(?iU)" + K.TABLE_WORD))


def _request(n: Column) -> Column:
    # the words are looked for first, as they cost least
    return X.contains_any(n, K.TABLE_HINTS) | (_explicit(n) & (_table_word(n) | (F.size(R.doc_codes(n)) > 0)))


def _row_priority(n: Column) -> Column:
    return (
        X.contains_any(n, K.ROW_TABLE_TERMS)
        & X.contains_any(n, K.ROW_FOCUS_TERMS)
        & X.contains_any(n, K.ROW_QUESTION_TERMS)
        & ~X.contains_any(n, K.DOCUMENT_LIST_PHRASES)
    )


def _missing_case(n: Column) -> Column:
    amount = F.rlike(n, F.lit(r"(?U)\b(qancha|necha|minimal|maksimal|me'yor|meyor)\b")) & ~F.rlike(n, F.lit(r"\d"))
    lonely_compare = X.contains_any(n, ("taqqos", "solishtir", "farqi")) & ~F.contains(n, F.lit(" va "))
    no_use = X.contains_any(n, ("eshik", "deraza", "zina", "evakuatsiya")) & ~X.contains_any(
        n, ("turar joy", "jamoat", "sanoat", "ombor")
    )
    return (
        F.when(X.contains_any(n, K.DOCUMENT_LIST_PHRASES), None)
        .when(amount, "missing_parameter")
        .when(lonely_compare, "missing_comparison_target")
        .when(no_use, "missing_use_case")
    )


#: Gates by the normalised message, which each binds once.
_GATES = {
    "greeting": lambda n: F.rlike(n, F.lit("(?U)" + K.GREETING)),
    "in_domain": lambda n: X.contains_any(n, K.DOMAIN_KEYWORDS),
    "out_of_scope": lambda n: X.contains_any(n, K.OUT_OF_SCOPE_KEYWORDS),
    "table_request": _request,
    "explicit_table": _explicit,
    "missing_table_number": lambda n: _table_word(n) & ~_explicit(n),
    "row_priority": _row_priority,
    "table_intent": lambda n: X.contains_any(n, K.INTENT_TABLE_TERMS) | _request(n),
    "numeric_requirement": lambda n: X.contains_any(n, K.NUMERIC_REQUIREMENT_HINTS) | N.is_numeric(n),
    "document_list": lambda n: X.contains_any(n, K.DOCUMENT_LIST_PHRASES),
    "missing_case": _missing_case,
}


def strip_references(base: Column) -> Column:
    t = X.simple_norm(base)
    t = F.regexp_replace(t, r"(?iU)\b(shnq|qmq|kmk|snip)\s*[0-9][0-9.\-]*\b", "")
    t = F.regexp_replace(
        t,
        r"(?iU)\b(?:band|modda)\s*[-.:]?\s*\d+(?:\.\d+){0,3}\b|\b\d+(?:\.\d+){0,3}\s*[-.:]?\s*(?:band|modda)\b",
        "",
    )
    return X.squeeze(t)


def expansions(query: Column | str, refs: Column, profile: Column) -> Column:
    """Up to six phrasings of a question: itself, without references, templated and with synonyms."""
    base = X.squeeze(query)
    norm = X.simple_norm(base)
    bare = strip_references(base)
    has_docs, has_clauses = F.size(refs["document_codes"]) > 0, F.size(refs["clause_numbers"]) > 0
    numeric, comp, props = profile["is_numeric"], profile["comparator"], profile["property_terms"]

    def plus(suffix: str, when: Column) -> Column:
        return F.when(when, F.concat(base, F.lit(" " + suffix)))

    other = ~comp.isin("min", "max")
    items = [
        base,
        F.when((bare != "") & (bare != norm), bare),
        plus("band matni", has_docs & has_clauses),
        plus("band talabi", has_docs & ~has_clauses),
        plus("me'yor talabi", has_docs & ~has_clauses),
        plus("shnq band talabi", ~has_docs),
        plus("normativ band", ~has_docs),
        plus("kamida me'yor", numeric & (comp == "min")),
        plus("minimal talab band", numeric & (comp == "min")),
        plus("ko'pi bilan me'yor", numeric & (comp == "max")),
        plus("maksimal talab band", numeric & (comp == "max")),
        plus("sonli norma", numeric & other),
        F.when(
            numeric & (F.size(props) > 0),
            F.concat(base, F.lit(" "), F.array_join(F.slice(props, 1, 2), " "), F.lit(" normasi")),
        ),
    ]
    for word, variants in K.SYNONYMS.items():
        for variant in variants:
            items.append(F.when(F.contains(norm, F.lit(word)), F.replace(norm, F.lit(word), F.lit(variant))))
    squeezed = F.transform(F.array_compact(F.array(*items)), X.squeeze)
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.slice(X.ci_distinct(squeezed), 1, 6))


def metadata_filters(intent: Column, refs: Column) -> Column:
    """Filter lists implied by a question's intent and references."""
    titles = F.concat(
        F.transform(refs["chapter_numbers"], lambda n: F.concat(F.lit("bob "), n)),
        F.transform(refs["chapter_numbers"], lambda n: F.concat(n, F.lit("-bob"))),
    )
    kinds = (
        F.when(intent == "table_lookup", F.array(F.lit("table_row")))
        .when(intent == "image_lookup", F.array(F.lit("image")))
        .when(intent == "exact_band_reference", F.array(F.lit("clause")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        X.ci_distinct(refs["document_codes"]).alias("document_codes"),
        X.ci_distinct(refs["clause_numbers"]).alias("clause_numbers"),
        X.ci_distinct(refs["table_numbers"]).alias("table_numbers"),
        X.ci_distinct(refs["appendix_numbers"]).alias("appendix_numbers"),
        X.ci_distinct(titles).alias("section_titles"),
        kinds.alias("content_types"),
    )
