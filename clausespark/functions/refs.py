"""References to documents, clauses, chapters, tables and appendices as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions.text import _col, ci_distinct, contains_any, let, squeeze, squeeze_ends

# Unicode-aware, case-insensitive matching.
FLAGS = "(?iU)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(group))


def _either(text: Column, pattern: str) -> Column:
    """Captures of a two-sided pattern where exactly one of the groups matches."""
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda a, b: F.when(a != "", a).otherwise(b))


def _first_either(text: Column, pattern: str) -> Column:
    a = F.regexp_extract(text, FLAGS + pattern, 1)
    b = F.regexp_extract(text, FLAGS + pattern, 2)
    return F.nullif(F.when(a != "", a).otherwise(b), F.lit(""))


def _where(text: Column, word: str, values: Column) -> Column:
    """``values`` of a text that holds one of the words its pattern cannot do without; none of any other."""
    return F.when(text.rlike(FLAGS + word), values).when(text.isNotNull(), F.array().cast("array<string>"))


def _codes(text: Column) -> Column:
    found = F.zip_with(
        _all(text, K.DOC_CODE, 1), _all(text, K.DOC_CODE, 2), lambda a, b: F.concat(F.upper(a), F.lit(" "), b)
    )
    return _where(text, "shnq|qmq|kmk|snip", ci_distinct(found))


def doc_codes(value: Column | str) -> Column:
    """Document codes named in a text, upper-case family, distinct, in order."""
    return let(squeeze(F.lower(F.coalesce(_col(value), F.lit("")))), _codes)


def code_key(value: Column | str) -> Column:
    """Comparison key of a document code: lower case without whitespace."""
    return F.lower(F.regexp_replace(F.coalesce(_col(value), F.lit("")), K.WS, ""))


def exact_refs(value: Column | str) -> Column:
    """Struct of every explicit reference in a text."""

    def parse(text: Column) -> Column:
        bare = _where(text, r"\d\.\d", F.array_distinct(_all(text, K.BARE_CLAUSE, 1)))
        return F.struct(
            text.alias("text"), _codes(text).alias("codes"), _where(text, "band|modda", _either(text, K.CLAUSE_REF)).alias("clauses"), bare.alias("bare")
        )

    def gather(p: Column) -> Column:
        text = p["text"]
        code_numbers = F.transform(p["codes"], lambda c: F.split(F.split(c, " ", 2)[1], "-")[0])
        return F.struct(
            p["codes"].alias("document_codes"),
            ci_distinct(F.concat(p["clauses"], F.array_except(p["bare"], code_numbers))).alias("clause_numbers"),
            _where(text, "bob", ci_distinct(_either(text, K.CHAPTER_REF))).alias("chapter_numbers"),
            _where(text, "jadval", ci_distinct(_either(text, K.TABLE_REF))).alias("table_numbers"),
            _where(text, "ilova", ci_distinct(_either(text, K.APPENDIX_REF))).alias("appendix_numbers"),
        )

    def flag(r: Column) -> Column:
        names = ("document_codes", "clause_numbers", "chapter_numbers", "table_numbers", "appendix_numbers")
        total = sum((F.size(r[n]) for n in names[1:]), F.size(r[names[0]]))
        return F.struct(*[r[n].alias(n) for n in names], (total > 0).alias("has_explicit"))

    def digits(text: Column) -> Column:
        # every reference holds a digit
        none = F.array().cast("array<string>")
        nothing = F.struct(text.alias("text"), none.alias("codes"), none.alias("clauses"), none.alias("bare"))
        return F.when(text.rlike(r"(?U)\d"), parse(text)).otherwise(nothing)

    return let(let(let(squeeze(F.lower(F.coalesce(_col(value), F.lit("")))), digits), gather), flag)


def first_table_number(normalized: Column) -> Column:
    return _first_either(normalized, K.TABLE_REF)


def first_appendix_number(normalized: Column) -> Column:
    return _first_either(normalized, K.APPENDIX_REF)


def table_key(value: Column | str) -> Column:
    """Table reference with separators unified to dots."""
    return F.btrim(
        F.regexp_replace(F.lower(squeeze_ends(value)), r"(?U)[\s,\-]+", "."), F.lit(".")
    )


def loose_table_key(value: Column | str) -> Column:
    """Table reference of drafts: underscores separate as well."""
    return F.btrim(F.regexp_replace(F.lower(squeeze_ends(value)), r"(?U)[\s,._-]+", "."), F.lit("."))


def table_variants(value: Column | str) -> Column:
    """Spellings under which a table number may be stored."""
    key = table_key(value)
    dot = F.lit(".")
    out = F.array(key, F.replace(key, dot, F.lit("-")), F.replace(key, dot, F.lit(",")), F.replace(key, dot, F.lit("")))
    return F.filter(F.array_distinct(out), lambda v: v != "")


def table_mention_pattern(value: Column | str) -> Column:
    """Regex that finds a table number beside its keyword with any separators."""
    key = F.regexp_replace(table_key(value), r"([^0-9A-Za-z_.])", r"\\$1")
    num = F.replace(key, F.lit("."), F.lit(r"[\s,.\-]*"))
    head, tail = r"(?iU)(?:\bjadval(?:da|ni|ga|dan|ning|lar)?\s*[-.]?\s*", r"\s*[-.]?\s*jadval(?:da|ni|ga|dan|ning|lar)?\b)"
    return F.concat(F.lit(head), num, F.lit(r"\b|\b"), num, F.lit(tail))


def table_mentioned(text: Column, number: Column) -> Column:
    """Whether a normalised text mentions the table number."""
    return (text != "") & (table_key(number) != "") & F.rlike(text, table_mention_pattern(number))


def table_label(number: Column | str) -> Column:
    v = F.trim(F.coalesce(_col(number), F.lit("")))
    return (
        F.when(v == "", "Jadval")
        .when(F.lower(v).startswith("ilova-"), F.concat(F.split(v, "-", 2)[1], F.lit("-ilova")))
        .otherwise(F.concat(v, F.lit("-jadval")))
    )


def label_table_number(cleaned_lower: Column) -> Column:
    """Table number inside a caption-like label."""
    a = F.regexp_extract(cleaned_lower, FLAGS + K.TABLE_LABEL_A, 1)
    b = F.regexp_extract(cleaned_lower, FLAGS + K.TABLE_LABEL_B, 1)
    return F.nullif(F.when(a != "", a).otherwise(b), F.lit(""))


def label_title(cleaned: Column) -> Column:
    """Label without its number token; only the first pattern that matches is removed, once."""
    out = cleaned
    for pattern in (K.TABLE_LABEL_B, K.TABLE_LABEL_A):
        rx = FLAGS + pattern
        parts = F.split(cleaned, rx, 2)
        candidate = F.btrim(F.concat(parts[0], F.get(parts, F.lit(1))), F.lit(" -:."))
        out = F.when(F.rlike(cleaned, F.lit(rx)), F.coalesce(F.nullif(candidate, F.lit("")), cleaned)).otherwise(out)
    return out


def title_doc_code(cleaned: Column) -> Column:
    """Document code stated in a title, or null."""
    family = F.regexp_extract(cleaned, FLAGS + K.TITLE_DOC_CODE, 1)
    number = F.regexp_extract(cleaned, FLAGS + K.TITLE_DOC_CODE, 2)
    return F.when(family != "", F.concat(F.upper(family), F.lit(" "), number))


def looks_like_selection(message: Column | str) -> Column:
    """A short reply that names one document."""
    text = squeeze(message)
    n = F.size(F.split(text, " "))
    named = F.size(doc_codes(text)) > 0
    return (text != "") & named & ((n <= 8) | ((n <= 14) & contains_any(F.lower(text), K.SELECTION_MARKERS)))


def looks_like_document_prompt(
    message: Column | str, prompt: str = K.AMBIGUOUS_PROMPT, markers: tuple[str, ...] = K.SELECTION_PROMPTS
) -> Column:
    """An assistant message that asks which document is meant."""
    raw = F.coalesce(_col(message), F.lit(""))
    text = squeeze(F.lower(raw))
    listed = F.contains(raw, F.lit("\n1.")) | F.contains(raw, F.lit("\r\n1."))
    listed = listed | contains_any(text, markers)
    return (text != "") & (F.contains(text, F.lit(prompt)) | ((F.size(doc_codes(text)) >= 2) & listed))


def source_id(kind: Column, code: Column, fields: dict[str, Column]) -> Column:
    """Identity string of an answer source; the fields used depend on its kind."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    doc = code_key(code)
    nb = lambda name: F.nullif(fields[name], F.lit(""))
    ref = lambda *names: F.lower(F.trim(F.coalesce(*[nb(n) for n in names], F.lit(""))))
    join = lambda head, *parts: F.concat(head, F.lit(":"), doc, *[x for p in parts for x in (F.lit(":"), p)])
    row_index = F.coalesce(fields["row_index"].cast("string"), F.lit("None"))
    return (
        F.when(k == "clause", join(F.lit("clause"), ref("clause_number", "html_anchor")))
        .when(k == "table_row", join(F.lit("table_row"), ref("table_number"), row_index))
        .when(k == "table", join(F.lit("table"), ref("table_number")))
        .when(k == "image", join(F.lit("image"), ref("appendix_number", "image_url")))
        .otherwise(join(F.coalesce(F.nullif(k, F.lit("")), F.lit("source")), F.left(ref("title", "snippet"), F.lit(64))))
    )


def source_hash(ids: Column) -> Column:
    """sha1 of the sorted identity list written as a JSON array of strings."""
    esc = F.transform(
        F.array_sort(ids),
        lambda s: F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
    )
    body = F.array_join(F.transform(esc, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", ")
    return F.sha1(F.concat(F.lit("["), body, F.lit("]")))
