"""Numeric requirements: evidence with units, query profiles and match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions.text import contains_any, let, simple_norm

_PATTERN = "(?iU)" + K.VALUE_UNIT


def unit_name(raw: Column) -> Column:
    u = F.lower(raw)
    return (
        F.when(u.isin("cm", "sm"), "cm")
        .when(u.isin("m", "metr", "metri", "metra", "meter", "metre"), "m")
        .when(u.isin("foiz", "%"), "%")
        .otherwise(u)
    )


def metres(value: Column, unit: Column) -> Column:
    """Length in metres; null for other units."""
    return F.when(unit == "mm", value / 1000.0).when(unit == "cm", value / 100.0).when(unit == "m", value)


def evidence(text: Column | str) -> Column:
    """Array of structs (raw, value, unit, metres, start, end) in text order.

    Positions follow from the pieces between matches, so they need no second search.
    """

    def pieces(norm: Column) -> Column:
        raws = F.regexp_extract_all(norm, F.lit(_PATTERN), F.lit(0))
        return F.struct(
            raws.alias("raw"),
            F.regexp_extract_all(norm, F.lit(_PATTERN), F.lit(1)).alias("value"),
            F.regexp_extract_all(norm, F.lit(_PATTERN), F.lit(2)).alias("unit"),
            F.transform(F.split(norm, _PATTERN), F.length).alias("gap"),
            F.transform(raws, F.length).alias("len"),
        )

    def items(p: Column) -> Column:
        def item(raw: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(p["gap"], 1, i + 1), F.lit(0), lambda a, x: a + x)
            matched = F.aggregate(F.slice(p["len"], 1, i), F.lit(0), lambda a, x: a + x)
            value = F.replace(F.get(p["value"], i), F.lit(","), F.lit(".")).cast("double")
            unit = unit_name(F.get(p["unit"], i))
            return F.struct(
                raw.alias("raw"),
                value.alias("value"),
                unit.alias("unit"),
                metres(value, unit).alias("metres"),
                (before + matched).alias("start"),
                (before + matched + F.length(raw)).alias("end"),
            )

        return F.transform(p["raw"], item)

    return let(let(simple_norm(text), pieces), items)


def amounts(norm: Column) -> Column:
    """Array of structs (value, unit, metres) of a normalised text, in text order: ``evidence`` without places."""

    def amount(value: Column, raw: Column) -> Column:
        unit, number = unit_name(raw), F.replace(value, F.lit(","), F.lit(".")).cast("double")
        return F.struct(number.alias("value"), unit.alias("unit"), metres(number, unit).alias("metres"))

    part = lambda n: F.regexp_extract_all(norm, F.lit(_PATTERN), F.lit(n))
    none = F.array().cast("array<struct<value:double,unit:string,metres:double>>")
    # a text without a digit states nothing, so its patterns are not tried
    return F.when(norm.rlike(r"(?U)\d"), F.zip_with(part(1), part(2), amount)).when(norm.isNotNull(), none)


def comparator(norm: Column) -> Column:
    return (
        F.when(contains_any(norm, K.MIN_TERMS), "min")
        .when(contains_any(norm, K.MAX_TERMS), "max")
        .when(contains_any(norm, K.EXACT_TERMS), "exact")
        .otherwise("unknown")
    )


def property_terms(norm: Column) -> Column:
    found = F.array(*[F.when(contains_any(norm, aliases), F.lit(name)) for name, aliases in K.PROPERTY_ALIASES.items()])
    return F.array_compact(found)


def query_profile(text: Column | str) -> Column:
    """What a question asks for: comparator, properties, units and stated values."""

    def build(p: Column) -> Column:
        norm, ev, comp, props = p["norm"], p["ev"], p["comp"], p["props"]
        numeric = (
            (comp != "unknown")
            | (F.size(ev) > 0)
            | ((F.size(props) > 0) & contains_any(norm, K.NUMERIC_QUESTION_TERMS))
        )
        return F.struct(
            numeric.alias("is_numeric"),
            comp.alias("comparator"),
            props.alias("property_terms"),
            F.array_distinct(F.transform(ev, lambda e: e["unit"])).alias("unit_hints"),
            F.transform(ev, lambda e: e["value"]).alias("values"),
            F.filter(F.transform(ev, lambda e: e["metres"]), lambda m: m.isNotNull()).alias("lengths"),
        )

    def bind(norm: Column) -> Column:
        parts = F.struct(norm.alias("norm"), amounts(norm).alias("ev"), comparator(norm).alias("comp"), property_terms(norm).alias("props"))
        return let(parts, build)

    return let(simple_norm(text), bind)


def is_numeric(text: Column | str) -> Column:
    """The ``is_numeric`` of a text's profile, without its other parts."""

    def test(norm: Column) -> Column:
        asked = contains_any(norm, K.NUMERIC_QUESTION_TERMS) & (F.size(property_terms(norm)) > 0)
        return (comparator(norm) != "unknown") | asked | (F.size(amounts(norm)) > 0)

    return let(simple_norm(text), test)


def _comparator_bonus(comp: Column, norm: Column) -> Column:
    has_min, has_max = contains_any(norm, K.MIN_HINTS), contains_any(norm, K.MAX_HINTS)
    low = F.when(has_min, 0.22).when(has_max, -0.08).otherwise(0.06)
    high = F.when(has_max, 0.22).when(has_min, -0.08).otherwise(0.06)
    exact = F.when(F.contains(norm, F.lit("aniq")), 0.12).otherwise(0.04)
    return F.when(comp == "min", low).when(comp == "max", high).when(comp == "exact", exact).otherwise(0.04)


def match(profile: Column, text: Column | str) -> Column:
    """Struct (score, value, unit, evidence_count) of a text under a profile; the first best evidence wins."""

    def bind(norm: Column) -> Column:
        prop = F.when(F.exists(profile["property_terms"], lambda t: F.contains(norm, t)), 0.18).otherwise(0.04)
        return F.struct(
            amounts(norm).alias("ev"),
            prop.alias("prop"),
            _comparator_bonus(profile["comparator"], norm).alias("comp"),
            F.when(F.contains(norm, F.lit("kerak")), 0.08).otherwise(0.0).alias("normative"),
        )

    def best_of(p: Column) -> Column:
        def scored(e: Column, i: Column) -> Column:
            unit = (
                F.when(F.size(profile["unit_hints"]) == 0, 0.12)
                .when(F.array_contains(profile["unit_hints"], e["unit"]), 0.2)
                .otherwise(0.03)
            )
            gap = F.when(
                e["metres"].isNotNull(),
                F.array_min(F.transform(profile["lengths"], lambda m: F.abs(e["metres"] - m))),
            )
            near = F.when(gap.isNull(), 0.0).when(gap <= 0.001, 0.18).when(gap <= 0.02, 0.1).otherwise(-0.04)
            total = F.lit(0.12) + unit + p["prop"] + p["comp"] + p["normative"] + near
            return F.struct(total.alias("s"), (-i).alias("i"), e["value"].alias("value"), e["unit"].alias("unit"))

        return F.struct(
            F.array_max(F.transform(p["ev"], scored)).alias("best"), F.size(p["ev"]).alias("n")
        )

    def result(r: Column) -> Column:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["best"]["s"]))
        return F.struct(
            F.coalesce(clamped, F.lit(0.0)).alias("score"),
            r["best"]["value"].alias("value"),
            r["best"]["unit"].alias("unit"),
            r["n"].alias("evidence_count"),
        )

    none = F.struct(
        F.lit(0.0).alias("score"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(0).alias("evidence_count"),
    )
    hit = let(let(let(simple_norm(text), bind), best_of), result)
    return F.when(profile["is_numeric"], hit).otherwise(none)


#: Lengths this close count as near, and buckets are a little wider, so a near length is at most one bucket away.
NEAR_METRES, BUCKET_WIDTH = 0.02, 0.025


def measures(text: Column | str) -> Column:
    """Distinct stated values as structs (unit, value, bucket): lengths in metres, other units as written."""

    def measure(e: Column) -> Column:
        value = F.coalesce(e["metres"], e["value"])
        unit = F.when(e["metres"].isNotNull(), "length").otherwise(e["unit"])
        return F.struct(unit.alias("unit"), value.alias("value"), F.floor(value / BUCKET_WIDTH).alias("bucket"))

    return F.array_distinct(F.transform(let(simple_norm(text), amounts), measure))


def same_measure(asked: Column, stated: Column, unit: Column) -> Column:
    """Whether a stated value is one that was asked for: lengths within two centimetres, others equal."""
    return F.when(unit == "length", F.abs(asked - stated) <= NEAR_METRES).otherwise(asked == stated)


def format_value(value: Column, unit: Column) -> Column:
    """Decimal comma, at most three decimals, percent sign attached."""
    fixed = F.format_string("%.3f", F.bround(value, 3))
    text = F.replace(F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ""), F.lit("."), F.lit(","))
    return F.when(unit == "%", F.concat(text, F.lit("%"))).otherwise(F.concat(text, F.lit(" "), unit))
