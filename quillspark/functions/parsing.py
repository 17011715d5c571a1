"""Structured fields from short texts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import display_text, normalize_text

# Fixed values.
FORM_WORDS = ["tablet", "tab", "capsule", "cap", "syrup", "suspension", "injection", "infusion", "drop", "drops", "cream", "gel", "ointment", "solution", "powder", "lotion", "spray", "soap", "shampoo", "respules", "respule", "strip", "bottle", "vial", "ampoule", "sachet"]
FORM_SYNONYMS = {
    "tab": "tablet",
    "tabs": "tablet",
    "tablet": "tablet",
    "cap": "capsule",
    "caps": "capsule",
    "capsule": "capsule",
    "syp": "syrup",
    "syr": "syrup",
    "syrup": "syrup",
    "inj": "injection",
    "injection": "injection",
    "drop": "drops",
    "drops": "drops",
    "cream": "cream",
    "gel": "gel",
    "ointment": "ointment",
    "oint": "ointment",
}
RELEASE_MODIFIERS = {"sr": "SR", "cr": "CR", "er": "ER", "xr": "ER", "mr": "MR", "ec": "EC", "dr": "DR", "dsr": "DSR", "od": "OD"}
UNIT_TOKEN = r"^\d+(\.\d+)?(%|mg|mcg|g|ml|iu|kg|l)"
# Strengths and forms of listed medicines.
LISTED_STRENGTH = r"(?i)(\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|IU|%)(?:/\d+(?:\.\d+)?\s*(?:ml|g))?\b)"
LISTED_FORMS = ["tablet", "capsule", "injection", "solution", "suspension", "cream", "ointment", "drops", "powder", "syrup", "inhalation", "oral"]
STRENGTH = r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?|%)\b"


def brand_family(name: Column, ascii_only: bool = False) -> Column:
    """The normalized tokens before the first form word, bare number or strength; all of them if none is left."""
    text = normalize_text(name, ascii_only)
    words = F.split(text, " ")

    def stops(t: Column) -> Column:
        stem = F.regexp_replace(t, r"^[0-9.]+|[0-9.]+$", "")
        return (stem == "") | stem.isin(FORM_WORDS) | t.rlike(UNIT_TOKEN)

    first = F.array_position(F.transform(words, stops), True)
    family = F.array_join(F.when(first == 0, words).otherwise(F.slice(words, F.lit(1), (first - 1).cast("int"))), " ")
    return F.when(family == "", text).otherwise(family)


def brand_family_display(name: Column, ascii_only: bool = False) -> Column:
    """As many words of the name, as it is written, as its family has; the whole name where the family is all of it."""
    raw, family = display_text(name, ascii_only), brand_family(name, ascii_only)
    return F.when(family == normalize_text(name, ascii_only), raw).otherwise(F.array_join(F.slice(F.split(raw, " "), F.lit(1), F.size(F.split(family, " "))), " "))


def infer_form(name: Column, pack: Column, ascii_only: bool = False) -> Column:
    """The alphabetically first form word of name and pack; empty if there is none."""
    text = F.concat_ws(" ", normalize_text(name, ascii_only), normalize_text(pack, ascii_only))
    return F.coalesce(*(F.when(text.rlike(rf"\b{w}s?\b"), w) for w in sorted(FORM_WORDS)), F.lit(""))


def normalize_strength(value: Column, ascii_only: bool = False) -> Column:
    return F.regexp_replace(normalize_text(value, ascii_only), r"\s+", "")


def composition(value: Column, ascii_only: bool = False) -> Column:
    """Components "name (strength)" between " + " or ";" as array<struct<name, ingredient, strength_text, strength>>."""
    pieces = F.filter(F.transform(F.split(display_text(value, ascii_only), r"\s+\+\s+|;\s*"), lambda p: F.trim(p)), lambda p: p != "")

    def parse(piece: Column) -> Column:
        shape = r"^(.*?)(?:\s*\(([^()]*)\))?\s*$"
        name, strength = F.trim(F.regexp_extract(piece, shape, 1)), F.trim(F.regexp_extract(piece, shape, 2))
        # The whole text is in its normal form already, and a lambda can't call Python.
        return F.struct(name.alias("name"), normalize_text(name, True).alias("ingredient"), strength.alias("strength_text"), normalize_strength(strength, True).alias("strength"))

    return F.filter(F.transform(pieces, parse), lambda c: c["name"] != "")


def formulation_signature(components: Column, form: Column) -> Column:
    parts = F.array_sort(F.transform(components, lambda c: F.struct(c["ingredient"].alias("i"), c["strength"].alias("s"))))
    joined = F.transform(parts, lambda c: F.concat_ws(":", c["i"], c["s"]))
    return F.array_join(F.concat(joined, F.when(form != "", F.array(F.concat(F.lit("form:"), form))).otherwise(F.array().cast("array<string>"))), "|")


def _first_listed(value: Column, words: dict[str, str], ascii_only: bool) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    found = F.filter(F.transform(F.split(normalize_text(value, ascii_only), "[^a-z0-9]+"), lambda t: F.try_element_at(lookup, t)), lambda t: t.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def dosage_form(value: Column, ascii_only: bool = False) -> Column:
    return _first_listed(value, FORM_SYNONYMS, ascii_only)


def release_modifier(value: Column, ascii_only: bool = False) -> Column:
    return _first_listed(value, RELEASE_MODIFIERS, ascii_only)


def strength(value: Column, ascii_only: bool = False) -> Column:
    """The first number with a unit, without trailing zeros behind a point, units in the singular; else empty."""
    text = normalize_text(value, ascii_only)
    number, unit = F.regexp_extract(text, STRENGTH, 1), F.regexp_replace(F.regexp_extract(text, STRENGTH, 2), "units", "unit")
    number = F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)
    return F.concat(number, unit)


def all_strengths(value: Column, ascii_only: bool = False) -> Column:
    return F.array_join(F.regexp_extract_all(normalize_text(value, ascii_only), F.lit(f"({STRENGTH})"), F.lit(1)), " | ")


def listed_strengths(text: Column) -> Column:
    """All strengths as they are written, joined by bars."""
    return F.array_join(F.regexp_extract_all(text, F.lit(LISTED_STRENGTH), F.lit(1)), " | ")


def listed_forms(text: Column) -> Column:
    """All forms that occur, in the order of LISTED_FORMS, joined by bars."""
    return F.array_join(F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{f}s?\b"), f) for f in LISTED_FORMS))), " | ")


def observed_formulation(raw: Column, strength_text: Column, dosage_text: Column, ascii_only: bool = False) -> Column:
    """What a mention shows: strength, form, release modifier, and whether (and how many) components are listed."""
    text = normalize_text(raw, ascii_only)
    first = lambda a, b: F.when(a != "", a).otherwise(b)
    combined = text.rlike(r"\s\+\s|/| with ")
    pieces = F.size(F.filter(F.split(text, r"\s+\+\s+|\s+with\s+"), lambda p: F.trim(p) != ""))
    return F.struct(
        first(strength(strength_text, ascii_only), strength(raw, ascii_only)).alias("strength"),
        first(dosage_form(raw, ascii_only), dosage_form(dosage_text, ascii_only)).alias("form"),
        release_modifier(raw, ascii_only).alias("release_modifier"),
        combined.alias("combination"),
        F.when(combined & (pieces > 1), pieces).alias("component_count"),
    )
