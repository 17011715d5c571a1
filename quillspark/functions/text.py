"""Text normalization as column functions. Only texts beyond ASCII visit Python, for compatibility normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FORM_NOISE = r"\b(tab|tabs|tablet|cap|caps|capsule|syp|syr|syrup|inj|injection|drop|drops|cream|oint|ointment)\b\.?"
STRENGTH_NOISE = r"\b\d+(\.\d+)?\s*(mg|mcg|g|ml|iu|units?|%)\b"
FREQUENCY = {
    "od": "once daily",
    "bd": "twice daily",
    "tds": "three times daily",
    "tid": "three times daily",
    "qid": "four times daily",
    "q6h": "every 6 hours",
    "q8h": "every 8 hours",
    "q12h": "every 12 hours",
    "hs": "at bedtime",
    "sos": "as needed",
    "prn": "as needed",
    "stat": "immediately",
    "bbf": "before breakfast",
    "af": "after food",
    "pc": "after meals",
    "ac": "before meals",
}
FORMS = {
    "tab": "tablet",
    "tabs": "tablets",
    "cap": "capsule",
    "caps": "capsules",
    "inj": "injection",
    "syp": "syrup",
    "susp": "suspension",
    "e/d": "eye drops",
    "ed": "eye drops",
    "oint": "ointment",
    "crm": "cream",
    "gtte": "drops",
}
ROUTES = {
    "po": "oral",
    "iv": "intravenous",
    "im": "intramuscular",
    "sc": "subcutaneous",
    "sl": "sublingual",
    "it": "intrathecal",
    "id": "intradermal",
}
CONDITIONS = {
    "htn": "hypertension",
    "dm": "diabetes mellitus",
    "cad": "coronary artery disease",
    "ckd": "chronic kidney disease",
    "ptb": "pulmonary tuberculosis",
    "hypo": "hypothyroidism",
    "hyper": "hyperthyroidism",
    "anc": "antenatal care",
    "all.": "allergic",
    "conj.": "conjunctivitis",
}
ABBREVIATIONS = FREQUENCY | FORMS | ROUTES | CONDITIONS


#: White space of Unicode but for the plain space, as a class of Java's expressions.
_OTHER_SPACE = r"\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that isn't one plain space already.
_LOOSE = f"[ {_OTHER_SPACE}]{{2,}}|[{_OTHER_SPACE}]"


#: What normalized text leaves out: everything but letters, digits, space and % . / + -, and what separates its tokens.
#: Both are stated as ranges, which Java matches much faster than a negated class.
_LEFT_OUT, _BETWEEN = r"[\x{0}-\x{1f}!-$&-*,:-`{-\x{10ffff}]+", "[ %+./-]+"


def _composed(text: Column, form: str, ascii_only: bool) -> Column:
    """text in a normal form; ASCII is its own. ascii_only promises ASCII and keeps Python out of the plan."""
    if ascii_only:
        return text

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(convert, "string", F.PandasUDFType.SCALAR)(text)).otherwise(text)


def collapse(text: Column) -> Column:
    """Each run of white space, of any script, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, _LOOSE, " "))


def _present(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.lower(text) == "nan", F.lit("")).otherwise(text)


def normalize_text(value: Column, ascii_only: bool = False) -> Column:
    """Lower case; letters, digits and % . / + space - only; single spaces. Null and "nan" are empty."""
    text = F.lower(collapse(_composed(_present(value), "NFKC", ascii_only)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, _LEFT_OUT, ""), " {2,}", " "))


def display_text(value: Column, ascii_only: bool = False) -> Column:
    return collapse(_composed(_present(value), "NFKC", ascii_only))


def lexical_surface(value: Column, ascii_only: bool = False) -> Column:
    """Lower case with plain dashes and single spaces; null stays null."""
    dashes = "‐‑‒–—−"
    return F.lower(collapse(F.translate(_composed(value, "NFKC", ascii_only), dashes, "-" * len(dashes))))


def tokens(value: Column, ascii_only: bool = False) -> Column:
    """Tokens of two or more characters of the normalized text; order and repeats stay."""
    return split_tokens(normalize_text(value, ascii_only))


def split_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, _BETWEEN), lambda t: F.length(t) > 1)


def query_surface(value: Column, ascii_only: bool = False) -> Column:
    """The normalized text without form words and strengths, or with them if nothing else is left."""
    text = normalize_text(value, ascii_only)
    bare = collapse(F.regexp_replace(F.regexp_replace(text, FORM_NOISE, " "), STRENGTH_NOISE, " "))
    return F.when(bare != "", bare).otherwise(text)


def comparison_text(value: Column, ascii_only: bool = False) -> Column:
    """Lower case without code fences; dates with dashes; single spaces."""
    text = F.regexp_replace(_composed(F.coalesce(value, F.lit("")), "NFC", ascii_only), r"```[a-zA-Z]*", "")
    text = F.lower(F.regexp_replace(text, "`", ""))
    return collapse(F.regexp_replace(text, r"(\d+)[./](\d+)[./](\d+)", "$1-$2-$3"))


def normalize_date(value: Column, ascii_only: bool = False) -> Column:
    """dd-mm-yyyy where the text is such a date (two-digit years are 20yy); else the comparison text; empty: null."""
    text = comparison_text(value, ascii_only)
    shape = r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$"
    day, month, year = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    date = F.concat_ws("-", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(text.rlike(shape), date).otherwise(text)


def alphanumeric(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def word_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def expand_abbreviations(value: Column, words: dict[str, str] = ABBREVIATIONS) -> Column:
    """Whole abbreviations in their long form, first listed first; then single spaces and single dots."""
    text = F.lower(F.coalesce(value, F.lit("")))
    lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(r"(all\.|conj\.|e/d|[a-z0-9_]+|[^a-z0-9_]+)"), F.lit(1))
    text = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, p), p)), "")
    return collapse(F.regexp_replace(text, r"\.+", "."))


def repair_json(value: Column) -> Column:
    """The outermost object of a model's answer, without code fences and trailing commas."""
    text = F.regexp_extract(F.regexp_replace(value, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    raw = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(raw, 256), 1, length))


def normalized_fields(df: DataFrame) -> DataFrame:
    """df with a normalized_* column for each raw_* text column: abbreviations written out."""
    raw = [c for c, t in df.dtypes if c.startswith("raw_") and t == "string"]
    return df.withColumns({c.replace("raw_", "normalized_", 1): expand_abbreviations(F.col(c)) for c in raw})


def normalized_items(items: Column, fields: list[str]) -> Column:
    """The same for an array of structs: each with its fields, and the raw ones written out."""
    new = lambda x: [expand_abbreviations(x[f]).alias(f.replace("raw_", "normalized_", 1)) for f in fields if f.startswith("raw_")]
    return F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in fields), *new(x)))
