"""Functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import parsing, similarity, text


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, ""), ("NaN", ""), ("  Ａmoxy  500mg®  ", "amoxy 500mg"), ("A & B (c)", "a b c"), ("½ tab", "12 tab"), ("x/y + 5%", "x/y + 5%")],
)
def test_normalize_text(spark, value, want):
    assert one(spark, text.normalize_text(F.col("v")), v=value) == want


def test_text(spark):
    assert one(spark, text.lexical_surface(F.col("v")), v="A–b  C") == "a-b c"
    assert one(spark, text.lexical_surface(F.col("v")), v=None) is None
    assert one(spark, text.tokens(F.col("v")), v="Tab. A 500mg/ab ab") == ["tab", "500mg", "ab", "ab"]
    assert one(spark, text.query_surface(F.col("v")), v="Tab. Crocin 650 mg") == "crocin"
    assert one(spark, text.query_surface(F.col("v")), v="tab 5 mg") == "tab 5 mg"
    assert one(spark, text.normalize_date(F.col("v")), v="3/4.21") == "03-04-2021"
    assert one(spark, text.normalize_date(F.col("v")), v="") is None
    assert one(spark, text.comparison_text(F.col("v")), v="```json\nA `b` 1/2/2020```") == "a b 1-2-2020"
    assert one(spark, text.expand_abbreviations(F.col("v")), v="Tab BD  e/d all. conj.. htn..") == "tablet twice daily eye drops allergic conjunctivitis. hypertension."
    assert one(spark, text.repair_json(F.col("v")), v='ok ```json\n{"a": [1,2,],}\n``` end') == '{"a": [1,2]}'


def test_parsing(spark):
    assert one(spark, parsing.brand_family(F.col("v")), v="Augmentin Duo 625 Tablet") == "augmentin duo"
    assert one(spark, parsing.brand_family(F.col("v")), v="500mg tab") == "500mg tab"
    assert one(spark, parsing.infer_form(F.col("v"), F.lit("strip of 10 tablets")), v="x") == "strip"
    parts = one(spark, parsing.composition(F.col("v")), v="Amoxycillin  (500mg) + Clavulanic Acid (125mg); Zinc")
    assert [(p["ingredient"], p["strength"]) for p in parts] == [("amoxycillin", "500mg"), ("clavulanic acid", "125mg"), ("zinc", "")]
    signed = parsing.formulation_signature(parsing.composition(F.col("v")), F.lit("tablet"))
    assert one(spark, signed, v="Zinc + Amoxycillin (500 mg)") == "amoxycillin:500mg|zinc:|form:tablet"
    assert one(spark, parsing.strength(F.col("v")), v="x 2.50 units 3mg") == "2.5unit" and one(spark, parsing.strength(F.col("v")), v="100 mg") == "100mg"
    assert one(spark, parsing.dosage_form(F.col("v")), v="syp or tab") == "syrup" and one(spark, parsing.release_modifier(F.col("v")), v="x XR") == "ER"
    seen = one(spark, parsing.observed_formulation(F.col("v"), F.lit(""), F.lit("cap")), v="A 5mg + B 10mg SR")
    assert (seen["strength"], seen["form"], seen["release_modifier"], seen["combination"], seen["component_count"]) == ("5mg", "capsule", "SR", True, 2)


def test_similarity():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert similarity.common_length(a, b) == t[-1][-1]
        assert 0 <= similarity.weighted_of(a, b) <= 100.0 and similarity.weighted_of(a, b) == similarity.weighted_of(b, a)
    assert similarity.ratio_of("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert similarity.partial_of("abc", "xxabcxx") == 100 and similarity.weighted_of("new york mets", "mets new york") == 95
    assert similarity.word_distance_of("a b c".split(), "a x c d".split()) == 2


def test_similarity_columns(spark):
    df = spark.createDataFrame([("abc", "abd"), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(similarity.ratio(F.col("a"), F.col("b")).alias("r"), similarity.partial_ratio(F.col("a"), F.col("b")).alias("p"), similarity.block_ratio(F.col("a"), F.col("b")).alias("d"), similarity.character_error_rate(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["r"] == pytest.approx(200 * 2 / 6) and rows[1]["r"] is None and rows[2]["r"] == 100 and rows[0]["c"] == pytest.approx(1 / 3)


def test_partial_ratio_is_the_best_window(monkeypatch):
    """Against each window on its own, ends included."""
    monkeypatch.setattr(similarity, "FEW", 0)
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choice("abc de"[: r.randint(2, 6)]) for _ in range(r.randint(1, 25))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        want = max(similarity.ratio_of(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
        assert abs(similarity.partial_of(a, b) - want) < 1e-9, (a, b)
