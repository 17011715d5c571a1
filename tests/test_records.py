"""Records of JSON documents, and the operators around retrieval, sinks and evaluation that no SQL speaks for."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import similarity, text
from quillspark.operators import assembly, decision, evaluation, fusion, records, retrieval
from quillspark.sources import writers


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "id long, body string")


def test_mentions_of_all_shapes(spark):
    df = docs(spark, [{"raw_medication_text": "a", "mention_id": "m1"}, {"medicine": "b"}, {"x": 1}], {"document_uid": "D", "mentions": [{"medicine_name": "c", "raw_strength_text": "5 mg"}]}, {"raw_entities": {"medications": [{"raw_medication_text": ""}, {"raw_medication_text": "d"}]}}, {"raw_medication_text": "e"}, {"nothing": 1}, "broken", None)
    rows = sorted(records.mentions(df, "id", "body").collect())
    assert [(r["id"], r["position"], r["text"], r["strength"]) for r in rows] == [(0, 0, "a", ""), (0, 1, "b", ""), (1, 0, "c", "5 mg"), (2, 1, "d", ""), (3, 0, "e", "")]
    assert rows[0]["mention_id"] == "m1" and rows[2]["document_uid"] == "D" and rows[1]["mention_id"].startswith("MENTION_")


def test_documents_pages_mentions(spark):
    df = docs(spark, {"document_metadata": {"document_id": "x1", "total_pages": "3", "language": ["EN", " hi"], "source_type": "opd"}}, {"document_metadata": {"total_pages": "many"}}, None)
    got = records.document_records(df, "id", "body", F.lit("2020-01-01")).orderBy("id").collect()
    assert [(r["source_document_id"], r["total_pages"], r["language"], r["source_type"]) for r in got] == [("x1", 3, ["en", "hi"], "opd"), ("1", None, [], None), ("2", None, [], None)]
    pages = spark.createDataFrame([("d", None, "", "raw", "VERIFIED_VISUAL_HIGH"), ("d", "2", "anon", "raw", "UNKNOWN"), ("d", "x", None, None, None)], "doc string, page string, a string, b string, status string")
    got = records.page_records(pages, "doc", F.col("page"), ["a", "b"], "status").collect()
    assert [(r["page_number"], r["image"], r["eligible"]) for r in got] == [(1, "raw", True), (2, "anon", False), (None, None, False)] and len({r["page_uid"] for r in got}) == 3
    found = spark.createDataFrame([("d", "$.a", 0, '{"name": "Crocin", "dose": null, "strength": "5"}'), ("d", "$.a", 1, '{"dose": "x"}')], "doc string, place string, position int, item string")
    got = records.mention_records(found, "doc", "place", "position", "item", {"text": ["raw", "name"], "strength": ["dose", "strength"]}).collect()
    assert [(r["text"], r["strength"], r["surface"]) for r in got] == [("Crocin", None, "crocin")]


def test_context(spark):
    df = docs(spark, {"raw_entities": {"complaints_or_diagnosis": "fever", "diagnosis": [], "clinical_impression": ["x", "y"], "medications": [1], "custom": 2}}, {"reference_annotations": [{"raw_entities": {"advice": ["rest"]}}]}, {"raw_entities": 5}, None)
    rows = records.context(df, "id", "body").orderBy("id").collect()
    assert (rows[0]["chief_complaints"], rows[0]["diagnoses"], rows[0]["procedures"], rows[0]["other_context"]) == (["fever"], ["x", "y"], [], ["custom"])
    assert rows[1]["advice"] == ["rest"] and all(not rows[2][c] for c in records.CONTEXT) and len(rows) == 4


def test_entities_are_pruned(spark):
    df = docs(spark, {"advice": [{"raw_text": "rest", "page_number": 2}, {"raw_text": "null", "evidence_text": "sleep"}, {"raw_text": " ", "evidence_text": "None"}, "walk", ""]}, "{", None)
    rows = records.entities(df, "id", "body").orderBy("position").collect()
    assert [(r["list"], r["text"], r["evidence"], r["page"], r["warning"]) for r in rows] == [("advice", "rest", "rest", 2, None), ("advice", "sleep", "sleep", 1, "populated"), ("advice", None, "None", 1, "pruned"), ("advice", "walk", "walk", 1, "converted")]


def test_truths_and_predictions(spark):
    df = docs(spark, {"raw_entities": {"medications": [{"raw_name": "Tab X PO", "raw_route": "PO", "raw_dosage_text": "5 mg", "raw_timing": "am"}, "plain line", {"raw_line_text": "given", "raw_name": "Y"}]}})
    rows = records.ground_truth_medications(df, "id", "body").orderBy("position").collect()
    assert [(r["line"], r["name"], r["route"]) for r in rows] == [("Tab X PO 5 mg am", "Tab X PO", "PO"), ("plain line", "plain line", None), ("given", "Y", None)]
    df = docs(spark, {"items": [{"category": "advice", "raw_text": "rest"}, {"name": " Z ", "dosage": " 5 ", "instructions": "am"}, {"category": "other", "medicine_name": "Q", "raw_text": "Q 5"}]})
    rows = records.predictions(df, "id", "body").orderBy("position").collect()
    assert [(r["category"], r["text"], r["evidence"], r["dosage"], r["instruction"]) for r in rows] == [("advice", "rest", "rest", None, None), ("medication", "Z", "Z", "5", "am"), ("medication", "Q 5", "Q 5", None, None)]
    df = docs(spark, {"observations": ["o", " "], "medications": [{"a": 1}], "follow_up": "later"}, {"follow_up": {"date": "x"}}, None)
    assert [(r["id"], r["text"]) for r in sorted(records.raw_texts(df, "id", "body").collect())] == [(0, "o"), (0, '{"a":1}'), (0, "later"), (1, '{"date":"x"}')]
    kinds = spark.createDataFrame([(" OPD_Prescription",), ("other",), (None,)], "t string").select(records.source_type(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in kinds] == ["prescription", "other", None]


def test_misspelt_name_and_equal_ids(spark):
    names = spark.createDataFrame([(1, "paracetamol"), (2, "ibuprofen"), (3, "plaster of paris")], "candidate_id long, name string")
    asked = spark.createDataFrame([(1, "paracetmol"), (2, "")], "mention_id long, text string")
    got = retrieval.blocked_fuzzy(asked, names, similarity.weighted_ratio(F.col("a"), F.col("b")), 82, ascii_only=True).collect()
    assert [(r["mention_id"], r["candidate_id"]) for r in got] == [(1, 1)] and got[0]["score"] > 95
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "candidate_id long, vector array<double>")
    got = retrieval.dense(vectors.withColumnRenamed("candidate_id", "mention_id"), vectors, 1).collect()
    assert sorted((r["mention_id"], r["candidate_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 2, 1.0)]


@pytest.mark.parametrize("small", [True, False])
def test_containment_against_all_pairs(spark, monkeypatch, small):
    import random

    if not small:  # the way without broadcasts
        monkeypatch.setattr(retrieval, "is_small", lambda df: False)
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["a", "ab", "abc"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = [line(r.randint(1, 9)) for _ in range(150)] + ["", "a", "w1 w"]
    asked = [line(r.randint(1, 5)) for _ in range(60)] + ["", "b", "1 w2", *names[:5], "A  B"]
    m = spark.createDataFrame(list(enumerate(asked)), "mention_id long, text string")
    c = spark.createDataFrame(list(enumerate(names)), "candidate_id long, name string")
    norm = lambda t: " ".join(t.lower().split())
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(names) if norm(a) and norm(b) and (norm(a) in norm(b) or norm(b) in norm(a))}
    assert {(x["mention_id"], x["candidate_id"]) for x in retrieval.contained(m, c, ascii_only=True).collect()} == want
    assert retrieval.contained(m.limit(0), c, ascii_only=True).count() == 0 and retrieval.contained(m, c.limit(0), ascii_only=True).count() == 0


def test_ranks_of_all_hits(spark):
    """A popular mention over many ranges: the same order as one window gives."""
    rows = [(1, i * 7 % 500, float(i % 3)) for i in range(500)] + [(2, i, 1.0) for i in range(20)] + [(3, 5, 0.5)]
    hits = spark.createDataFrame(rows, "mention_id long, candidate_id long, score double")
    key = lambda df: sorted((r["mention_id"], r["rank"], r["candidate_id"], r["score"]) for r in df.collect())
    got = key(retrieval.ranked_all(hits, "x"))
    assert got == key(retrieval.ranked(hits, "x", 1000)) and [r[1] for r in got if r[0] == 1] == list(range(1, 501))
    assert retrieval.ranked_all(hits.limit(0), "x").count() == 0


def test_index_serves_until_the_catalog_changes(spark, tmp_path):
    c = spark.createDataFrame([(1, "red iron rod"), (2, "red box"), (3, "blue box box")], "candidate_id long, name string")
    m = spark.createDataFrame([(7, "red box"), (8, "box blue")], "mention_id long, text string")
    rows = lambda df: sorted((r["mention_id"], r["candidate_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    want = rows(retrieval.bm25(m, c))
    made = retrieval.index(c, str(tmp_path))
    assert rows(retrieval.bm25(m, c, indexed=made)) == want and rows(retrieval.bm25(m, c, indexed=retrieval.index(c, str(tmp_path)))) == want
    assert len(list(tmp_path.iterdir())) == 1
    retrieval.index(c.where("candidate_id < 3"), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_text_once_for_equal_texts(spark):
    m = spark.createDataFrame([(1, "red box"), (2, "red box"), (3, None)], "mention_id long, text string")
    c = spark.createDataFrame([(5, "Red  Box")], "candidate_id long, name string")
    assert sorted(r["mention_id"] for r in retrieval.per_distinct_text(m, lambda t: retrieval.exact(t, c)).collect()) == [1, 2]


def test_white_space_of_all_scripts(spark):
    df = spark.createDataFrame([("a\x1cb",), ("a\x85b",), (" A　\xa0b\t",)], "t string")
    assert [r["x"] for r in df.select(text.normalize_text(F.col("t")).alias("x")).collect()] == ["a b"] * 3
    df = spark.createDataFrame([("1 tab OD", "x", 1)], "raw_dosage string, other string, raw_n int")
    assert text.normalized_fields(df).first().asDict() == {"raw_dosage": "1 tab OD", "other": "x", "raw_n": 1, "normalized_dosage": "1 tablet once daily"}
    items = spark.range(1).select(text.normalized_items(F.array(F.struct(F.lit("od").alias("raw_f"), F.lit("k").alias("id"))), ["raw_f", "id"]).alias("x")).first()["x"]
    assert [i.asDict() for i in items] == [{"raw_f": "od", "id": "k", "normalized_f": "once daily"}]


def test_latest_row_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 2), (3, "d", 1)], "id long, v string, seq int")
    assert sorted(map(tuple, fusion.upsert(old, new, "id", "seq").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b_c"), (2, None)], "id long, v string")
    writers.tables(spark, {"quill_test": df}, {"quill_view": "select count(*) as n from quill_test"})
    assert spark.table("quill_view").first()["n"] == 2
    spark.sql("drop table quill_test")
    assert writers.markdown(df).splitlines() == ["| id | v |", "| --- | --- |", "| 1 | a\\|b_c |", "| 2 |  |"]
    assert r"1 & a|b\_c \\" in writers.latex(df, "50 %") and r"50 \%" in writers.latex(df, "50 %")
    assert writers.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 5}, "d": {"e": 1}}


def test_assembly_of_records(spark):
    df = spark.createDataFrame([(1, "a+b;c"), (2, ""), (3, None)], "document long, text string")
    split = F.filter(F.split("text", ";"), lambda x: x != "")
    found, parts, failed = assembly.records_and_failures(df, split, lambda r: F.split(r, r"\+"))
    assert [tuple(r) for r in sorted(parts.collect())] == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")] and found.count() == 2 and sorted(r["document"] for r in failed.collect()) == [2, 3]
    maps = spark.createDataFrame([(i, f"t{i}", "EXACT" if i % 2 else "NO_MATCH", i) for i in range(10)], "id long, target string, status string, position int")
    classes = spark.createDataFrame([("t1", "A"), ("t3", "B"), ("t3", "C"), ("t9", "D")], "target string, class_id string")
    assert sorted(r["class_id"] for r in assembly.class_crosswalk(maps, classes, ["EXACT"], 3).collect()) == ["A", "B", "C"]
    wide = spark.createDataFrame([(1, "x", None, " "), (2, "y", "z", "w")], "id long, a string, b string, c string")
    assert [r["name"] for r in assembly.search_documents(wide, "id", ["a", "b", "c"]).orderBy("candidate_id").collect()] == ["x", "y z w"]
    assert spark.range(1).select(assembly.harmonized(F.array(F.lit("HTN "), F.lit("x")), {"htn": "hypertension"}).alias("t")).first()["t"] == ["hypertension", "x"]


def test_scores(spark):
    df = spark.createDataFrame([("a b c", "a x c d e f g"), ("", ""), ("", "x"), ("a b", "a b")], "t string, f string")
    assert [round(r["x"], 6) for r in df.select(similarity.word_error_rate(F.col("t"), F.col("f")).alias("x")).collect()] == [1.0, 0.0, 1.0, 0.0]
    pairs = spark.createDataFrame([(1, {"a": "same", "b": "lost", "c": ""}, {"a": " SAME", "b": "xyz", "d": "only"})], "document long, found map<string,string>, truth map<string,string>")
    row = evaluation.field_counts(pairs, lambda p, t: F.when(p == t, 1.0).otherwise(0.0)).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 2)
    assert spark.range(1).select(evaluation.mask_routing(F.lit(0.5)).alias("x")).first()["x"] == "NEEDS_REVIEW"
    ranked = spark.createDataFrame([(1, r, f"c{r}") for r in range(7, 0, -1)], "mention_id long, final_rank int, candidate_id string")
    assert decision.top_candidates(ranked, ["candidate_id"], 2).first()["candidates"] == '[{"candidate_id":"c1"},{"candidate_id":"c2"}]'


def test_small_assemblies(spark, tmp_path):
    from quillspark.operators import ordered
    from quillspark.sources import readers

    registry = assembly.source_registry(spark, [("a", "first"), ("b", "second")], "source_id string, title string", spark.createDataFrame([("a", "00")], "source_id string, sha256 string"))
    assert sorted(map(tuple, registry.collect())) == [("a", "first", "00"), ("b", "second", None)]
    wide = spark.createDataFrame([("n1", "f1", 1), ("n1", "f1", 2), (" ", "f2", 3)], "name string, family string, id long")
    made = assembly.index_tables(wide, {"brand": ["name", "family"], "family": ["family"]})
    assert made["brand"].count() == 2 and sorted(map(tuple, made["names"].collect())) == [("brand", "n1"), ("family", "f1"), ("family", "f2")]
    nested = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.struct(F.lit("v").alias("y")).alias("z")).alias("a"), F.array(F.lit(1), F.lit(2)).alias("l"), F.lit(5).alias("n"))
    assert assembly.flattened(nested).first().asDict() == {"a_x": 1, "a_z_y": "v", "l": "[1,2]", "n": 5}
    tasks, states = spark.createDataFrame([(1,), (2,)], "task_id long"), spark.createDataFrame([(1, "RUNNING", 1), (1, "DONE", 2)], "task_id long, status string, time int")
    assert sorted(map(tuple, assembly.queue_status(tasks, states).collect())) == [(1, "DONE"), (2, "PENDING")]
    assert [r["id"] for r in ordered.first_rows(wide, "id", 2).collect()] == [1, 2]
    wide.write.mode("overwrite").saveAsTable("quill_saved")
    assert [r["id"] for r in readers.saved(spark, "quill_saved", ["id"], "family = 'f2'").collect()] == [3]
    spark.sql("drop table quill_saved")
    kinds = spark.createDataFrame([("BRAND_FAMILY", "x", "y"), ("INGREDIENT", "x", None), ("BRAND_PRODUCT", "x", "y")], "t string, i string, f string")
    assert [r["v"] for r in kinds.select(decision.family_of(F.col("t"), F.col("i"), F.col("f")).alias("v")).collect()] == ["x", "", "y"]


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r["v"] for r in df.select(similarity.mean_pool(F.col("s"), F.col("m")).alias("v")).collect()] == [[2.0, 3.0], None]
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "candidate_id long, vector array<float>")
    got = retrieval.dense(vectors.where("candidate_id = 1").withColumnRenamed("candidate_id", "mention_id"), vectors, 3, cosine=True).collect()
    assert [(r["candidate_id"], round(r["score"], 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, 0.6), (3, 0.0)]


def test_links_and_cells(spark):
    from quillspark.sources import readers

    pages = spark.createDataFrame([(1, "http://h.org/a/b.html?q#f", """<a href='c'>x</a><A class=k HREF=/d>y</A><a href="//o.org/e">z</a><a href="mailto:m">w</a><a href="?p=2">v</a><a href="#t"><b>u</b></a>"""), (2, "http://h.org", '<a href="c">x</a>')], "id long, url string, html string")
    rows = readers.links(pages, "id").join(pages.select("id", "url"), "id").select("id", "position", readers.absolute(F.col("url"), F.col("target")).alias("t"), "label")
    assert [(r["t"], r["label"]) for r in sorted(rows.collect())] == [("http://h.org/a/c", "x"), ("http://h.org/d", "y"), ("http://o.org/e", "z"), ("mailto:m", "w"), ("http://h.org/a/b.html?p=2", "v"), ("http://h.org/a/b.html?q#t", "u"), ("http://h.org/c", "x")]
    trace = spark.createDataFrame([(1, "B", 5, 2, 1.0, "x", "e2|e1", 3.0), (1, "B", 5, 1, 0.5, "y", "e1||e3", 9.0)], "mention_id long, branch string, candidate_id long, rank int, score double, alias string, evidence string, latency double")
    row = fusion.collapse(trace, cells=("evidence",)).first()
    assert (row["rank"], row["score"], row["aliases"], row["hits"], row["evidence"]) == (1, 0.5, "x || y", 2, "e1|e2|e3")
    fused = fusion.reciprocal_rank(trace.limit(1)).first()
    assert fused["components"] == {"B": 1 / 62} and fused["rrf"] == 1 / 62
    calls = spark.createDataFrame([(1, "B", 1, "SUCCESS", 3, 5.0), (1, "B", 2, "FAILED", 0, 1.0), (2, "B", 1, "EMPTY", 0, 7.0)], "mention_id long, branch string, seq int, status string, candidates int, latency double")
    row = fusion.branch_status(calls).first()
    assert (row["success"], row["empty"], row["median_candidates"], row["median_latency"]) == (1, 1, 3.0, 6.0)
    names = spark.createDataFrame([("Kumar Nagar", "", 80.0), ("X", "Y", 0.0), ("X", None, 10.0)], "f string, t string, s double")
    got = names.select(decision.name_hallucinated(F.col("f"), F.col("t")).alias("h"), decision.name_rationale(F.col("s")).alias("r")).collect()
    assert [r["h"] for r in got] == [True, False, True] and got[0]["r"] != got[2]["r"]


def test_families_strengths_and_numbered_records(spark):
    from quillspark.functions import parsing
    from quillspark.operators import ordered

    names = spark.createDataFrame([("Dolo 650 Tab",), ("Crocin  Advance Tablet",), ("tablet",), ("Zed",)], "n string")
    assert [tuple(r) for r in names.select(parsing.brand_family_display(F.col("n"), True), parsing.brand_family(F.col("n"), True)).collect()] == [("Dolo", "dolo"), ("Crocin Advance", "crocin advance"), ("tablet", "tablet"), ("Zed", "zed")]
    text = spark.createDataFrame([("Tablets 500 mg and 125 mg/5 ml oral SOLUTION 2%",)], "t string")
    assert tuple(text.select(parsing.listed_strengths(F.col("t")), parsing.listed_forms(F.col("t"))).first()) == ("500 mg | 125 mg/5 ml", "tablet | solution | oral")
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["head", "1. Amox  500", "mg caps", "", "Note: skip", "2 Paracet", "paracetamol line", "3. ", "12/3 no number"])], "doc long, n int, line string")
    assert [(r["number"], r["text"]) for r in ordered.numbered_records(lines, "doc", "n").orderBy("record").collect()] == [("1", "Amox 500 mg caps"), ("2", "Paracet 3. 12/3 no number")]


def test_written_tables_go_when_a_job_is_done(spark):
    """And a broadcast is checked by rows and by bytes."""
    import os

    from quillspark import tables

    df = tables.written(spark.createDataFrame([(i, "x" * 100) for i in range(50)], "id long, t string"), "some")
    path = df.inputFiles()[0].removeprefix("file:")
    assert tables.is_small(df, 50) and not tables.is_small(df, 49) and not tables.is_small(df, 50, 1000) and df.count() == 50
    assert tables.clear(spark) >= 1 and not os.path.exists(path) and tables.clear(spark) == 0


def test_joins_of_stated_cardinality(spark):
    one, two = spark.createDataFrame([(1, "a")], "id long, x string"), spark.createDataFrame([(1, "b"), (1, "c")], "id long, y string")
    assert fusion.joined(one, two, "id", one_right=False).count() == 2
    with pytest.raises(ValueError, match="right"):
        fusion.joined(one, two, "id")
