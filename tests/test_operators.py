"""Operators on small tables with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import alignment, decision, evaluation, fusion, ordered, retrieval
from quillspark.sources import readers, writers
from quillspark.streaming import intake


def test_fusion_is_order_free(spark):
    rows = [("m", "R1", "c1", 0.9, 1), ("m", "R3", "c1", 0.5, 4), ("m", "R1", "c2", 0.8, 2)]
    for order in itertools.permutations(rows):
        got = fusion.reciprocal_rank(spark.createDataFrame(list(order), "mention_id string, branch string, candidate_id string, score double, rank int")).orderBy("final_rank").collect()
        assert [r["candidate_id"] for r in got] == ["c1", "c2"] and got[0]["rrf"] == pytest.approx(1 / 61 + 1 / 64)


def test_decision_scan(spark):
    rows = [("a", 1, "x", False, False), ("a", 2, "y", False, True), ("a", 3, "z", False, True), ("b", 1, "x", True, False), ("b", 2, "y", False, False), ("c", 1, "x", True, False)]
    got = {r["mention_id"]: (r["decision"], r["candidate_id"]) for r in decision.decide(spark.createDataFrame(rows, "mention_id string, final_rank int, candidate_id string, official boolean, acceptable boolean")).collect()}
    assert got == {"a": ("ACCEPT", "y"), "b": ("HUMAN_REVIEW", "y"), "c": ("NIL", None)}


@pytest.mark.parametrize(("seen", "known", "want"), [("10mg", "10mg", "MATCH"), ("", "10mg", "NOT_COMPARABLE"), ("10mg", "20mg", "CONFLICT"), ("x", None, "NOT_COMPARABLE"), (None, "x", "NOT_COMPARABLE")])
def test_tri_state(spark, seen, known, want):
    df = spark.createDataFrame([(seen, known)], "a string, b string")
    assert df.select(decision.tri_state(F.col("a"), F.col("b")).alias("x")).first()["x"] == want
    if known is not None:
        assert df.select(decision.tri_state_any(F.col("a"), F.array("b", F.lit(""))).alias("x")).first()["x"] == want


def test_hard_conflict_outweighs_matches(spark):
    row = ("EXACT_LOCAL_PRODUCT", "BRAND_PRODUCT", "MATCH", "MATCH", ["STRENGTH_CONFLICT"], [], ["X"])
    df = spark.createDataFrame([row], "resolution_level string, entity_type string, lexical_status string, semantic_status string, hard array<string>, missing array<string>, states array<string>")
    assert df.select(decision.acceptance().alias("x")).first()["x"] == "HARD_FORMULATION_CONFLICT"
    assert df.select(decision.review_reasons().alias("x")).first()["x"] == ["STRENGTH_CONFLICT"]


def test_retrieval_branches(spark):
    m = spark.createDataFrame([(1, "Tab. Crocin 650 mg"), (2, "crocin"), (3, "zz")], "mention_id long, text string")
    c = spark.createDataFrame([(10, "Crocin"), (11, "crocin advance"), (12, "roc")], "candidate_id long, name string")
    pairs = lambda df: sorted((r["mention_id"], r["candidate_id"]) for r in df.collect())
    assert pairs(retrieval.exact(m, c)) == [(1, 10), (2, 10)]
    assert pairs(retrieval.contained(m, c)) == [(1, 10), (1, 12), (2, 10), (2, 11), (2, 12)]
    assert pairs(retrieval.per_distinct_text(m.union(m), lambda t: retrieval.exact(t, c))) == [(1, 10), (1, 10), (2, 10), (2, 10)]


def test_crosswalk(spark):
    s = spark.createDataFrame([(1, "A", ["x"]), (2, "Beta", ["x"]), (3, "Q", ["Beta"]), (4, "Q", ["Beta", "x"])], "id int, name string, components array<string>")
    got = {r["id"]: r["target"] for r in retrieval.crosswalk(s, spark.createDataFrame([(1, 7)], "id int, target int"), spark.createDataFrame([("BETA", 9)], "target_name string, target int")).collect()}
    assert got == {1: 7, 2: 9, 3: 9, 4: None}


def test_assignment():
    r = np.random.default_rng(0)
    for _ in range(40):
        c = r.integers(0, 20, (r.integers(1, 5), r.integers(1, 5))).astype(float)
        pairs = alignment.assignment(c)
        n, m = c.shape
        options = (sum(c[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else (sum(c[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in pairs) == min(options) and len(pairs) == min(n, m)


def test_boxes(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 20.0, 0.0, 30.0, 10.0), (1, 100.0, 0.0, 110.0, 10.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    assert [(r["x0"], r["x1"]) for r in alignment.merge_boxes(b).orderBy("x0").collect()] == [(0.0, 30.0), (100.0, 110.0)]
    c = spark.createDataFrame([(1, p, 0.1 + p / 1000, 0.1, 0.2, 0.2) for p in range(5)] + [(1, 9, 0.8, 0.8, 0.9, 0.9)], "layout long, page long, x0 double, y0 double, x1 double, y1 double")
    assert [r["support"] for r in alignment.median_boxes(c).collect()] == [5]


def test_wilson_and_kappa(spark):
    df = spark.createDataFrame([(8, 10)], "h int, n int")
    low, high = df.select(*evaluation.wilson(F.col("h"), F.col("n"))).first()
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    k = evaluation.kappa(spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string"), "a", "b").first()
    assert round(k["kappa"], 4) == 0.4


def test_systematic_sample(spark):
    df = spark.range(0, 97).selectExpr("id * 3 as k")
    assert sorted(r["k"] for r in ordered.systematic(df, "k", 10).select("k").collect()) == [3 * (i * 97 // 10) for i in range(10)]


def test_copies_and_segments(spark):
    df = spark.createDataFrame([(1, "s", True), (2, "s", False), (3, "s", True), (4, "s", False), (5, "t", True)], "pos int, sig string, ref boolean")
    assert sorted(r["pos"] for r in ordered.copies(df, "sig", "pos", F.col("ref")).collect()) == [1, 2, 4, 5]
    lines = readers.lines(spark.createDataFrame([(1, "note\n1. a\nb\n2. c")], "doc int, text string"), "doc")
    assert [r["text"] for r in ordered.segments(lines, "doc", "line_no", F.col("line").rlike(r"^\d+\.?\s")).orderBy("record").collect()] == ["1. a b", "2. c"]


def test_sources_and_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([("1", None)], "x string, y string"), spark.createDataFrame([("2", "z")], "x string, w string")
    writers.csv([a, b], str(tmp_path / "t"))
    assert sorted(tuple(r) for r in readers.strings(spark, str(tmp_path / "t")).select("x", "y", "w").collect()) == [("1", "", ""), ("2", "", "z")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/ok.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "d/bad.json").write_text('{"a": ')
    rows = readers.json_documents(spark, str(tmp_path / "d"), "a int, _corrupt_record string").collect()
    assert sorted(r["a"] or 0 for r in rows) == [0, 1, 2] and sum(r["_corrupt_record"] is not None for r in rows) == 1
    (tmp_path / "e").write_text('{"head": "a", "relation": "r", "tail": "b"}\n{"head": "b", "relation": "r", "tail": "c"}\n')
    nodes, edges = readers.triples(spark, str(tmp_path / "e"))
    assert nodes.count() == 3 and edges.count() == 2
    (tmp_path / "f/sub").mkdir(parents=True)
    for name in ("one.png", "sub/p2.png", "sub/p1.png"):
        (tmp_path / "f" / name).write_bytes(b"x")
    got = {r["document"]: len(r["pages"]) for r in readers.documents(spark, str(tmp_path / "f")).collect()}
    assert got == {"one": 1, "sub": 2}
    before = writers.fingerprint(b).first()
    assert before == writers.fingerprint(b.union(b.limit(0))).first() and before != writers.fingerprint(b.union(b)).first()


def test_html_and_medications(spark):
    page = spark.createDataFrame([(1, '<table><tr><th>a</th></tr><tr><td>x <b>y</b></td><td><a href="/f.pdf">F</a></td></tr></table>')], "id int, html string")
    rows = readers.table_rows(page, "id", least=2).collect()
    assert rows[0]["cells"] == ["x y", "F"] and rows[0]["target"] == "/f.pdf" and readers.links(page, "id").first()["label"] == "F"
    doc = '{"raw_entities": {"medications": [{"raw_medication_text": "A"}], "prescription": [{"name": "B"}], "clinical_notes": {"medications": [{"medicine": "C"}]}}, "reference_annotations": [{"raw_entities": {"medications": [{"medicine_name": "A"}]}}]}'
    found = readers.medications(spark.createDataFrame([(1, doc)], "id int, json string"), "id", "json")
    assert sorted((r["name"], r["is_reference"]) for r in found.collect()) == [("A", False), ("A", True), ("B", False), ("C", False)]


def test_cache_lookup(spark):
    req = spark.createDataFrame([("e", {"b": "2", "a": "1"}), ("e", {"a": "9"})], "endpoint string, parameters map<string,string>")
    key = req.select(readers.request_key(F.col("endpoint"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("k")).first()["k"]
    got = readers.cached(req, spark.createDataFrame([(key, "yes")], "key string, answer string")).collect()
    assert sorted(str(r["answer"]) for r in got) == ["None", "yes"]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    intake.run_available(intake.tumbling(stream, "ts", "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = intake.tumbling(events, "ts", "event_type", "value")
    last = events.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("window_start") + F.expr("interval 70 minutes") < F.lit(last))
    assert got.join(closed, ["window_start", "event_type", "n"], "left_semi").count() == closed.count() <= got.count()


def test_incremental_runs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    empty = spark.createDataFrame([], "id int, row_hash string")
    first = intake.changed(rows, empty, "id")
    assert first.count() == 2 and intake.changed(rows, first.select("id", "row_hash"), "id").count() == 0
    assert [r["id"] for r in intake.changed(spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string"), first.select("id", "row_hash"), "id").collect()] == [2]


def test_assembly(spark, tmp_path):
    from quillspark.operators import assembly

    wide = spark.createDataFrame([(2, "b", "late"), (1, "b", "early"), (3, "", "x"), (4, None, "y")], "seq int, k string, v string")
    parts = assembly.star(wide, "seq", {"k": (F.col("k"), ["v"])})
    assert [tuple(r) for r in parts["k"].collect()] == [("b", "early")] and parts["fact"].count() == 4
    pool = assembly.text_pool(spark.createDataFrame([(1, "a", ["b", " "], None)], "id int, x string, y array<string>, z string"), "id", ["x", "y", "z"])
    assert sorted(r["text"] for r in pool.collect()) == ["a", "b"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a").write_text("1")
    before = [tuple(r) for r in assembly.manifest(spark, str(tmp_path / "m")).collect()]
    (tmp_path / "m/a").write_text("2")
    (tmp_path / "m/b").write_text("3")
    after = assembly.manifest(spark, str(tmp_path / "m"))
    old = spark.createDataFrame(before, "path string, length long, sha256 string")
    assert sorted(r["change"] for r in assembly.changed_files(old, after).collect()) == ["added", "changed"]
    runs = assembly.engine_runs(spark.createDataFrame([(1, "ab")], "document long, body string"), {"up": str.upper, "bad": lambda t: 1 / 0}).collect()
    assert {(r["engine"], r["text"], r["error"]) for r in runs} == {("up", "AB", None), ("bad", None, "division by zero")}
    box = spark.createDataFrame([(50.0, 300.0)], "x0 double, y0 double").select(*assembly.fractions(["x0", "y0"], F.lit(100.0), F.lit(200.0))).first()
    assert tuple(box) == (0.5, 1.0)
    assert [r["path"] for r in assembly.missing_outputs(spark, ["a", "b"], spark.createDataFrame([("a",)], "path string")).collect()] == ["b"]


def test_fuzzy_blocks_are_whole(spark, monkeypatch):
    """Hot tokens, tokens behind the fourth, names that share several tokens, and mentions whose tokens no name has."""
    monkeypatch.setattr(retrieval, "BLOCK", 7, raising=False)
    names = [(i, f"hot brand{i:02}") for i in range(30)] + [(40, "one two three four rare"), (41, "hot brand00"), (42, "paracetamol"), (43, "x")]
    asks = [(1, "hot zz"), (2, "rare"), (3, "paracetmol"), (4, "hot brand00"), (5, "x!")]
    m, c = spark.createDataFrame(asks, "mention_id long, text string"), spark.createDataFrame(names, "candidate_id long, name string")
    got = retrieval.blocked_fuzzy(m, c, F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 9), 0.0).collect()
    hot = {*range(30), 41}
    assert sorted((x["mention_id"], x["candidate_id"]) for x in got) == sorted([(1, i) for i in hot] + [(2, 40), (3, 42), (5, 43)] + [(4, i) for i in hot])
