"""Every registered query of the library runs, and agrees with its SQL on a second engine."""

import random

import duckdb
import pandas as pd
import pytest

from quillspark.functions.similarity import partial_of, ratio_of
from quillspark.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df):
    """Rows of a frame as sorted tuples of comparable values."""

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, pd.Timestamp):
            return str(v)
        return f"{float(v):.6f}" if not isinstance(v, str) else v

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        want = db.execute(ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with tables of the given rows."""

    def write(**tables):
        path = str(tmp_path_factory.mktemp("sf"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return path

    return write


def test_containment_asks_with_whole_passages(spark, small):
    opening, rest = "an opening that many texts share word for word and then some more", "the tail of it only this passage has"
    docs = [(1, "the tail of it"), (2, f"{opening} the tail"), (3, f"{opening} another end"), (4, f"x {opening} {rest} y"), (5, opening[:30])]
    sf = small(benchmark=([(0, f"{opening} {rest}")], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    assert sorted(r["candidate_id"] for r in QUERIES["containment_join"](spark, sf).collect()) == [1, 2, 4, 5]


def test_alignment_takes_whole_texts(spark, small):
    """Against plain code: more than 12 pieces a text, which differ only behind their first 60 characters."""
    r = random.Random(8)
    opening = "the same sixty characters and more stand at the start of each piece "
    piece = lambda: opening + "".join(r.choice("abcdefgh ") for _ in range(60)).strip()
    truth = {1: [piece() for _ in range(13)], 2: ["b", "a"]}
    found = {1: [t[:-3] + "xyz" for t in reversed(truth[1])] + [piece()], 2: ["a"]}
    talk = [(k, turn, ". ".join(t)) for turn, side in enumerate((truth, found)) for k, t in side.items()]
    sf = small(conversations=(talk + [(1, 2, "later. turns")], "conv_id long, turn long, text string"))
    rows = lambda name: {(x["doc"], x["truth"], x["found"]): x["score"] for x in QUERIES[name](spark, sf).collect()}
    best, greedy, most = {}, {}, {}
    for k in truth:
        free = list(range(len(truth[k])))
        score = [[ratio_of(t, f) for f in found[k]] for t in truth[k]]
        for j, f in enumerate(found[k]):
            i = max(range(len(truth[k])), key=lambda i: (partial_of(f, truth[k][i]), -i))
            best[k, i, j] = partial_of(f, truth[k][i])
            i = max(free, key=lambda i: (score[i][j], -i), default=None)
            if i is not None and score[i][j] > 40:
                free.remove(i)
                greedy[k, i, j] = score[i][j]
        totals = {0: 0.0}  # of each set of truths that the findings so far can take
        for j in range(len(found[k])):
            for taken, total in list(totals.items()):
                for i in range(len(truth[k])):
                    if not taken >> i & 1:
                        totals[taken | 1 << i] = max(totals.get(taken | 1 << i, 0.0), total + score[i][j])
        most[k] = max(totals.values())
    for name, want in (("best_evidence", best), ("greedy_alignment", greedy)):
        assert rows(name) == {key: pytest.approx(v, abs=1e-6) for key, v in want.items()}, name
    optimal = rows("optimal_alignment")
    for k in truth:
        mine = {key[1:]: v for key, v in optimal.items() if key[0] == k}
        assert sorted(i for i, _ in mine if i is not None) == list(range(len(truth[k]))) and sorted(j for _, j in mine if j is not None) == list(range(len(found[k])))
        pairs = {(i, j): v for (i, j), v in mine.items() if v is not None}
        assert pairs == {(i, j): pytest.approx(ratio_of(truth[k][i], found[k][j]), abs=1e-6) for i, j in pairs}
        assert sum(pairs.values()) == pytest.approx(most[k], abs=1e-4)


def test_containment_keeps_every_pair(spark, small):
    docs = [(i, f"{i} the hot passage {i}") for i in range(100)]
    sf = small(benchmark=([(0, "The hot passage")], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    assert sorted(tuple(x) for x in QUERIES["containment_join"](spark, sf).collect()) == [(0, i, i + 1) for i in range(100)]
    assert {x["candidate_id"] for x in QUERIES["candidate_union"](spark, sf).collect()} == set(range(100))
    assert QUERIES["rrf_topk"](spark, sf).count() == 20


@pytest.fixture(scope="module")
def tied(small):
    """Lines of one order and number in several files, with part names that grow as the lines go back; null names, null and blank brands."""
    places = [7, 9, 2, 8, 0, 5, 3, 6, 1, 4]
    brands = ["Brand#1", "Brand#2", "", None, "Brand#1", "Brand#2", "", None, "Brand#1", "Brand#2"]
    parts = [(p, None if p == 9 else f"name {9 - places.index(p)}", brands[p], f"type {9 - places.index(p) // 2}", p % 2) for p in range(10)]
    lines = [(0, p, p % 3, 1) for p in places * 3] + [(0, 4, 0, 2), (None, 9, 0, 1), (1, 1, 1, 1)]
    suppliers = [(k, f"supplier {9 - k}", k % 2) for k in range(3)]
    return small(
        lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        part=(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int"),
    )


def in_turn(sf, sql):
    """The SQL's rows where one thread reads the tables from their first row to their last."""
    con = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet/*.parquet')")
    return con.execute(sql).fetchdf()


def test_star_dimension_takes_the_first_of_tied_lines(spark, tied):
    got = QUERIES["star_dimension"](spark, tied)
    assert {r["id"]: r["p_name"] for r in got.collect()} == {None: "name 9", "": "name 7", "Brand#1": "name 6", "Brand#2": "name 4"}
    assert rows(got.toPandas()) == rows(in_turn(tied, ORACLE_SQL["star_dimension"]))


def test_star_tables_take_the_first_of_tied_lines(spark, tied):
    got = QUERIES["star_tables"](spark, tied)
    first = {(r["dimension"], r["id"]): r["value"] for r in got.collect()}
    assert {k: v for k, v in first.items() if k[0] in ("brand", "size", "nation")} == {
        ("brand", None): "name 9", ("brand", ""): "name 7", ("brand", "Brand#1"): "name 6", ("brand", "Brand#2"): "name 4",
        ("size", "0"): "type 8", ("size", "1"): "type 9", ("nation", "0"): "supplier 9", ("nation", "1"): "supplier 8",
    }
    assert rows(got.toPandas()) == rows(in_turn(tied, ORACLE_SQL["star_tables"]))
