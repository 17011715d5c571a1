"""Nearest neighbours, URL filters, page text, quality trees and the pipeline."""

import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import additive_ann, html_text, pipeline, quality, queries, trees, url_filter


def check_search(df, condition, k=10, least=0.9):
    rows = df.where("vec_id is not null").collect()
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"]) and len(r["embedding"]) == 8 * (len(r["embedding"]) // 8)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    got = {}
    for r in additive_ann.nearest(df, condition).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in sorted({int(i) for i in ids if i % 100 == 0}):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[: min(k, int(np.isfinite(d).sum()))]
        found = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) == len(want)
        for r in found:
            assert r["score"] == pytest.approx(np.sqrt(((x[ids == r["vec_id"]][0] - x[ids == q][0]) ** 2).sum()), abs=1e-12)
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & set(ids[want].tolist()))
        total += len(want)
    assert hits >= least * total
    return got


def test_search_whole_table(spark):
    check_search(queries.table(spark, "/root/testdata/sf0.1", "embeddings"), F.col("vec_id") % 100 == 0)


def test_search_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(3).tolist()) for i in range(260)] + [(1000 + i, [1.0] * 8) for i in range(40)]
    rows += [(300, [1.0] * 8), (400, None), (500, [0.0] * 8), (600, [None] + [1.0] * 7), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (None, [1.0] * 8), (900, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit("clash")).withColumn("g", F.lit(1))
    got = check_search(df.where("vec_id is null or vec_id <> 900"), F.col("vec_id") % 100 == 0)
    assert [r["vec_id"] for r in got[300]] == list(range(1000, 1010)) and not {400, 500, 600, 700, 800} & set(got)
    assert 900 not in {r["query_id"] for r in additive_ann.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    assert additive_ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_beam_is_no_worse_than_greedy():
    """On vectors that the books weren't fitted on: on their own, books follow greedy codes down to nothing."""
    r = np.random.default_rng(0)
    books, x = additive_ann.fit(r.normal(size=(600, 16)), words=32), r.normal(size=(600, 16))
    loss = [((x - sum(books.books[m][codes[:, m]] for m in range(len(books.books)))) ** 2).sum() for codes, _ in (books.encode(x, 1), books.encode(x, 8))]
    assert loss[1] < loss[0]
    codes, norms = books.encode(x, 4)
    assert np.allclose(norms, (sum(books.books[m][codes[:, m]] for m in range(len(books.books))) ** 2).sum(1))


URLS = [
    (1, "http://Sub.Example.COM/en/x?u#v", "block", "example.com/en/"), (2, "https://www.example.com/en/", "allow", "www.example.com/en/"), (3, "http://a.net/es/", "block", "net/es/"),
    (4, "http://a.net/ES/", "allow", None), (5, "http://example.com", "allow", None), (6, "nothing", "allow", None), (7, None, "allow", None), (8, "", "allow", None),
    (9, "http://m.ads-track.example.org/x", "block", None), (10, "http://goads-track.example.org/", "allow", None), (11, "http://x.org/login", "block", None), (12, "http://x.org/login.html", "allow", None),
    (13, "http://x.org/track/a/b/click?x", "block", None), (14, "http://adult-education.org/login", "allow", None), (15, "x://y://example.com/en/", "allow", None), (16, "http://notexample.com/en/", "allow", "com/"),
    (17, "http://x.org/" + "a/" * 5000 + "cart/", "block", None), (None, "http://a.net/fr/", "block", "net/fr/"), (3, "http://a.net/es/", "block", "net/es/"),
]


def test_many_pattern_rules(spark):
    """Thousands of rules over generated urls, against every rule on every url; bars inside, anchors, no literal at all."""
    import random

    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ad", "promo", "shop", "news", "img", "cdn") for b in range(40)]
    urls = [f"http://{r.choice(words)}.{r.choice(words)}.org/{r.choice(words)}/{r.choice(words)}{r.choice(['', '?x|y', '.html', '/'])}" for _ in range(300)] + ["http://" + "a." * 3000 + "org/x", "http://x.org/q|r"]
    shapes = ["||{}.", "|http://{}.", "/{}^", "/{}/*/{}^", "{}.html|", ".{}.org^", "/{}?x|y|", "/{}|"]
    rules = [(r.choice(["block", "allow", "block"]), r.choice(shapes).replace("{}", r.choice(words), 1).replace("{}", r.choice(words))) for _ in range(3000)] + [("block", "q|r"), ("allow", "*promo1*|")]

    def expression(p):
        begin = "^[a-z][a-z0-9+.-]*://(?:[^/?#]*\\.)?" if p.startswith("||") else "^" if p.startswith("|") else ""
        end = r"\Z" if p.endswith("|") else ""
        body = p.lstrip("|") if begin else p
        return re.compile(begin + re.escape(body[:-1] if end else body).replace(r"\*", ".*").replace(r"\^", r"(?:[^a-z0-9_.%-]|\Z)") + end)

    compiled = [(v, expression(p)) for v, p in rules]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {row["page_id"]: row["verdict"] for row in url_filter.url_verdicts(df, spark.createDataFrame([("block", "none.example/")], "verdict string, rule string"), spark.createDataFrame(rules, "verdict string, pattern string")).collect()}
    want = {i: min([v for v, e in compiled if e.search(u)], default="allow") for i, u in enumerate(urls)}
    assert got == want and len(set(want.values())) == 2


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u, _, _ in URLS], "page_id long, url string").withColumn("token", F.lit("clash")).withColumn("host", F.lit("clash"))
    hosts, patterns = spark.createDataFrame(url_filter.HOST_RULES, "verdict string, rule string"), spark.createDataFrame(url_filter.PATTERN_RULES, "verdict string, pattern string")
    rows = url_filter.url_verdicts(df, hosts, patterns).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r["page_id"], r["verdict"], r["rule"]) for r in rows), key=key) == sorted(((i, v, rule) for i, _, v, rule in URLS), key=key)
    one = {r["page_id"]: r for r in rows}
    assert (one[1]["host"], one[1]["path"]) == ("sub.example.com", "/en/x") and (one[7]["host"], one[7]["path"]) == ("", "")
    assert url_filter.url_verdicts(df.limit(0), hosts, patterns).count() == 0
    plan = url_filter.url_verdicts(df, hosts, patterns)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_rules_without_tokens_and_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://a.org/q1"), (2, "http://b.org/zz-common-rare/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, rule string")
    rows = url_filter.url_verdicts(df, none, spark.createDataFrame([("block", "q*1|"), ("block", "-common-rare/")], "verdict string, pattern string")).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "block"}


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One\n two<br><p>Three&nbsp;four &lt;b&gt; &#233;</p><ul><li>a<li>b</ul><div class="share-buttons"><p>share</p></div></article><section id="comments"><p>me too</p></section><footer>&copy; x</footer></body></html>'


def brute_shared(pages):
    """For each page the lines that a plain longest common subsequence with its nearest neighbour finds, and their number."""
    host = lambda u: (re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "") or [None, "", ""])
    order = sorted((host(u)[1].lower(), host(u)[2], i) for i, (u, _) in enumerate(pages))
    lines = [[t for _, t in html_text.blocks(h or "")] for _, h in pages]
    out = {}
    for k, (name, path, i) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == name]
        same = lambda p: len(os.path.commonprefix([path, p]))  # noqa: E731, B023
        if not near:
            out[i] = 0
            continue
        a, b = lines[i], lines[max(near, key=lambda n: same(n[1]))[2]]
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        out[i] = row[-1]
    return out


def test_every_page_is_differenced(spark):
    """Pairing and alignment of whole tables against plain code; deletion follows them on pages without an article."""
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()
    found = html_text.extract(queries.table(spark, "/root/testdata/sf0.01", "pages"))
    want = brute_shared([(r["url"], r["html"]) for r in pages])
    assert {r["page_id"]: r["n_shared"] for r in found.collect()} == {r["page_id"]: want[i] for i, r in enumerate(pages)} and sum(want.values()) > 0
    # The same pages without their markup for articles: what neighbours share goes, and nothing else.
    bare = [(r["page_id"], r["url"], re.sub(r"</?article>|<nav>.*?</nav>|<footer>.*?</footer>|<div class=\"ad\">.*?</div>", "", r["html"])) for r in pages]
    rows = html_text.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()
    want = brute_shared([(u, h) for _, u, h in bare])
    regions = {i: [region for region, _ in html_text.blocks(h)] for i, _, h in bare}
    lines = {i: len(found) for i, found in regions.items() if set(found) == {html_text.OPEN}}
    assert {r["page_id"]: r["n_shared"] for r in rows} == {i: want[k] for k, (i, _, _) in enumerate(bare)} and any(r["n_shared"] for r in rows)
    rows = [r for r in rows if r["page_id"] in lines]
    assert any(r["n_shared"] for r in rows) and all(len(r["text"].split("\n\n")) == lines[r["page_id"]] - r["n_shared"] for r in rows if lines[r["page_id"]] > r["n_shared"])


def test_long_pages_align():
    """Tens of thousands of lines, many repeated: as long as a plain count says."""
    r = np.random.default_rng(4)
    a, b = r.integers(0, 400, 6000), r.integers(0, 400, 5000)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    at = html_text.common_lines(a, b)
    assert len(at) == row[-1] and (np.diff(at) > 0).all()
    assert len(html_text.common_lines(np.arange(40_000), np.arange(40_000)[::-1].copy())) == 1


def test_blocks():
    assert html_text.main_text(html_text.blocks(PAGE)) == "Head & line\n\nOne two\n\nThree four <b> é\n\na\n\nb"
    for page in ("", "text only", "<p>a<p>b", "<", "<p", "<a href='x>y'>z</a> <!-- open", "<script>never closed", "<P CLASS=ad>x</P>y", "</div></article>x"):
        html_text.blocks(page)
    assert html_text.main_text(html_text.blocks("<p>a<p>b")) == "a\n\nb"
    assert html_text.main_text(html_text.blocks("<P CLASS=ad>x</P>y")) == "y"


@pytest.mark.parametrize("seed", range(30))
def test_common_lines(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(1, 6, r.integers(0, 25)), r.integers(1, 6, r.integers(0, 25))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    at = html_text.common_lines(a, b)
    rest = iter(b.tolist())
    assert len(at) == table[-1, -1] and (np.diff(at) > 0).all() and all(x in rest for x in a[at].tolist())


def test_page_differencing(spark):
    """Pages without an article lose what the nearest page of their host shares; articles lose nothing."""
    open_ = lambda own: f"<body><p>Site title</p><p>{own}</p><p>All rights</p></body>"
    article = "<article><p>Quoted by both</p></article>"
    rows = [(1, "http://a.org/x/1", open_("first")), (2, "http://a.org/x/2", open_("second")), (3, "http://b.org/x/1", open_("alone")), (4, "http://c.org/1", article), (5, "http://c.org/2", article), (6, None, None), (None, "http://a.org/x/9", open_("ninth")), (4, "http://c.org/1", article), (7, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash")).withColumn("shared", F.lit("clash"))
    got = sorted(((r["page_id"] or -1, r["text"], r["n_chars"]) for r in html_text.extract(df).collect()))
    alone = "Site title\n\nalone\n\nAll rights"
    want = [(-1, "ninth"), (1, "first"), (2, "second"), (3, alone), (4, "Quoted by both"), (4, "Quoted by both"), (5, "Quoted by both"), (6, ""), (7, "")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_whole_table(spark, sf):
    rows = {r["page_id"]: r["text"] for r in html_text.extract(queries.table(spark, sf, "pages")).collect()}
    import html

    for r in queries.table(spark, sf, "pages").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"<p>|</p>|<h1>|</h1>", body.replace("<br>", " "))]
        assert rows[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def check_quality(df, labels):
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(df, labels).collect()}
    for doc_id, text in df.select("doc_id", "text").collect():
        got, want = rows[doc_id], plain_counts(text)
        assert tuple(got[c] for c in quality.COUNTS) == want, text
        assert got["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got["base_failed"] and got["kept"])
    return rows


def test_quality(spark, make, odd_texts):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    check_quality(make([*odd_texts, "a b c " * 30, "x\nx\n\nx # *\n"], extra=True), labels)
    good = " ".join(f"word{i}" for i in range(60))
    assert quality.quality_verdicts(make([good]), labels.limit(0)).first()["kept"]
    assert quality.quality_verdicts(make(["x"]).limit(0), labels).count() == 0


def test_quality_held_out(spark):
    """Trees fitted on half of the labels judge the other half."""
    sf = "/root/testdata/sf0.01"
    labels, docs = queries.table(spark, sf, "labels"), queries.table(spark, sf, "documents")
    rows = check_quality(docs, labels.where("doc_id % 2 = 0"))
    odd = [(r["quality"], rows[r["doc_id"]]) for r in labels.where("doc_id % 2 = 1").collect()]
    odd = [(q, r) for q, r in odd if not r["base_failed"]]
    assert np.mean([r["kept"] == bool(q) for q, r in odd]) > 0.97 and np.mean([r["kept"] for q, r in odd if q]) > 0.98


def test_trees_are_monotone():
    r = np.random.default_rng(3)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.2 * r.normal(size=3000)) > 0).astype(float)
    model = trees.fit(x, y, np.array([1, -1, 0]))
    for _ in range(200):
        p = np.repeat(r.random((1, 3)), 50, 0)
        for j, sign in ((0, 1), (1, -1)):
            q = p.copy()
            q[:, j] = np.linspace(0, 1, 50)
            assert (sign * np.diff(model.score(q)) >= -1e-12).all()
    assert (((model.score(x) > 0) == y).mean()) > 0.85


def test_pipeline(spark, sf):
    """Each stage on its own input: the operators' own verdicts, all pairs from 0.8 on, patterns, and the pieces."""
    docs = queries.table(spark, sf, "documents")
    kept = pipeline.quality(spark, docs, sf)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs, queries.table(spark, sf, "labels")).collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, k in verdict.items() if k}
    left = pipeline.near_dedup(spark, kept, sf)
    sets = {}
    for r in kept.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}
    root = lambda i: i if up[i] == i else root(up[i])
    for i, j in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            p, q = sorted((root(i), root(j)))
            up[q] = p
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted({root(i) for i in sets})
    clean = pipeline.secret_scan(spark, left, sf)
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (left, clean))
    assert set(before) == set(after) and not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|password=[0-9a-f]{8}", t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not re.search(r"(?i)AKIA|[0-9a-f]{32}|password|token|secret|api_?key|[A-Za-z0-9+/_=-]{20}", t))
    pieces = pipeline.packing(spark, clean, sf).collect()
    held = {}
    for r in pieces:
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(held) == set(after)
    for parts in held.values():
        assert [s for s, _, _ in sorted(parts)] == [sum(n for _, n, _ in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
    twice = pipeline.near_dedup(spark, kept.union(kept), sf)
    assert twice.count() == left.count()
