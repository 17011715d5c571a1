"""Near-duplicates against all pairs, components, shingles."""

import itertools
import math
import random

import numpy as np
import pytest

from quillspark.llm import common, components, kernels, near_dedup, queries


def plain(texts):
    """Shingle count and component (smallest id) by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def check(df):
    rows = sorted(df.select("doc_id", "text").where("doc_id is not null").collect())
    want = plain([r[1] for r in rows])
    ids = [r[0] for r in rows]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    for doc_id, (n, root) in zip(ids, want, strict=True):
        assert (got[doc_id]["n_shingles"], got[doc_id]["component_id"], got[doc_id]["kept"]) == (n, ids[root], ids[root] == doc_id), doc_id
    return got


def family(r, words, n, edits):
    """A text and copies that differ in some words each."""
    base = [r.choice(words) for _ in range(150)]
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(len(copy))] = r.choice(words)
        yield " ".join(copy)


def test_all_pairs(make, odd_texts):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [t for edits in (1, 2, 3, 5, 8) for t in family(r, words, 30, edits)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(60)]
    texts += ["Same Words here Now ok", "same words HERE now ok", "two words", "words two", "chain " * 30]
    check(make([*odd_texts, *texts], extra=True))


def test_whole_table(spark, sf):
    check(queries.table(spark, sf, "documents"))


def test_blocks(make, monkeypatch):
    """Long posting lists and clusters, cut into blocks, lose no link."""
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4)
    r = random.Random(4)
    check(make([t for edits in (2, 6) for t in family(r, [f"w{i}" for i in range(300)], 40, edits)]))


def test_null_and_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, a), (3, a), (3, a), (3, "other text of five words"), (7, a + " w"), (9, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert rows == [(-1, 3, False), (3, 3, True), (3, 3, True), (3, 3, True), (7, 3, False), (9, 9, True)]


def test_empty(make):
    assert near_dedup.near_duplicates(make(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    key = lambda i: i.to_bytes(4, "big")
    df = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(n, "big"): int.from_bytes(x, "big") for n, x in components.components(df).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_words_and_shingles(odd_texts):
    import pyarrow as pa

    texts = [t for t in odd_texts if isinstance(t, str) or t is None] + ["A b", "a" * (3 << 20) + " b", "x " * (2 << 20)]
    seen = {}
    for lower in (False, True):
        for t, h in zip(texts, kernels.doc_words(pa.array(texts, pa.string()), lower), strict=True):
            w = (t or "").encode()
            w = w.lower().split() if lower else w.split()
            assert len(w) == len(h)
            for x, y in zip(w, h.tolist(), strict=True):
                assert seen.setdefault((x, len(x) > 1 << 20), y) == y
    assert len(set(seen.values())) == len(seen)
    assert len(kernels.shingles(np.arange(3, dtype=np.uint64))) == 1 and not len(kernels.shingles(np.zeros(0, np.uint64)))


@pytest.mark.parametrize("percent", [85, 80, 95, 50])
def test_layout(percent):
    """Fewer matches than asked for have a probability of 1e-9 at most, and so has sharing no post if matches don't rule it out."""
    need, p = near_dedup.Layout.of(percent), percent / 100
    below = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(need.matches))
    assert below <= 1e-9 and (need.matches + need.posted == 129 or (1 - p) ** need.posted <= 1e-9)
    assert near_dedup.Layout.of(85).posted == 11 and near_dedup.Layout.of(80).posted == 13
    assert need.prefix_matches == max(0, need.matches - 64)


def test_hot_keys_are_split(spark, monkeypatch):
    """A link target, a cluster and an exact group of many rows, each cut into parts."""
    monkeypatch.setattr(common, "PART_ROWS", 5)
    r = random.Random(9)
    texts = [*family(r, [f"w{i}" for i in range(300)], 60, 3)] + ["the same text for many rows of this table"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    links = [(b"a", bytes([k + 98])) for k in range(50)] + [(bytes([k + 98]), bytes([200, k])) for k in range(50)]
    assert {bytes(x) for _, x in components.components(spark.createDataFrame(links, "a binary, b binary")).collect()} == {b"a"}


def test_one_row_of_each_group_stays(spark, sf):
    """Rows that share an id, or have none, are judged by their own texts."""
    from quillspark.llm import pipeline

    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(5, a), (5, a + " end"), (5, b), (6, b), (None, a + " more"), (None, "no id " * 30), (None, "no id " * 30), (None, "no id " * 31), (7, a), (7, a), (8, "alone in here"), (8, "alone in here"), (9, None), (9, None)]
    df = spark.createDataFrame([(*x, None, None, None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [tuple(x)[:2] for x in pipeline.near_dedup(spark, df, sf).collect()]
    groups = [[x for x in left if x[1] and x[1].startswith(k)] for k in ("a0", "b0", "no id", "alone")]
    assert [len(g) for g in groups] == [1, 1, 1, 1] and groups[0][0][0] == 5 and groups[1][0] == (5, b)
    assert left.count((9, None)) == 2 and len(left) == 6


@pytest.mark.parametrize("n", [1, 40])
def test_pipeline_links_from_080(spark, make, sf, n):
    """100 shingles against 82 of them and nothing else (0.82; also by the size ratio); against 79 of them no link. n: copies with an own word each, for long lists."""
    from quillspark.llm import pipeline

    r = random.Random(6)
    texts, dropped = [], set()
    for k in range(12):
        w = [f"u{r.randrange(10**9)}" for _ in range(104)]
        for m in (104, 86) if k % 2 else (104, 83):
            texts += [" ".join(w[:m] + [f"own{i}"] * (n > 1)) for i in range(n)]
        at = len(texts) - 2 * n
        dropped |= set(range(at + 1, at + n)) | set(range(at + n + (not k % 2), at + 2 * n))
    left = {row["doc_id"] for row in pipeline.near_dedup(spark, make(texts), sf).collect()}
    assert left == set(range(len(texts))) - dropped
