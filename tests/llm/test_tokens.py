"""Byte BPE, section tokens, packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, cutting_stock, packing, queries
from quillspark.llm.word_bpe import _COMMON, WordBpe

CODEC = bpe.Codec.load(bpe.ranks_path(None))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.encode_special_tokens = True


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z'sdlt\n\t \x1c\x85\xa0　!?1²é日ͅ🙂"), max_size=80), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    ids = CODEC.encode(text, leaf)
    assert ids == CODEC.encoding.encode_ordinary(text)
    assert CODEC.decode(ids, 3) == text.encode()


def test_tree_on_odd_texts(odd_texts):
    for t in [*(t for t in odd_texts if isinstance(t, str)), "日" * 20000, "a b" * 9000, "!" * 9000]:
        assert CODEC.encode(t, 512) == CODEC.encoding.encode_ordinary(t)


def check_bpe(df):
    rows = {r["doc_id"]: r for r in bpe.encode_decode(df, with_ids=True).collect()}
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = CODEC.encoding.encode_ordinary(text or "")
        got = rows[doc_id]
        assert (got["n_tokens"], got["ids"]) == (len(ids), ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    return rows


def test_bpe(make, odd_texts, spark, sf):
    assert len(check_bpe(make(odd_texts, extra=True))) == len(odd_texts)
    check_bpe(queries.table(spark, sf, "documents"))
    assert bpe.encode_decode(make(["x"]).limit(0)).count() == 0


def test_section_tokens(make, odd_texts):
    """Against offsets that another library gives for the same vocabulary."""
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [*odd_texts, "a\n\n\n b!\n\n", "x\r\ny\n", "\n", "é\n\né"]
    df = make(texts, extra=True)
    rows = {}
    for r in bpe.section_tokens(df).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in df.select("doc_id", "text").collect():
        text = text or ""
        got = sorted(rows[doc_id], key=lambda r: r["section"])
        assert "".join(text[r["start"] : r["end"]] for r in got) == text
        assert all(text[r["start"] : r["end"]].count("\n") <= 1 for r in got)
        spans = other.encode(text, add_special_tokens=False).offsets
        assert sum(r["n_tokens"] for r in got) == len(spans)
        if text.isascii():
            for r in got:
                assert r["n_tokens"] == sum(r["start"] <= s < r["end"] for s, _ in spans)
                assert r["n_crossing"] == sum(r["start"] <= s < r["end"] < e for s, e in spans)
    assert bpe.section_tokens(make(["x"]).limit(0)).count() == 0


def plain_sections(text, begins, rule):
    """(tokens, crossing ones) of each section, token by token: begins are code points."""
    places = [len(text[:b].encode()) for b in begins]
    counts, at = [[0, 0] for _ in begins], 0
    for i in CODEC.encoding.encode_ordinary(text):
        size = len(CODEC.encoding.decode_single_token_bytes(i))
        first, last = (max(k for k, p in enumerate(places) if p <= byte) for byte in (at, at + size - 1))
        counts[first if rule == "first" else last][0] += 1
        counts[first if rule == "first" else last][1] += first != last
        at += size
    return [tuple(c) for c in counts]


ODD_SECTIONS = ["a\n\n\n b!\n\n", "x\r\ny\n", "\n", "é\n\né", "日本\n語 テ\n\n🙂\n", "end \n \n\t x"]


def test_section_rules(spark, make, sf):
    """Both rules, other scripts and the whole table, against plain code; crossing tokens move and none is lost."""
    for df in (make(ODD_SECTIONS), queries.table(spark, sf, "documents")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for rule in ("first", "last"):
            got = {}
            for r in bpe.section_tokens(df, rule=rule).collect():
                got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], (r["n_tokens"], r["n_crossing"])))
            for doc_id, text in texts.items():
                rows = sorted(got[doc_id])
                assert [r[3] for r in rows] == plain_sections(text, [r[1] for r in rows], rule)
                assert "".join(text[s:e] for _, s, e, _ in rows) == text
    with pytest.raises(ValueError):
        bpe.section_tokens(make(["x"]), rule="middle")


def test_field_tokens(spark):
    rows = [(1, "title of it", "body  text\n", "en"), (2, None, "日本 語", ""), (3, "", "", None), (None, "é", "🙂", "x"), (1, "title of it", "body  text\n", "en")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, lang string").withColumn("section", F.lit("clash"))
    for rule in ("first", "last"):
        for separator in ("\n", "", " || "):
            got = bpe.field_tokens(df, ["title", "text", "lang"], separator, rule=rule).collect()
            assert len(got) == 15 and [r["field"] for r in got[:3]] == ["title", "text", "lang"]
            for k, (doc_id, *fields) in enumerate(rows):
                parts = [(f or "") + (separator if i < 2 else "") for i, f in enumerate(fields)]
                begins = [len("".join(parts[:i])) for i in range(3)]
                mine = got[3 * k : 3 * k + 3]
                assert [r["doc_id"] for r in mine] == [doc_id] * 3 and [r["start"] for r in mine] == begins
                assert [(r["n_tokens"], r["n_crossing"]) for r in mine] == plain_sections("".join(parts), begins, rule)
    assert bpe.field_tokens(df.limit(0), ["title"]).count() == 0
    with pytest.raises(ValueError):
        bpe.field_tokens(df, ["title"], rule="x")


def test_word_bpe_characters():
    """Every character of the quick way, in several surroundings, and texts of mixed characters."""
    own = WordBpe.load(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(1)
    characters = [chr(c) for c in _COMMON]
    texts = [f"ab{c}Cd {c} 1{c}2'{c}" for c in characters]
    texts += ["".join(r.choice(characters + list("abc 'streldvm!.\n") * 30) for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library_ids(t), ascii(t)


def check_packing(df, most_padding=None, capacity=4096):
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    rows = [r.asDict() for r in packing.pack(df).collect()]
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(docs) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library_ids(text), 2], "<u4")
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    if most_padding is not None:
        assert 1 - sum(r["length"] for r in rows) / capacity / len(sequences) < most_padding
    return rows


def test_packing(make, odd_texts):
    check_packing(make(odd_texts, extra=True))


def test_packing_whole_table(spark, sf):
    check_packing(queries.table(spark, sf, "documents"), 0.03)


def test_packing_repeats_and_empty(spark, make):
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(rows) == 3 and sorted(r["length"] for r in rows) == [1, 3, 3]
    assert packing.pack(make(["x"]).limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), min_size=1, max_size=12))
def test_cutting_stock(demand):
    """Patterns fit and meet the demand exactly; never fewer sequences than the bound, seldom more than a few."""
    size, n = np.array(sorted(demand)), np.array([demand[k] for k in sorted(demand)])
    plan = cutting_stock.cut(size, n, 32)
    assert all((p * size).sum() <= 32 and t > 0 for p, t in plan)
    assert (sum(p * t for p, t in plan) == n).all()
    bound = -(-int((size * n).sum()) // 32)
    patterns, x = cutting_stock.relax(size, n.astype(float), 32)
    assert np.allclose(np.stack(patterns, 1) @ x, n) and x.sum() <= sum(t for _, t in plan) + 1e-6
    assert sum(t for _, t in plan) <= np.ceil(x.sum() - 1e-6) + len(size) and bound <= sum(t for _, t in plan)


def test_library_import():
    assert tiktoken.Encoding
