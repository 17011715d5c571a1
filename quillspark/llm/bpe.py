"""Byte-level BPE as a monoid: texts are encoded by halves and joined; tokens are attributed to sections."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship

#: Vocabulary by default, and characters of a leaf of the tree.
RANKS, LEAF = "byte_bpe_50k.tiktoken", 2048
#: Bytes of text, about, whose results are returned together.
BATCH = 16 << 20
#: A white-space character after another kind of character: every pre-token ends here, whatever surrounds the two, for
#: no pre-token has white space behind anything else, and what follows doesn't look back.
_CUT = re.compile(r"(?<=\S)[ \n\t\r]")
_loaded: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.plain = self.encoding.encode_ordinary

    @staticmethod
    def load(path: str) -> Codec:
        if path not in _loaded:
            _loaded[path] = Codec(path)
        return _loaded[path]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._tree(text, 0, len(text), leaf)

    def _tree(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= leaf:
            return self.plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid, leaf), self._tree(text, mid, hi, leaf))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its parts.

        Windows on both sides of mid grow until each holds a cut at which pre-tokens must end; only what lies between
        the cuts is encoded again. A side without a cut is encoded again as a whole.
        """
        if _CUT.match(text, mid):
            return left + right
        a, b, width = lo, hi, 32
        while width < 2 * (hi - lo):
            first = max(lo, mid - width)
            cuts = [m.start() for m in _CUT.finditer(text, first, mid) if m.start() > lo]
            if cuts or first == lo:
                a = cuts[-1] if cuts else lo
                break
            width *= 2
        width = 32
        while width < 2 * (hi - lo):
            last = min(hi, mid + width)
            m = _CUT.search(text, mid + 1, last)
            if m or last == hi:
                b = m.start() if m else hi
                break
            width *= 2
        keep = len(left) - self._tokens(reversed(left), len(text[a:mid].encode()))
        skip = self._tokens(right, len(text[mid:b].encode()))
        return left[:keep] + self.plain(text[a:b]) + right[skip:]

    def _tokens(self, ids, size: int) -> int:
        """How many of the ids make up exactly size bytes."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.bytes[i])
            n += 1
        if size:
            raise AssertionError("a cut lies inside a token")
        return n

    def decode(self, ids: list[int], leaf: int = 4 * LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def ranks_path(path: str | None) -> str:
    return path or public_tokenizers.path(RANKS)


def _round_trip(path: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0

            def flush() -> pa.RecordBatch:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)
                for c in out:
                    c.clear()
                return done

            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = codec.encode(text)
                raw = np.array(ids, "<u4")
                row = (doc_id.as_py(), len(ids), hashlib.sha256(raw.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), raw.astype(np.int32))
                for c, v in zip(out, row, strict=False):
                    c.append(v)
                size += 4 * len(ids)
                if with_ids and size > BATCH:
                    yield flush()
                    size = 0
            yield flush()
        release()

    return run


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The byte-level BPE encoding of each text, and the digest of what the ids decode to.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes) and, if asked for, ids. Null texts
    count as empty (no ids); null doc_ids and repeated rows are returned as they are. A text is one task's work, and
    memory follows the longest text. path: rank file, on every machine.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_round_trip(ranks_path(path), with_ids), schema)


def _attribute(path: str, rule: str, stated: bool = False) -> Callable:
    """Sections are lines, or begin at the code points that the third column states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            rows, given = 0, []

            def flush() -> pa.RecordBatch:
                done = pa.RecordBatch.from_arrays([pa.array(given, pa.int64()), *(pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out[1:])], names=names)
                given.clear()
                for c in out:
                    c.clear()
                return done

            for k, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                if stated:
                    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[batch.column(2)[k].as_py()]
                else:
                    begin = np.append(0, np.flatnonzero(data == 10) + 1)  # byte at which each section begins
                    if len(begin) > 1 and begin[-1] == len(data):
                        begin = begin[:-1]
                ends = np.cumsum(codec.length[np.array(codec.plain(text), np.int64)])
                starts = ends - np.diff(ends, prepend=0)
                first = np.searchsorted(begin, starts, "right") - 1
                last = np.searchsorted(begin, ends - 1, "right") - 1
                n = np.bincount(first if rule == "first" else last, minlength=len(begin))
                crossing = np.bincount((first if rule == "first" else last)[first != last], minlength=len(begin))
                char = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before each byte
                at = char[np.append(begin, len(data))]
                doc = doc_id.as_py()
                given += [doc] * len(begin)
                for c, v in zip(out[1:], (np.arange(len(begin)), at[:-1], at[1:], n, crossing), strict=True):
                    c.append(v.astype(np.int64))
                rows += len(begin)
                if rows > 100_000:
                    yield flush()
                    rows = 0
            yield flush()
        release()

    return run


def field_tokens(docs: DataFrame, fields: list[str], separator: str = "\n", path: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each field of documents that are their fields with a separator after each but the last.

    The whole document is encoded once, as a model reads it; the fields' intervals follow from their lengths, and a
    separator belongs to the field before it. Tokens that cross a boundary count as in section_tokens.

    docs: doc_id long and the fields; other columns are ignored. Returns doc_id, section (the field's place, from 0),
    field, start, end, n_tokens, n_crossing. Null and empty fields have no tokens but their separator's; null doc_ids
    and repeated rows are returned as they are.
    """
    if rule not in ("first", "last"):
        raise ValueError("rule is first or last")
    ship(docs.sparkSession)
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    begins = [F.lit(0)]
    for part in parts[:-1]:
        begins.append(begins[-1] + F.length(part))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*begins).alias("begins"))
    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
    out = rows.mapInArrow(_attribute(ranks_path(path), rule, True), schema)
    return out.select("doc_id", "section", F.element_at(F.array(*map(F.lit, fields)), (F.col("section") + 1).cast("int")).alias("field"), "start", "end", "n_tokens", "n_crossing")


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """Tokens of each section of each text, a section being a line with the line feed that ends it.

    The whole text is encoded once. Token spans come from the tokens' byte lengths and are joined with the sections'
    intervals by binary search. A token that crosses a boundary counts for the section that holds its first byte
    (rule "first") or its last byte (rule "last"), so that a text's sections always add up to its tokens.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, section (from 0), start, end (code
    points, end exclusive), n_tokens, n_crossing (those of them that reach into another section). An empty or null
    text has one section without tokens; null doc_ids and repeated rows are returned as they are.
    """
    if rule not in ("first", "last"):
        raise ValueError("rule is first or last")
    ship(docs.sparkSession)
    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_attribute(ranks_path(path), rule), schema)
