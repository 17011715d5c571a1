"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, stash

#: Base kinds, in the order that breaks ties. Fixed values.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Candidates that no base kind takes: written-out addresses, and digit groups without a plus sign; and the number
#: that a longer, failing run of the phone pattern begins with.
_WEAK = re.compile(r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+)|(?P<phone>(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z]))")
_WEAK_HINT = re.compile(r"[\[(]at[\])]|[0-9]\)?[ .-][0-9]")
_BEGINS = re.compile(r"\+[0-9]{1,3}(?: ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}|(?:[ .-][0-9]{2,4}){3})(?![0-9])")
#: Gazetteers. Top-level domains beside the two-letter ones, and reserved ones.
_TOP = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel cat asia tel post app dev blog shop site online store tech cloud email news xyz club live".split())
_RESERVED_TOP = frozenset("example test invalid localhost local lan internal".split())
#: Country calling codes: of one and two digits, then the ranges of three.
_CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9]")
#: Card issuers: first digits and lengths.
_ISSUERS = [(re.compile(r"4"), (13, 16, 19)), (re.compile(r"5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720"), (16,)), (re.compile(r"3[47]"), (15,)), (re.compile(r"30[0-5]|3[689]"), (14, 16, 19)), (re.compile(r"6011|64[4-9]|65|62|81"), (16, 17, 18, 19)), (re.compile(r"35(?:2[89]|[3-8])"), (16, 17, 18, 19)), (re.compile(r"50|5[6-9]|6[0-9]"), tuple(range(12, 20)))]
#: Networks that belong to nobody: private, loopback, link-local, documentation, multicast and above.
_RESERVED_NETWORKS = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")]
#: Words that announce personal data, and words that announce other numbers.
_ANNOUNCES = re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|teléfono|call|mobile|fax|cell|contact|e-?mail|mail|courriel|correo|card|visa|address|whatsapp)\b[^\n]{0,16}\Z")
_DENIES = re.compile(r"(?i)\b(?:version|isbn|issn|order|invoice|page|pages|build|total|serial|part|ticket|article|section|chapter|licen[cs]e)\b[^\n]{0,16}\Z")
_WINDOW, _NEAR = 40, 80
#: What is believed of a labeler beforehand: how often it is right, and how much that weighs.
ACCURACY, ANCHOR = 0.8, 0.1
#: Votes: 0 against, 1 none, 2 for.
LABELERS = ["format", "check", "gazetteer", "context", "company", "surroundings"]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _found(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of base spans, in that order, and of the numbers at the head of failing phone runs."""
    out: list[tuple[int, int, int]] = []
    missed: list[tuple[int, int, int]] = []
    free, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            lo = at  # the longest run before the sign that no earlier address took
            while lo > free and text[lo - 1] in _LOCAL_CHARACTERS:
                lo -= 1
            if lo < at:
                out.append((lo, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
                elif inner := _BEGINS.match(m[0]):
                    missed.append((m.start(), 3, m.start() + inner.end()))
    return sorted(out), missed


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in that order; kind is an index of KINDS."""
    return _found(text)[0]


def _weak_spans(text: str, base: list[tuple[int, int, int]], missed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside of base spans and of each other, leftmost first."""
    found = list(missed)
    if _WEAK_HINT.search(text):
        found += [(m.start(), 0 if m.lastgroup == "email" else 3, m.end()) for m in _WEAK.finditer(text)]
    out, free = [], 0
    stops = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0, int)
    starts = [s for s, _, _ in base]
    for s, kind, e in sorted(found, key=lambda x: (x[0], -x[2])):
        k = int(np.searchsorted(starts, e))  # base spans that begin before e
        if s >= free and (not k or stops[k - 1] <= s):
            out.append((s, kind, e))
            free = e
    return out


def _votes(text: str, span: tuple[int, int, int], others: np.ndarray) -> list[int]:
    """One vote of each labeler. others: starts of base spans."""
    s, kind, e = span
    value = text[s:e]
    digits = "".join(c for c in value if c in "0123456789")
    if kind == 0:
        top = re.split(r"[.\])]", value.rstrip(") ]"))[-1].strip().lower()
        form = 2 if "@" in value and value[0].isalnum() and value[-1].isalnum() else 1
        check = 2 if top.isalpha() and 2 <= len(top) <= 24 else 0
        known = 0 if top in _RESERVED_TOP else 2 if top in _TOP or len(top) == 2 else 1
    elif kind == 1:
        parts = [int(p) for p in value.split(".")]
        form = 0 if any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 2
        check = 2 if all(p <= 255 for p in parts) else 0
        known = 0 if any(ipaddress.IPv4Address(bytes(parts)) in n for n in _RESERVED_NETWORKS) else 1
    elif kind == 2:
        form = 2 if re.fullmatch(r"[0-9]{14,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", value) else 1
        check = 2 if _luhn(digits) else 0
        known = 2 if any(p.match(digits) and len(digits) in n for p, n in _ISSUERS) else 0
    else:
        form = 2 if value[0] == "+" else 1
        check = 0 if not 9 <= len(digits) <= 15 else 2 if value[0] == "+" and 10 <= len(digits) <= 13 else 1
        known = (2 if _CALLING.match(digits) else 0) if value[0] == "+" else 1
    before = text[max(0, s - _WINDOW) : s]
    context = 2 if _ANNOUNCES.search(before) else 0 if _DENIES.search(before) else 1
    near = others[np.searchsorted(others, s - _NEAR) : np.searchsorted(others, e + _NEAR)]
    company = 2 if (near != s).any() else 1
    glued = (s and (text[s - 1].isalnum() or text[s - 1] in "=/#:_")) or (e < len(text) and (text[e].isalnum() or text[e] in "=/_"))
    return [form, check, known, context, company, 0 if glued else 1]


def _code(text: str, span: tuple[int, int, int], others: np.ndarray) -> int:
    """The votes on a span, and what the classifier reads besides, as one number of a bounded range."""
    digits = sum(c in "0123456789" for c in text[span[0] : span[2]])
    code = span[1]
    for vote in _votes(text, span, others):
        code = 3 * code + vote
    return 4 * code + (0 if not digits else 1 if digits < 9 else 2 if digits < 12 else 3)


#: Codes that there are: the histogram of them is all that leaves the executors.
CODES = 4 * 3 ** len(LABELERS) * 4


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (a column for each labeler) and digit class."""
    digit, rest = codes % 4, codes // 4
    votes = np.stack([rest // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)], 1)
    return rest // 3 ** len(LABELERS), votes, digit


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        base_column, weak_column, code_column = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base, missed = _found(text)
            weak = _weak_spans(text, base, missed)
            others = np.array([s for s, _, _ in base], np.int64)
            code_column.append([_code(text, s, others) for s in [*base, *weak]])
            base_column.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
            weak_column.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in weak])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_column, span), pa.array(weak_column, span), pa.array(code_column, pa.list_(pa.int32()))], names=["doc_id", "base", "weak", "codes"])
    release()


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns.

    Returns each labeler's table P(against, for | not personal, personal, and a vote cast) and each pattern's posterior.
    Labelers are taken as independent given the truth, and one that casts no vote says nothing; the first guess is the
    share of labelers that vote for. Both classes count as equally likely beforehand: few votes can't tell their sizes,
    and a large class would take in what only speaks against itself. Labelers are taken to be right in ACCURACY of their
    votes beforehand, with the weight of a share ANCHOR of all candidates. Nothing tells the two classes apart but the votes: if labelers come out voting
    against the second one on the whole, the classes have changed places and are put back.
    """
    n = votes.shape[1]
    if not len(votes):
        return np.full((n, 2, 2), 1 / 2), np.zeros(0)
    lean = ((votes == 2).sum(1) + 0.5) / (n + 1)
    tables = np.zeros((n, 2, 2))
    anchor = (1 + ANCHOR * count.sum()) * np.array([[ACCURACY, 1 - ACCURACY], [1 - ACCURACY, ACCURACY]])
    for _ in range(rounds):
        z = np.stack([1 - lean, lean], 1) * count[:, None]
        log = np.zeros((len(votes), 2))
        for k in range(n):
            tables[k] = np.stack([z[votes[:, k] == v].sum(0) for v in (0, 2)], 1) + anchor
            tables[k] /= tables[k].sum(1, keepdims=True)
            cast = votes[:, k] != 1
            log[cast] += np.log(tables[k][:, votes[cast, k] // 2]).T
        log -= log.max(1, keepdims=True)
        new = np.exp(log)[:, 1] / np.exp(log).sum(1)
        if np.abs(new - lean).max() < 1e-9:
            break
        lean = new
    if (tables[:, 1, 1] - tables[:, 0, 1]).sum() < 0:
        tables, lean = tables[:, ::-1], 1 - lean
    return tables, lean


def _features(codes: np.ndarray) -> np.ndarray:
    kind, votes, digit = unpack(codes)
    hot = lambda x, n: np.eye(n)[x]
    return np.concatenate([np.ones((len(codes), 1)), hot(kind, 4), hot(digit, 4), *(hot(votes[:, k], 3) for k in range(len(LABELERS)))], 1)


def train(codes: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton's method."""
    x = _features(codes)
    _, target = reliabilities(unpack(codes)[1], count)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (count * (p - target)) + ridge * w
        step = np.linalg.solve((x.T * (count * p * (1 - p) + 1e-12)) @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _decide(keep: frozenset[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            counts, digests, texts, added = [], [], [], []
            for base, weak, codes in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                spans = [(b["start"], b["kind"], b["end"]) for b in base.as_py()]
                more = [(b["start"], b["kind"], b["end"]) for b, c in zip(weak.as_py(), codes.as_py()[len(spans) :], strict=True) if c in keep]
                named = [(s, KINDS[k], e) for s, k, e in spans]
                counts.append([sum(k == i for _, k, _ in spans) for i in range(4)])
                digests.append(hashlib.sha256(write(named).encode()).hexdigest())
                texts.append(write([(s, KINDS[k], e) for s, k, e in sorted(spans + more)]))
                added.append(len(more))
            counts = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64()), pa.array(counts.sum(1) + np.array(added, np.int64), pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])
        release()

    return run


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each document's personal data: the base kinds' spans and those that the trained classifier adds.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (kind:start:end by start and kind), n_added, n_spans (all of them).

    Candidates are base spans and, outside of them, weaker ones: the number at the head of a phone run that is too long,
    written-out addresses, digit groups without a plus sign. Numbers that fail the check digit are no candidates. Six labelers vote
    on each: format, check (digits, lengths), gazetteer (top-level domains, calling codes, card issuers, reserved
    networks), context (words before it), company (base spans nearby) and surroundings. Votes and features of a
    candidate make one of 11 664 codes. The codes' counts over the whole corpus are all that the driver gets; they are
    what expectation-maximisation and the classifier need, so that no sample is drawn. Candidates whose code scores
    threshold or more are added; base spans always stay.

    Null texts count as empty. Null doc_ids and repeated rows are returned as they are. Without candidates nothing is
    trained and nothing added.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<start: bigint, kind: int, end: bigint>>"
    found = stash(docs.mapInArrow(_scan, f"doc_id long, base {span}, weak {span}, codes array<int>"), "spans")
    rows = found.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()
    codes, count = np.array([r["code"] for r in rows], np.int64), np.array([r["count"] for r in rows], float)
    keep: frozenset[int] = frozenset()
    if len(codes):
        keep = frozenset(codes[_features(codes) @ train(codes, count) >= np.log(threshold / (1 - threshold))].tolist())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return found.mapInArrow(_decide(keep), schema)
