"""Quality rules: document statistics, fixed limits, and boosted trees over the statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, release, ship, stash
from .kernels import _PLACE, U, doc_words, mix, text_bytes
from .trees import Trees, fit

#: Labelled rows at most that the trees are fitted on: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which each may move the verdict (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "top_word_share": -1, "upper_share": -1, "digit_share": -1, "exclaim_per_word": -1, "words_per_line": 0}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SCHEMA = ", ".join(["doc_id long", "text_key long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])


def _window_words(words: np.ndarray) -> int:
    """Words that lie in some 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    h = mix(words[:-2] * U(_PLACE[1]) + words[1:-1] * U(_PLACE[2]) + words[2:] * U(_PLACE[3]))
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines that hold a word, and those of them that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():  # of bytes: white space is 9-13 and 32
            n += 1
            seen.add(line)
    return n, n - len(seen)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_bytes(batch.column(2))
        counts, features = [], []
        for i, words in enumerate(doc_words(batch.column(2), lower=False)):
            data = raw[off[i] : off[i + 1]]
            by = np.zeros(256, np.int64)
            for k in range(0, len(data), 1 << 20):
                by += np.bincount(data[k : k + (1 << 20)], minlength=256)
            n = len(words)
            chars = int(by.sum() - by[128:192].sum() - by[9:14].sum() - by[32])
            symbols = int(by[_SYMBOLS].sum())
            lines, dup = _lines(data.tobytes())
            again = _window_words(words)
            times = np.unique(words, return_counts=True)[1] if n else np.zeros(1, np.int64)
            counts.append((n, chars, symbols, dup, again))
            w, c = max(n, 1), max(chars, 1)
            features.append((np.log1p(n), chars / w, symbols / w, dup / max(lines, 1), again / w, len(times) / w, times.max() / w, by[65:91].sum() / c, by[48:58].sum() / c, by[33] / w, n / max(lines, 1)))
        counts = np.array(counts, np.int64).reshape(-1, len(COUNTS))
        features = np.array(features, np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T), *(pa.array(f) for f in features.T)], names=["doc_id", "text_key", *COUNTS, *FEATURES])
    release()


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text, null as empty), the counts and the features of every text; words are
    longest runs without characters 9-13 and 32."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(_measure, _SCHEMA)


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees for quality = 1, from at most fit_rows labelled documents. Null labels and ids don't count."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    joined = stash(stats.join(labelled, "doc_id").select("doc_id", "quality", *FEATURES), "labelled")
    sample = bounded_sample(joined, "doc_id", fit_rows, joined.count()).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(np.float64), sample["quality"].to_numpy(np.float64), np.array(list(FEATURES.values())))


def _judge(model: Trees, keep_from: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy() for k in range(2 + len(COUNTS), batch.num_columns)], 1)
            p = 1 / (1 + np.exp(-model.score(x)))
            counts = [batch.column(k).to_numpy() for k in range(2, 2 + len(COUNTS))]
            failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2 : 2 + len(COUNTS)], pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p), batch.column(1)], names=["doc_id", *COUNTS, "base_failed", "kept", "p_good", "text_key"])
        release()

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row for each document: its counts, base_failed, kept, p_good (the trees' probability of
    good quality) and text_key (xxhash64 of the text, null as empty).

    docs: doc_id long, text string; labels: doc_id long, quality 0 or 1; other columns are ignored. Each text is read
    once; the statistics are written and both the fit (a bounded sample of labelled rows) and the scoring read those.
    Null texts count as empty and fail; null doc_ids are judged but not fitted on; repeated rows give repeated rows.
    Without labels, or with labels of one class, the trees are a constant near that class (without any: good).
    """
    stats = stash(statistics(docs), "stats")
    model = train(stats, labels, fit_rows)
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "p_good double", "text_key long"])
    return stats.mapInArrow(_judge(model, keep_from), schema)
