"""Sequences of bounded length from documents, by cutting stock over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, ship, stash
from .cutting_stock import cut
from .word_bpe import WordBpe

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 2, 4096
#: Lengths are planned in steps of so many tokens: the plan has CAPACITY / STEP classes.
STEP = 8
#: Pieces of a class that one task ranks, about.
RANKED = 1000


def _pieces(path: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordBpe.load(path).encode
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, tokens = [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + last)
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    doc.append(doc_id.as_py()), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), tokens.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, start, length, crc, tokens)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return run


def _plan(histogram: list[tuple[int, int]], capacity: int, step: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (class, first rank, end rank, first sequence, copies in a sequence, first slot) that say where ranks go."""
    classes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    ranges, given, sequence = [], np.zeros(len(classes), np.int64), 0
    for pattern, times in cut(classes, demand, capacity // step):
        slot = 0
        for i in np.flatnonzero(pattern):
            a = int(pattern[i])
            ranges.append((int(classes[i]), int(given[i]), int(given[i]) + a * times, sequence, a, slot))
            given[i] += a * times
            slot += a
        sequence += times
    return ranges


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most capacity tokens.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document is cut every capacity tokens; what is left over is a piece of its own.

    One pass over the texts gives the pieces, which are written. Their lengths, rounded up to step, make a histogram of
    capacity / step classes at most: all that the driver sees, whatever the number of documents. Column generation
    (linear program, knapsack pricing) turns it into patterns; rounded down they are used so many times, and what
    rounding leaves over (less than a sequence for each class) is filled by exact subset sums. Pieces are ranked within their
    class, dealt by turns (written with the pieces) to parts of RANKED so that no class meets in one task, and a rank is looked up in the patterns. Null texts count as empty (the end id alone); null doc_ids and repeated rows are packed like others.
    """
    if capacity % step:
        raise ValueError("step must divide capacity")
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(docs.mapInArrow(_pieces(path or public_tokenizers.path(VOCABULARY), end_id, capacity), schema).withColumn("turn", F.monotonically_increasing_id()), "pieces").withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    histogram = [(r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()]
    ranges = spark.createDataFrame(_plan(histogram, capacity, step), "class int, lo long, hi long, sequence long, copies int, slot int")

    parts = spark.createDataFrame([(c, -(-n // RANKED)) for c, n in histogram], "class int, parts int")  # a row for each class
    pieces = pieces.join(F.broadcast(parts), "class").withColumn("part", F.pmod("turn", "parts").cast("int"))
    counts = stash(pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    # Dealt by class and part, as the ranks: the counts join without another shuffle of pieces.
    ranked = pieces.withColumn("row", F.row_number().over(order)).join(before, ["class", "part"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    # A range table has a row for each class of each pattern: at most capacity / step classes, and as many patterns
    # again for what rounding leaves over.
    placed = ranked.join(F.broadcast(ranges), (ranked["class"] == ranges["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long")).withColumn("slot", F.col("slot") + nth % F.col("copies"))
    place = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
