"""Nearest neighbours by additive quantisation: residual codebooks, beam search, lookup tables, exact reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, bounded_sample, discard, release, ship, small_side, stash
from .near_dedup import _starts, runs

#: Rows that the codebooks are fitted on at most: those with the smallest hash of vec_id.
FIT_ROWS = 16_384
#: Codebooks, codewords of each, and partial codes that the beam keeps.
BOOKS, WORDS, BEAM = 24, 256, 4
#: Codes and queries of a block, and rows that are measured exactly for each query.
ROW_BLOCK, QUERY_BLOCK, RERANK = 65_536, 4096, 256


@dataclass
class Codebooks:
    """books[m, k] is codeword k of book m in the full dimension; dots are all products of codewords."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row and the squared norm of what they add up to.

        All beam * WORDS extensions of a row's partial codes are scored by what they leave of it; the best go on.
        """
        m, k, _ = self.books.shape
        books, x = self.books.astype(np.float32), x.astype(np.float32)
        codes = np.zeros((len(x), m), np.uint8)
        norms = np.zeros(len(x))
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            n = len(part)
            left = part[:, None, :]  # residual of each partial code
            path = np.zeros((n, 1, 0), np.uint8)
            for b in books:
                loss = (left**2).sum(2)[:, :, None] - 2 * (left @ b.T) + (b**2).sum(1)
                flat = loss.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                row = np.arange(n)[:, None]
                best = np.empty((n, keep), np.int64)
                for j in range(keep):  # a few passes for minima are cheaper than a partition
                    best[:, j] = flat.argmin(1)
                    flat[row[:, 0], best[:, j]] = np.inf
                was, word = best // k, best % k
                left = left[row, was] - b[word]
                path = np.concatenate([path[row, was], word[:, :, None].astype(np.uint8)], 2)
            best = (left**2).sum(2).argmin(1)
            row = np.arange(n)
            codes[lo : lo + n] = path[row, best]
            norms[lo : lo + n] = ((part - left[row, best]) ** 2).sum(1)
        return codes, norms


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 4, seed: int = 7) -> Codebooks:
    """Codebooks by k-means on what earlier books leave over."""
    r = np.random.default_rng(seed)
    words = max(1, min(words, len(x) // 4))
    left, out = x.astype(np.float32), []
    for _ in range(books):
        c = left[r.choice(len(left), words, replace=len(left) < words)] + 0.0
        for _ in range(rounds):
            near = np.argmin((c**2).sum(1) - 2 * left @ c.T, 1)
            n = np.bincount(near, minlength=words)
            held, total = np.flatnonzero(n), np.zeros_like(c)
            total[held] = np.add.reduceat(left[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[held])
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], left[r.choice(len(left), words)])
        near = np.argmin((c**2).sum(1) - 2 * left @ c.T, 1)
        left = left - c[near]
        out.append(c)
    return Codebooks(np.stack(out).astype(np.float64))


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _encode(model: Codebooks, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = model.encode(_vectors(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["item", "codes", "norm"])
        release()

    return run


def _search(model: Codebooks, size: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (g, q, kind, id, vector, codes, norm), queries being of kind 0, to the rows of each that score best."""
        m, words = model.books.shape[:2]
        books = model.books.reshape(m * words, -1)
        for rows in runs(batches, 2):
            at = _starts([rows.column(0).to_numpy(), rows.column(1).to_numpy()])
            kind, ids, norms = (rows.column(k).to_numpy() for k in (2, 3, 6))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))  # queries come first
                if cut == lo or cut == hi:
                    continue
                codes = np.frombuffer(b"".join(rows.column(5).slice(cut, hi - cut).to_pylist()), np.uint8).reshape(-1, m)
                places = codes.T.astype(np.int32) + words * np.arange(m, dtype=np.int32)[:, None]
                norm, items, n = norms[cut:hi], ids[cut:hi], min(most, hi - cut)
                queries = _vectors(rows.column(4).slice(lo, cut - lo).combine_chunks(), size)
                out = []
                for q, query in zip(ids[lo:cut], queries, strict=True):
                    table = books @ query  # its product with every codeword
                    score = norm - 2 * table.take(places).sum(0)
                    near = np.argpartition(score, n - 1)[:n]
                    out.append((np.full(n, q), items[near], score[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "item", "near"])
        release()

    return run


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda e: e != 0)


def nearest(embeddings: DataFrame, queries: Column, k: int = 10, column: str = "embedding", fit_rows: int = FIT_ROWS, rerank: int = RERANK) -> DataFrame:
    """For every row that the condition selects, its k nearest other rows by Euclidean distance.

    embeddings: vec_id long, column array of numbers; other columns are ignored. Returns query_id, rank (from 1),
    vec_id, score (the distance, exact, in double precision), ties to the smaller vec_id.

    Rows with equal vectors make one item, which keeps the k + 1 smallest of its vec_ids (limited before the shuffle):
    no query needs more of them, and a vector in a third of all rows costs no more than another. Codebooks are fitted on
    a bounded sample, then every item is encoded, and only codes and norms (32 bytes an item) meet the queries: blocks of
    65 536 codes and of 4096 queries, dealt by hashes, are scored through lookup tables. Of the `rerank` items that
    score best of all, a block of items holds so many by its share; it returns that and six deviations more. The best
    `rerank` of each query then meet their vectors once and are measured exactly.

    Vectors that are null, all zero, of another length than most, or hold null or non-finite values take no part, nor
    do null vec_ids. A repeated vec_id asks once (with its smallest vector) and is found as often as it occurs, but
    never by itself. Without usable rows the result is empty.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vector = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), queries.alias("asks")).where("vec_id is not null").where(_usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["size"]
    rows = rows.where(F.size("vector") == size)
    first = Window.partitionBy("vector").orderBy("vec_id")
    items = rows.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    items = items.groupBy("vector").agg(F.collect_list(F.struct("vec_id", F.least("times", F.lit(k)).cast("int").alias("times"))).alias("ids"))
    items = stash(items.withColumn("item", F.monotonically_increasing_id()), "items")
    total = items.count()
    sample = bounded_sample(items.select("vector"), "vector", fit_rows, total).collect()
    model = fit(np.array([r["vector"] for r in sample], np.float64))

    coded = stash(items.select("item", "vector").mapInArrow(_encode(model, size), "item long, codes binary, norm double"), "codes")
    asked = stash(rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")), "asked")
    row_blocks, query_blocks = max(1, -(-total // ROW_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    share = rerank / row_blocks
    most = min(rerank, int(np.ceil(share + 6 * np.sqrt(share) + 6)))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumnRenamed("item", "id").select(deal(row_blocks, 1).alias("g"), every(query_blocks).alias("q"), F.lit(1).alias("kind"), "id", F.lit(None).cast("array<double>").alias("vector"), "codes", "norm")
    right = asked.withColumnRenamed("vec_id", "id").select(every(row_blocks).alias("g"), deal(query_blocks, 2).alias("q"), F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"))
    blocks = left.union(right).repartition("g", "q").sortWithinPartitions("g", "q", "kind", "id")
    found = blocks.mapInArrow(_search(model, size, most), "query_id long, item long, near double")
    best = Window.partitionBy("query_id").orderBy("near", "item")
    found = stash(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("query_id", "item"), "found")
    discard(coded)

    measured = small_side(found, SMALL_ROWS).join(items, "item").join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    square = F.aggregate(F.zip_with("query", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = measured.select("query_id", F.sqrt(square).alias("score"), F.explode("ids").alias("of")).where("of.vec_id <> query_id")
    near = near.select("query_id", F.col("of.vec_id").alias("vec_id"), "score", F.explode(F.array_repeat(F.lit(0), F.col("of.times"))).alias("again"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
