"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, release, ship, split_join, stash
from .kernels import forest

#: Links that are contracted at once.
CONTRACTED = 100_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, CONTRACTED at a time, replaced by a spanning forest with the same components."""

    def flush(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept)
        both = pa.concat_arrays([c for k in (0, 1) for c in rows.column(k).chunks])
        names = both.dictionary_encode()
        order = names.dictionary.take(pc.sort_indices(names.dictionary))  # binary: in order of bytes, as Spark's
        place = pc.index_in(names.dictionary, order).to_numpy()
        ends = place[names.indices.to_numpy()].astype(np.int64)
        root = forest(len(order), ends[: len(rows)], ends[len(rows) :])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([order.take(pa.array(moved)), order.take(pa.array(root[moved]))], names=["a", "b"])

    kept, n = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            n += batch.num_rows
        if n >= CONTRACTED:
            yield flush(kept)
            kept, n = [], 0
    if kept:
        yield flush(kept)
    release()


def components(rows: DataFrame, links: Callable | None = None) -> DataFrame:
    """(node, root) for every node of links a-b (binary, not null); root is the smallest node of its component.

    rows: the links, or what the function links (of Arrow batches) makes them of. Tasks contract their links at once,
    to as few as they find to be enough. Links point from the larger node a to the smaller b. Each round is a large-star step (a joins what b's smallest
    neighbour is) and a small-star step (all smaller neighbours of a join the smallest). Minima are aggregated before
    they are shuffled. A node that very many links point to is cut into parts for the join; a node has few links of its
    own, at most one from each contracted block and round. Rounds are written to the shared folder and end when nothing
    moves; no link ever reaches the driver.
    """
    ship(rows.sparkSession)
    rows = rows if links else rows.select("a", "b").where("a <> b")
    found = rows.mapInArrow(lambda batches: contract(links(batches) if links else batches), "a binary, b binary")
    links, seen = stash(found, "links"), None
    while True:
        low = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
        hot = hot_keys(links, "b")
        large = stash(split_join(links, low, "b", hot, "left").select("a", F.coalesce("least", "b").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        old, links = links, stash(small.distinct(), "small")
        for done in (old, hot, large):
            discard(done)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
