"""MinHash near-duplicates by an inverted join of signature coordinates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, discard, hot_keys, release, ship, small_side, split_join, stash
from .components import components
from .kernels import MinHash, U, doc_words, forest, mix, shingles

#: Length of a signature, and its first coordinates that a posting list merges before the others.
COORDINATES, PREFIX = 128, 64
#: Probability, at most, that a pair just at the threshold has too few matches, and that it shares no posted coordinate.
LOST = 1e-9
#: Members of a posting list or cluster, and shingles of a cluster, that one block holds; larger ones are cut into blocks.
LIST_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 1024, 512, 1_000_000


@dataclass(frozen=True)
class Layout:
    """What a candidate pair of similarity percent / 100 needs: matches of the 128 coordinates."""

    percent: int
    matches: int

    @classmethod
    def of(cls, percent: int) -> Layout:
        """As many matches as leave out a pair just at the threshold with probability LOST at most."""
        p, below = percent / 100, 0.0  # below: probability of fewer than k + 1 matches
        for k in range(COORDINATES):
            below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
            if below > LOST:
                return cls(percent, max(k, 1))
        return cls(percent, COORDINATES)

    @property
    def posted(self) -> int:
        """Coordinates to post under: as many as it takes for a shared one, with probability LOST or for certain."""
        likely = math.ceil(math.log(LOST) / math.log(1 - self.percent / 100)) if self.percent < 100 else 1
        return min(likely, COORDINATES - self.matches + 1)

    @property
    def prefix_matches(self) -> int:
        """Matches among the first PREFIX coordinates below which the others can't make up for it."""
        return max(0, self.matches - (COORDINATES - PREFIX))

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be that similar."""
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)


def _sign(words: int, posted: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(COORDINATES)
        salt = np.arange(posted, dtype=U) * U(0x9E3779B97F4A7C15)
        for batch in batches:
            count, digest, sig, posts = [], [], [], []
            for h in doc_words(batch.column(2), lower=True):
                s = shingles(h, words)
                count.append(len(s))
                if not len(s):
                    digest.append(None), sig.append(None), posts.append(None)
                    continue
                m = hashes(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append((mix(m) >> U(56)).astype(np.uint8).tobytes())
                posts.append(mix(m[:posted] + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(posts, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "digest", "sig", "posts"],
            )
        release()

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that are sorted by the first columns, as one table for each run of whole key values per batch of input.

    A table holds whole runs only; the last run waits for the next batch.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(keys)]
        lo, hi = 0, batch.num_rows - 1  # the first row of the last run, by bisection
        while lo < hi:
            mid = (lo + hi) // 2
            if all(batch.column(k)[mid] == last[k] for k in range(keys)):
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield pa.Table.from_batches([*kept, batch.slice(0, lo)])
            kept = [batch.slice(lo)]
        elif kept and any(kept[-1].column(k)[0] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(kept)
            kept = [batch]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """First row of each run, and the number of rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _matching(sig: np.ndarray, size: np.ndarray, need: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one long list with enough matches. Collisions are counted over the prefix first; pairs that the other
    coordinates can't lift over the threshold any more are skipped."""
    a, b = [], []
    for i in range(0, len(sig), 64):
        part = sig[i : i + 64]
        j0 = i
        near = (part[:, None, :PREFIX] == sig[None, j0:, :PREFIX]).sum(2, dtype=np.uint8) >= need.prefix_matches
        near &= need.sizes(size[i : i + 64, None], size[None, j0:])
        x, y = np.nonzero(near)
        keep = x < y  # each pair once
        x, y = x[keep], y[keep]
        ok = np.concatenate([(part[x[k : k + 4096]] == sig[y[k : k + 4096] + j0]).sum(1) >= need.matches for k in range(0, len(x), 4096)] or [np.zeros(0, bool)])
        a.append(x[ok] + i), b.append(y[ok] + j0)
    return np.concatenate(a), np.concatenate(b)


def _merge(need: Layout) -> Callable:
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted postings (post, x, y, digest, sig, n_shingles) to a spanning forest of each list's candidate links."""
        for rows in runs(batches, 3):
            post, x, y, size = (rows.column(k).to_numpy() for k in (0, 1, 2, 5))
            sig = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            at = _starts([post, x, y])
            length = np.diff(at)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in np.flatnonzero(length > 32):
                p, q = _matching(sig[at[k] : at[k + 1]], size[at[k] : at[k + 1]], need)
                a.append(p + at[k]), b.append(q + at[k])
            run = np.repeat(np.arange(len(length)), length)
            short = np.flatnonzero((length <= 32) & (length > 1))
            mine = np.flatnonzero(np.isin(run, short)) if len(short) else np.zeros(0, np.int64)
            for d in range(1, int(length[short].max()) if len(short) else 0):
                p = mine[mine + d < len(run)]
                p = p[run[p] == run[p + d]]
                p = p[need.sizes(size[p], size[p + d])]
                for k in range(0, len(p), 8192):
                    c = p[k : k + 8192]
                    c = c[(sig[c] == sig[c + d]).sum(1) >= need.matches]
                    a.append(c), b.append(c + d)
            root = forest(len(run), np.concatenate(a), np.concatenate(b))
            linked = np.flatnonzero(root != np.arange(len(root)))
            digest = rows.column(3).combine_chunks()
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(root[linked])), digest.take(pa.array(linked))], names=["a", "b"])
        release()

    return merged


def _confirmed(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union, counted exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n <= 12:
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])]
        both = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs]
        keep = [p for p, m in zip(pairs, both, strict=True) if 100 * m >= percent * (size[p[0]] + size[p[1]] - m)]
        return np.array([p[0] for p in keep], np.int64), np.array([p[1] for p in keep], np.int64)
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del value
    row = np.repeat(np.arange(n), size)
    common = times > 1  # what one set alone has is in no intersection
    rank = np.cumsum(common) - 1
    row, column = row[common[column]], rank[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)  # counts under 2^24 are exact
    width = 4096
    for lo in range(0, int(common.sum()), width):
        i, j = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((n, width), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    return a, b


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members (root, digest, n, text) of clusters to their shingle sets, once each digest of a batch.

        Rows that share a member's doc_id and text key but not the text came along in the join; digests tell.
        """
        for batch in batches:
            keep, out, seen = [], [], set()
            for k, (own, h) in enumerate(zip(batch.column(1).to_pylist(), doc_words(batch.column(3), lower=True), strict=True)):
                if own not in seen:
                    s = shingles(h, words).tobytes()
                    if hashlib.blake2b(s, digest_size=16).digest() == own:
                        seen.add(own), keep.append(k), out.append(s)
            took = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns[:3], pa.array(out, pa.binary())], names=["root", "digest", "n", "shingles"])
        release()

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted members (root, x, y, digest, shingles) of candidate clusters to a spanning forest of the true links."""
        for rows in runs(batches, 3):
            at = _starts([rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy()])
            digest, held = rows.column(3), rows.column(4)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                known = dict(zip(digest.slice(lo, hi - lo).to_pylist(), held.slice(lo, hi - lo).to_pylist(), strict=True))
                ids, sets = list(known), [np.frombuffer(s, U) for s in known.values()]
                root = forest(len(ids), *_confirmed(sets, percent))
                linked = np.flatnonzero(root != np.arange(len(root)))
                a += [ids[k] for k in root[linked]]
                b += [ids[k] for k in linked]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        release()

    return run


def _blocks(rows: DataFrame, n: str, key: str) -> DataFrame:
    """Each row once for every pair of blocks (x <= y) that its own block is part of; n: number of blocks."""
    own = F.pmod(F.xxhash64(key, F.lit(17)), F.col(n)).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("own", "other")


def groups(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """As near_duplicates, with text_key (xxhash64 of the text, null as empty) and chosen: of each group the row with the
    smallest doc_id (nulls last) and then text key is chosen, and so is every row without shingles.

    Rows that repeat the chosen one in both are chosen too.
    """
    spark = docs.sparkSession
    ship(spark)
    need = Layout.of(percent)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    signed = stash(docs.mapInArrow(_sign(words, need.posted), "doc_id long, text_key long, n_shingles long, digest binary, sig binary, posts array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    classes = signed.where("digest is not null").groupBy("digest").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("posts").alias("posts"))
    classes = stash(classes, "classes")

    posted = classes.select("digest", F.explode("posts").alias("post"))
    shared = stash(posted.groupBy("post").count().where("count > 1").select("post", F.ceil(F.col("count") / LIST_BLOCK).cast("int").alias("n")), "shared")
    posted = posted.join(small_side(shared, SMALL_ROWS), "post").join(classes.select("digest", "sig", "n_shingles"), "digest")
    posted = _blocks(posted, "n", "digest").select("post", "x", "y", "digest", "sig", "n_shingles").repartition("post", "x", "y").sortWithinPartitions("post", "x", "y")
    clusters = components(posted, _merge(need))
    discard(shared)

    members = stash(clusters.join(classes.select(F.col("digest").alias("node"), "first", "n_shingles"), "node"), "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int").alias("n"))
    member = split_join(members, sizes, "root", hot_keys(members, "root"))
    member = stash(member.select("root", F.col("node").alias("digest"), "n", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key")), "member")
    texts = docs.join(small_side(member, SMALL_ROWS), docs["doc_id"].eqNullSafe(member["own_id"]) & (docs["text_key"] == member["own_key"])).select("root", "digest", "n", "text")
    sets = stash(texts.mapInArrow(_sets(words), "root binary, digest binary, n int, shingles binary"), "sets")
    blocks = _blocks(sets, "n", "digest").select("root", "x", "y", "digest", "shingles").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    links = components(blocks, _confirm(percent))
    for done in (members, member, sets):
        discard(done)

    linked = stash(links.withColumnRenamed("node", "digest").join(classes.select("digest", "first"), "digest"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    member = split_join(linked, lowest, "root", hot_keys(linked, "root")).select("digest", "lowest")
    named = classes.select("digest", "first").join(member, "digest", "left").select("digest", F.coalesce("lowest", "first").alias("first"))
    slim = signed.select("doc_id", "text_key", "n_shingles", "digest")
    held = split_join(slim.where("digest is not null"), named, "digest", hot_keys(signed, "digest"))
    chosen = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key").eqNullSafe(F.col("first"))
    held = held.select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), chosen.alias("chosen"))
    none = slim.where("digest is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    return held.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of percent / 100 or more.

    docs: doc_id long, text string; other columns are ignored. Returns one row for each input row: doc_id,
    n_shingles, component_id, kept.

    1. Each text is signed once: distinct shingles, a digest of the whole set, 128 minimum hashes. Rows with equal
       sets become one class, aggregated map-side.
    2. Inverted join: a pair needs so many matches of 128 (about 82 for 85 percent) that texts just that similar have
       fewer with probability 1e-9 at most. A class is posted under its first coordinate-value pairs, 11 for 85 and 13
       for 80 percent, that another class has too; texts just that similar share none of them with probability 1e-9
       at most (0.15^11, 0.2^13). Lists longer than 1024 are cut
       into blocks and every pair of blocks is a task's work, so that no list meets whole in one task. A list counts
       collisions over a prefix of 64 coordinates first and skips pairs that can't reach the threshold any more. It
       returns a spanning forest of the rest, never all pairs.
    3. The forests' components are candidate clusters; the full sets of each cluster (again by pairs of blocks) are
       intersected exactly, and components of the confirmed links give the result.

    Null or word-less texts have no shingles, link with nothing, and are their own component. Null doc_ids take part
    with their texts but never name a component unless all of it have none; kept is false unless nothing names it.
    Repeated rows give repeated results. An empty table gives an empty result.
    """
    return groups(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")
