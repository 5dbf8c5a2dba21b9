"""Near-duplicate records: bottom-k sketches from one hash function.

Every document is the set of 64-bit hashes of its shingles, sorted; its RETAINED smallest values are its
sketch. An inverted list is kept for each retained value. A list of more than SPLIT documents is split by the
value that follows the retained one in each document's set, and its parts again, up to DEPTH values: two sets
of similarity j share a retained value with probability j, and the r values of a split list with about j**r.
So no list that is gathered holds more than SPLIT documents, whatever the size of the table or of its hot
values, and the number of candidates from them does not grow with the table. What shares all DEPTH values (large
groups of near copies, mostly) is paired in blocks of BLOCK documents, without loss, where the samples below are
compared at once, so that it gives few candidates.

The lists generate overlaps: how many lists a pair shares. A pair is dropped if 256 one-bit samples of the
two sets rule the similarity out, or the bottom-k sketch of their union does; exact Jaccard on the full sets
verifies the few that are left. Each of these steps carries only what it needs: values and ids, then samples,
then sketches, and full sets for the pairs that remain.

A small set retains too few values for that: pairs whose smaller set has at most SHORT values meet in lists for
a value and the two sizes, filled from the first values of each set that two sets of these sizes and the
threshold's overlap cannot both miss, and are neither sampled nor split (long ones are paired in blocks), so
none of them is lost.

Documents with equal sets are one class; lists hold only the first of each class, so a text copied over
a third of all rows costs nothing. No list, candidate or partner is capped. Values that are in more than one in
HOT of all postings (so at most HOT values) never meet a shuffle by value: they are known to be long lists.

Defined results: null, empty and short texts (fewer than min_words words) belong to no pair and are
classes of their own; rows repeated with their id are one record (with different texts under one id, any
one of them speaks); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import spread, written

WORD = re.compile(r"[^\W_]+")
SAMPLES = 256
#: Values of a set in its sketch, and of these the ones that have inverted lists.
SKETCH, RETAINED = 64, 48
#: Documents above which a list is split by the next value; values up to which it is split; documents of a
#: block of a list that is longer still.
SPLIT, DEPTH, BLOCK = 4, 3, 1000
#: Values in more than one in HOT postings (under HOT of them by arithmetic) are sent to every task.
HOT = 20_000
#: Values of the smaller set up to which pairs are found exactly.
SHORT = 32
_SAMPLES = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(56)


class Shingler:
    """Sorted distinct hashes of the n-word shingles of a text."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words = WORD.findall(text.lower()) if text else []
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(ids) - self.shingle + 1
        if n < 1:
            return len(words), ids[:0]
        h = np.zeros(n, dtype=np.uint64)
        for j in range(self.shingle):
            h = (h ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return len(words), np.unique(h ^ (h >> np.uint64(31)))


def _short_keys(u: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the lists for a value and two sizes: sets of n and m values at the threshold share o, so the
    least of what they share is among the first n - o + 1 values of the one and m - o + 1 of the other."""
    n = len(u)
    low = max(1, math.ceil(threshold * n - 1e-9))
    if low > SHORT:
        return np.empty(0, dtype=np.int64)
    high = int(n / threshold + 1e-9) if n <= SHORT else SHORT
    out = []
    for m in range(low, high + 1):
        shared = max(1, math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
        sizes = np.uint64((min(n, m) << 20 | max(n, m)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        key = (u[: n - shared + 1] ^ sizes) * np.uint64(0x9E3779B97F4A7C15)
        out.append(key ^ (key >> np.uint64(32)))
    return np.concatenate(out).view(np.int64)


def _samples(u: np.ndarray) -> np.ndarray:
    """256 bits: the lowest bit of the first value of each of 256 strata (the next one's, where empty)."""
    at = np.searchsorted(u, _SAMPLES)
    at[at == len(u)] = 0
    bits = (u[at] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _prepare(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, threshold: float) -> DataFrame:
    def lists(arrays: list[np.ndarray]) -> pa.Array:
        at = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
        flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, sketches, shorts = [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, u = shingler(t)
                    if n >= min_words and len(u):
                        sketches.append(u[:SKETCH])
                        shorts.append(_short_keys(u, threshold))
                        rows.append((i, len(u), xxhash.xxh128_digest(u.tobytes()), *_samples(u).tolist()))
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.int64()),
                        pa.array(cols[1], pa.int32()),
                        pa.array(cols[2], pa.binary()),
                        *(pa.array(c, pa.int64()) for c in cols[3:7]),
                        lists(sketches),
                        lists(shorts),
                    ],
                    names=["id", "n", "same", "s1", "s2", "s3", "s4", "sketch", "shorts"],
                )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id is not null")
    return spread(source).mapInArrow(
        run, "id long, n int, same binary, s1 long, s2 long, s3 long, s4 long, sketch array<long>, shorts array<long>"
    )


def _sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler(t)[1].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, set binary")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted distinct arrays."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / max(1, len(x) + len(y) - both)


def _sets_of(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, ...) with the column of `what` (id, column) for either end."""
    for end in ("a", "b"):
        pairs = pairs.join(what.select(F.col("id").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs that the sketch of the union does not rule out (4.5 standard deviations)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, to) = (
                (batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *batch.column(c).value_lengths().to_pylist()]))
                for c in (2, 3)
            )
            keep = []
            for k in range(batch.num_rows):
                low, high = x[at[k] : at[k + 1]], y[to[k] : to[k + 1]]
                both = np.sort(np.concatenate([low, high]))
                twice = both[1:] == both[:-1]
                union = len(both) - int(twice.sum())
                size = min(SKETCH, union)
                # The value that ends the sketch of the union, and the shared values up to it.
                last = both[np.flatnonzero(np.append(True, ~twice))[size - 1]]
                shared = int(np.searchsorted(both[1:][twice], last, side="right"))
                slack = 4.5 * (threshold * (1 - threshold) / size) ** 0.5
                if shared / size >= threshold - slack:
                    keep.append(k)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, exact = [], []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                j = _jaccard(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                if j >= threshold - 1e-12:
                    keep.append(k)
                    exact.append(j)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(exact, pa.float64())], names=["a", "b", "jaccard"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, jaccard double")


def _pairs_of_lists(lists: DataFrame) -> DataFrame:
    """(a, b), a < b, within each list (key, id) of at most SPLIT documents."""
    ids = F.array_sort("ids")
    first = F.transform(ids, lambda x, i: F.transform(F.slice(ids, i + 2, SPLIT), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    gathered = lists.groupBy("key").agg(F.collect_set("id").alias("ids"))
    return gathered.select(F.explode(F.flatten(first)).alias("p")).select("p.a", "p.b")


def _may(x: Column, y: Column, threshold: float) -> Column:
    """Whether two sets with these sizes and samples (n, s1 to s4) can be similar enough: at the threshold a share
    p of the bits differs, and 4.5 standard deviations of it, by the strata that are not empty in the smaller
    set, are let through. Small sets are judged by their sizes alone."""
    apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, 5)), F.lit(0))
    small, large = F.least(x[0], y[0]).cast("double"), F.greatest(x[0], y[0]).cast("double")
    p = (1 - threshold) / 2
    filled = SAMPLES * (1 - F.exp(-small / SAMPLES))
    bound = SAMPLES * (p + 4.5 * F.sqrt(F.lit(p * (1 - p)) / filled))
    return (small >= large * threshold - 1e-9) & ((small <= SHORT) | (apart <= bound))


def _pairs_in_blocks(lists: DataFrame, counts: DataFrame, samples: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the pairs that may be similar within each list (key, id) of any length; counts: (key, c).
    A list of c documents falls into c / BLOCK blocks, and each pair of blocks is one group of the join."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = lists.join(counts, "key").join(samples, "id")
    rows = rows.select("key", "id", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("key", "id", "bits", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "low", "high")]
    across = (F.col("x.low") == F.col("x.high")) | (F.col("x.own") != F.col("y.own"))
    on = [*same, F.col("x.id") < F.col("y.id"), across, _may(F.col("x.bits"), F.col("y.bits"), threshold)]
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def overlaps(heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlaps): pairs of documents that may be similar by size and samples, and how many lists they
    share. heads: (id, n, s1 to s4, sketch, shorts), written."""
    samples = heads.select("id", F.array("n", "s1", "s2", "s3", "s4").alias("bits"))
    shorts = heads.select("id", F.explode("shorts").alias("key"))
    short_counts = shorts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    blocks, found = [_pairs_in_blocks(shorts, short_counts, samples, threshold)], []
    large = heads.filter(F.col("n") > SHORT).select("id", "n", "sketch")
    # Places of each document's sketch whose lists are to be read at this depth: all, then those of long lists.
    live = large.withColumn("places", F.sequence(F.lit(1), F.least("n", F.lit(RETAINED))))
    for depth in range(1, DEPTH + 1):
        posts = live.select("id", "sketch", F.explode("places").alias("place"))
        posts = posts.select("id", "place", F.xxhash64(F.lit(depth), F.slice("sketch", F.col("place"), F.lit(depth))).alias("key"))
        counts = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        if depth == DEPTH:
            blocks.append(_pairs_in_blocks(posts.select("key", "id"), counts, samples, threshold))
            break
        counts = written(counts)
        total = counts.agg(F.sum("c")).first()[0] or 0
        hot = F.broadcast(counts.filter(F.col("c") > max(SPLIT, total // HOT)).select("key"))
        rest = posts.join(hot, "key", "left_anti").join(counts, "key")
        found.append(_pairs_of_lists(rest.filter(F.col("c") <= SPLIT).select("key", "id")))
        long = rest.filter(F.col("c") > SPLIT).select("id", "place").unionByName(posts.join(hot, "key", "left_semi").select("id", "place"))
        live = large.join(written(long.groupBy("id").agg(F.collect_list("place").alias("places"))), "id")
    count = F.count(F.lit(1)).alias("overlaps")
    pairs = _sets_of(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(count), samples, "bits")
    pairs = pairs.filter(_may(F.col("bits_a"), F.col("bits_b"), threshold)).select("a", "b", "overlaps")
    every = pairs.unionByName(reduce(DataFrame.unionByName, blocks).groupBy("a", "b").agg(count))
    return every.groupBy("a", "b").agg(F.sum("overlaps").alias("overlaps"))


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int = 5,
    without: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership is (id, class_id, n_shingles), class_id being the smallest id with
    the same shingle set; links is (a, b, jaccard), a < b, between class ids with jaccard >= threshold."""
    prepared = _prepare(df, id_col, text_col, shingle, min_words, threshold)
    if without is not None:
        prepared = prepared.join(without.select(F.col(id_col).cast("long").alias("id")), "id", "left_anti")
    prepared = written(prepared)
    classes = prepared.groupBy("same").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    twins = classes.filter("copies > 1").select("same", "class_id")
    membership = prepared.select("id", "n", "same").join(twins, "same", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.col("n").cast("long").alias("n_shingles")
    )
    # The first of each class; rows without twins never meet a join.
    later = membership.filter("id <> class_id").select("id")
    heads = prepared.join(later, "id", "left_anti")
    pairs = overlaps(heads, threshold).select("a", "b")
    likely = written(_estimated(_sets_of(pairs, prepared.select("id", "sketch"), "sketch"), threshold).distinct())
    ends = likely.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    texts = df.select(F.col(id_col).cast("long").alias(id_col), text_col).join(ends, id_col, "left_semi")
    sets = _sets(texts, id_col, text_col, shingle).dropDuplicates(["id"])
    return membership, _verified(_sets_of(likely, sets, "set"), threshold)


def all_pairs(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: links carried over to every member, and the pairs within a class. Only for results
    that are defined as pairs of records; their number is that of the result."""
    m = membership.select("id", "class_id").distinct()
    twins = m.filter("id <> class_id").select("class_id").distinct()
    shared = m.join(twins, "class_id", "left_semi")
    inner = shared.alias("x").join(shared.alias("y"), (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.id") < F.col("y.id")))
    inner = inner.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    left = m.select(F.col("class_id").alias("a"), F.col("id").alias("ia"))
    right = m.select(F.col("class_id").alias("b"), F.col("id").alias("ib"))
    outer = links.select("a", "b").join(left, "a").join(right, "b")
    outer = outer.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return inner.unionByName(outer)
