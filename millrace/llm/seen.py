"""Has this key been seen before? Golomb-coded sets over hashes reduced to a target range.

A key is hashed to 64 bits and reduced to its top b bits, where 2**b is about rows * 2**fp_bits; a set of
sorted reduced hashes is then stored as gaps in Golomb code with parameter 2**fp_bits, in blocks of 128
values. A probe reads the one block that could hold its value. Input is handled in epochs of arrival
order: each epoch probes the sets of the earlier ones, and what is new becomes that epoch's set. So a
shard keeps about fp_bits + 2 bits for each distinct key and never the keys. A probe that is no member
is answered wrongly with probability below n / 2**b <= 2**-fp_bits.

seen_before answers for the rows of one table and checks what the sets claim: by 128 bits of hash of the claimed
rows alone, in place of their keys (two different keys among n agree in these with probability below n**2 / 2**129).
Keys are read once; after that only hashes are written and shuffled. Epochs hold equal numbers of rows,
whatever the ids.

A Store keeps the sets as files of blocks, by shard, for batches that come later: a batch is answered from the
files alone, its own repetitions exactly, and adds one file of its new keys for each shard.

Defined results: a null key is never seen and gives no row; equal ids with equal keys are not "before"
each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import written

BLOCK, WIDE = 128, 4096


@dataclass
class GolombSet:
    """Sorted distinct integers in blocks: a base value, unary quotients and fixed-width remainders."""

    bits: int
    bases: np.ndarray
    counts: np.ndarray
    unary: list[bytes]
    low: list[bytes]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> GolombSet:
        """values: sorted, distinct, non-negative int64."""
        bases, counts, unary, low = [], [], [], []
        # A gap of more than WIDE quotients, which hashes hardly ever leave, begins a block as well.
        wide = np.flatnonzero(np.diff(values) >> bits > WIDE) + 1
        edges = np.unique(np.concatenate([np.arange(0, len(values), BLOCK), wide, [len(values)]])).astype(np.int64)
        for at, end in zip(edges, edges[1:]):
            part = values[at:end]
            gaps = np.diff(part)
            quotients = gaps >> bits
            ends = np.cumsum(quotients + 1) - 1
            ones = np.ones(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
            ones[ends] = 0
            rest = gaps & ((1 << bits) - 1)
            flat = ((rest[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
            bases.append(int(part[0]))
            counts.append(len(part))
            unary.append(np.packbits(ones).tobytes())
            low.append(np.packbits(flat).tobytes())
        return cls(bits, np.array(bases, dtype=np.int64), np.array(counts, dtype=np.int64), unary, low)

    def block(self, k: int) -> np.ndarray:
        """The values of one block."""
        n = int(self.counts[k]) - 1
        if not n:
            return self.bases[k : k + 1]
        ones = np.unpackbits(np.frombuffer(self.unary[k], dtype=np.uint8))
        ends = np.flatnonzero(ones == 0)[:n]
        quotients = np.diff(ends, prepend=-1) - 1
        flat = np.unpackbits(np.frombuffer(self.low[k], dtype=np.uint8))[: n * self.bits]
        rest = (flat.reshape(n, self.bits).astype(np.int64) << np.arange(self.bits)).sum(axis=1)
        return self.bases[k] + np.concatenate([[0], np.cumsum((quotients << self.bits) | rest)])

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """probes: sorted. Only blocks that a probe falls into are decoded."""
        found = np.zeros(len(probes), dtype=bool)
        if not len(self.bases) or not len(probes):
            return found
        at = np.searchsorted(self.bases, probes, side="right") - 1
        starts = np.flatnonzero(np.diff(at, prepend=-2))
        for s, e in zip(starts, [*starts[1:], len(at)]):
            if at[s] >= 0:
                values = self.block(int(at[s]))
                i = np.minimum(np.searchsorted(values, probes[s:e]), len(values) - 1)
                found[s:e] = values[i] == probes[s:e]
        return found

    def size_bits(self) -> int:
        return 8 * (sum(map(len, self.unary)) + sum(map(len, self.low))) + 128 * len(self.bases)


def _hashed(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(id, h, h2): two independent 64-bit hashes in place of the key."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).filter("key is not null and id is not null")
    return rows.select("id", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _reduced(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _bits(n: int, fp_bits: int) -> int:
    return min(62, max(8, math.ceil(math.log2(max(n, 1))) + fp_bits))


def _keyed(df: DataFrame, id_col: str, key: Column, epochs: int, fp_bits: int) -> tuple[DataFrame, int, int]:
    """((id, v, h2, epoch), bits, rows): epochs end at the quantiles of the ids."""
    hashed = written(_hashed(df, id_col, key))
    ends = [k / epochs for k in range(1, epochs)] or [1.0]
    n, cuts = hashed.agg(F.count(F.lit(1)), F.percentile_approx("id", ends, 100_000)).first()
    bits = _bits(n, fp_bits)
    epoch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in (cuts or [])[: epochs - 1]), F.lit(0))
    return hashed.select("id", _reduced(F.col("h"), bits).alias("v"), "h2", epoch.cast("int").alias("epoch")), bits, n


def _probe(firsts: DataFrame, bits: int, n: int, fp_bits: int, shard_rows: int) -> DataFrame:
    """(epoch, v) that the sets of earlier epochs claim to hold."""
    shard_bits = min(20, max(0, math.ceil(math.log2(max(1, n / shard_rows)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, epoch = pdf["v"].to_numpy(), pdf["epoch"].to_numpy()
        sets: list[GolombSet] = []
        out_v, out_e = [], []
        for e in np.unique(epoch):
            probes = np.unique(v[epoch == e])
            hit = np.zeros(len(probes), dtype=bool)
            for s in sets:
                hit |= s.contains(probes)
            sets.append(GolombSet.build(probes[~hit], fp_bits))
            out_v.append(probes[hit])
            out_e.append(np.full(int(hit.sum()), e, dtype=np.int32))
        return pd.DataFrame({"v": np.concatenate(out_v), "epoch": np.concatenate(out_e)})

    pairs = firsts.select("v", "epoch", F.shiftrightunsigned("v", bits - shard_bits).alias("shard"))
    return pairs.groupBy("shard").applyInPandas(run, "v long, epoch int")


def _flags(
    df: DataFrame, id_col: str, key: Column, epochs: int, fp_bits: int, shard_rows: int
) -> tuple[DataFrame, DataFrame, int, int]:
    keyed, bits, n = _keyed(df, id_col, key, epochs, fp_bits)
    # One row for each key and epoch leaves the map side, so a key that is a third of all rows is cheap.
    firsts = written(keyed.groupBy("v", "h2", "epoch").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    hits = written(_probe(firsts, bits, n, fp_bits, shard_rows))
    # The check: of the claimed keys only, the epoch that really had it first.
    claimed = firsts.join(hits.select("v").distinct(), "v", "left_semi")
    first_epoch = claimed.groupBy("v", "h2").agg(F.min("epoch").alias("first_epoch"))
    checked = (
        claimed.join(hits.withColumn("hit", F.lit(True)), ["v", "epoch"], "left")
        .join(first_epoch, ["v", "h2"])
        .select("v", "h2", "epoch", F.coalesce("hit", F.lit(False)).alias("hit"), "first_epoch")
    )
    return keyed, firsts.join(checked, ["v", "h2", "epoch"], "left"), bits, n


def seen_before(
    df: DataFrame, id_col: str, key: Column, epochs: int = 8, fp_bits: int = 10, shard_rows: int = 500_000
) -> DataFrame:
    """Ids of the rows whose key came with a smaller id: column named id_col, one row each.

    Sets answer for earlier epochs and claimed keys are checked exactly; within an epoch the first id of
    the key decides. No row is missed: a set holds every value it was given."""
    keyed, flags, _, n = _flags(df, id_col, key, epochs, fp_bits, shard_rows)
    before = F.coalesce(F.col("hit") & (F.col("epoch") > F.col("first_epoch")), F.lit(False))
    flags = flags.select("v", "h2", "epoch", "first_id", "n", before.alias("before")).filter("before or n > 1")
    # Groups above n / 2000 rows number under 2000: these, and only these, are sent to every task.
    hot = F.col("n") > max(1000, n // 2000)
    rows, on = keyed.select("id", "v", "h2", "epoch"), ["v", "h2", "epoch"]
    some = flags.filter(~hot).drop("n")
    many = F.broadcast(flags.filter(hot).drop("n"))
    is_dup = F.col("before") | (F.col("id") > F.col("first_id"))
    cold = rows.join(many, on, "left_anti").join(some, on).filter(is_dup)
    warm = rows.join(many, on).filter(is_dup)
    return cold.select(F.col("id").alias(id_col)).unionByName(warm.select(F.col("id").alias(id_col)))


def seen_report(
    df: DataFrame, id_col: str, key: Column, epochs: int = 8, fp_bits: int = 10, shard_rows: int = 500_000
) -> DataFrame:
    """For each epoch: distinct keys probed, keys new to the epoch, wrong answers of the sets among these
    (audited) and the rate that theory gives for them."""
    _, flags, bits, _ = _flags(df, id_col, key, epochs, fp_bits, shard_rows)
    hit = F.coalesce("hit", F.lit(False))
    truly = hit & (F.col("epoch") > F.col("first_epoch"))
    per = flags.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("keys_probed"),
        F.count_if(~truly).alias("keys_new"),
        F.count_if(hit & ~truly).alias("wrong_answers"),
    )
    # At most `epochs` rows: the running sum over all of them is a handful of values.
    earlier = Window.partitionBy(F.lit(0)).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("keys_new").over(earlier), F.lit(0))
    return per.select(
        "epoch",
        "keys_probed",
        "keys_new",
        held.alias("keys_held"),
        "wrong_answers",
        (F.col("wrong_answers") / F.greatest("keys_new", F.lit(1))).alias("audited_rate"),
        (F.lit(1.0) - F.exp(-held / F.lit(float(2**bits)))).alias("theoretical_rate"),
    )


_BLOCKS = "shard int, base long, n int, unary binary, low binary"


class Store:
    """Golomb-coded sets in a folder of any file system that Spark writes: one dataset of blocks (shard, base, n,
    unary, low) for each batch, in batch=K. A task reads the blocks of one shard, about fp_bits + 2 bits a key, and
    decodes those that a probe falls into.

    capacity: distinct keys up to which a wrong answer is rarer than 2**-fp_bits; more keys make it likelier in
    proportion, and every answer says how likely."""

    def __init__(self, path: str, capacity: int, fp_bits: int = 10, shard_rows: int = 500_000):
        self.path, self.fp_bits, self.bits = path, fp_bits, _bits(capacity, fp_bits)
        self.shard_bits = min(20, max(0, math.ceil(math.log2(max(1, capacity / shard_rows)))))

    def blocks(self, spark: SparkSession) -> DataFrame:
        """Blocks of all batches; none before the first."""
        try:
            return spark.read.schema(_BLOCKS + ", batch int").parquet(self.path).drop("batch")
        except AnalysisException:
            return spark.createDataFrame([], _BLOCKS)

    def _shard(self, v: Column) -> Column:
        return F.shiftrightunsigned(v, self.bits - self.shard_bits).cast("int")

    def _claimed(self, values: DataFrame) -> DataFrame:
        """(v) of the distinct values (v) that the store claims to hold."""
        fp_bits = self.fp_bits

        def run(probes: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            v = np.unique(probes["v"].to_numpy())
            found = np.zeros(len(v), dtype=bool)
            if len(stored) and len(v):
                # The blocks of a batch are apart from one another; those of several batches may overlap.
                stored = stored.sort_values("base", kind="stable")
                lone = np.searchsorted(v, stored["base"].to_numpy())
                for k, at in enumerate(lone):
                    row = stored.iloc[k]
                    if at < len(v):
                        one = GolombSet(fp_bits, np.array([row["base"]]), np.array([row["n"]]), [row["unary"]], [row["low"]])
                        values_ = one.block(0)
                        end = np.searchsorted(v, values_[-1], side="right")
                        if end > at:
                            i = np.minimum(np.searchsorted(values_, v[at:end]), len(values_) - 1)
                            found[at:end] |= values_[i] == v[at:end]
            return pd.DataFrame({"v": v[found]})

        probes = values.select("v", self._shard(F.col("v")).alias("shard"))
        return probes.groupBy("shard").cogroup(self.blocks(values.sparkSession).groupBy("shard")).applyInPandas(run, "v long")

    def add(self, values: DataFrame, batch: int) -> None:
        """The distinct values (v) as the blocks of a batch. A batch written again replaces itself."""
        fp_bits = self.fp_bits

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            s = GolombSet.build(np.unique(pdf["v"].to_numpy()), fp_bits)
            shard = np.full(len(s.bases), pdf["shard"].iloc[0], dtype=np.int32)
            return pd.DataFrame({"shard": shard, "base": s.bases, "n": s.counts, "unary": s.unary, "low": s.low})

        rows = values.select("v", self._shard(F.col("v")).alias("shard"))
        rows.groupBy("shard").applyInPandas(run, _BLOCKS).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def held(self, spark: SparkSession) -> int:
        """Values in the store."""
        return self.blocks(spark).agg(F.sum("n")).first()[0] or 0

    def answer(self, df: DataFrame, id_col: str, key: Column, batch: int) -> tuple[DataFrame, dict[str, float]]:
        """(id_col, seen) for every row of a batch with a key, and the rates of wrong answers; then the batch's new
        keys are added. seen: the key came in an earlier batch (by the sets, never missed) or with a
        smaller id of this one (by 128 bits of hash). Rates: `theoretical`, held / 2**bits, and `audited`, the share
        of values drawn at random, one for each distinct key of the batch, that the sets claim to hold."""
        rows = written(_hashed(df, id_col, key).withColumn("v", _reduced(F.col("h"), self.bits)))
        spark = rows.sparkSession
        firsts = rows.groupBy("v", "h2").agg(F.min("id").alias("first_id"))
        values = rows.select("v").distinct()
        claimed = written(self._claimed(values))
        drawn = values.select(_reduced(F.xxhash64(F.lit(99), "v"), self.bits).alias("v")).distinct()
        held, n = self.held(spark), drawn.count()
        rates = {"theoretical": held / 2.0**self.bits, "audited": self._claimed(drawn).count() / max(1, n)}
        out = (
            rows.join(firsts, ["v", "h2"])
            .join(claimed.withColumn("hit", F.lit(True)), "v", "left")
            .select(F.col("id").alias(id_col), ((F.col("id") > F.col("first_id")) | F.coalesce("hit", F.lit(False))).alias("seen"))
        )
        out = written(out)
        self.add(values.join(claimed, "v", "left_anti"), batch)
        return out, rates
