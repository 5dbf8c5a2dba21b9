"""Evaluation passages inside training texts, by an FM-index for each training shard.

A task gathers the words of its documents into shards of bounded size. For each shard the suffix array
of the word sequence (documents end in a separator) is sorted by prefix doubling on packed ranks, its
Burrows-Wheeler transform is kept as a wavelet matrix with popcount ranks, and every sample_rate-th text
position is kept for its suffix. Test phrases, all windows of `span` consecutive words of the items, are
found together by backward search; occurrences walk the LF mapping to the next sampled suffix; windows
that overlap are merged to removal spans.

Words are maximal runs of letters and digits after lower-casing.

Defined results: null and empty texts hold nothing; items of fewer than `span` words cannot leak; null
item texts are skipped; equal documents each come out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

WORD = re.compile(r"[^\W_]+")
END, GAP, FIRST = 0, 1, 2


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order. seq ends in END, which occurs nowhere else."""
    n = len(seq)
    width = max(1, int(seq.max()).bit_length())
    depth = max(1, min(n, 62 // width))
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        key <<= width
        key[: n - j] |= seq[j:]
    sa = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)

    def regroup(slots: np.ndarray, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        # Rank of a suffix: the slot at which its group begins. Returns the slots still tied.
        new = np.ones(len(slots), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(slots))
        rank[where] = np.repeat(slots[starts], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    tied = regroup(np.arange(n), key[sa], sa)
    bits = n.bit_length()
    ways = 3 if 3 * bits <= 63 else 2
    while len(tied):
        at = sa[tied]
        key = rank[at]
        for j in range(1, ways):
            later = at + j * depth
            key = (key << bits) | np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        order = np.argsort(key)
        at = at[order]
        sa[tied] = at
        tied = regroup(tied, key[order], at)
        depth *= ways
    return sa


class WaveletMatrix:
    """Rank and access over a sequence of symbols, one bit vector with popcount blocks for each level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        cur = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, dtype=np.uint8)]).view(np.uint64)
            self.words.append(packed)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.blocks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(len(bit) - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[k][w] + np.bitwise_count(self.words[k][w] & mask)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each of the positions."""
        at = [np.zeros(len(symbol), dtype=np.int64), *ends]
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            for j, i in enumerate(at):
                ones = self._ones(k, i)
                at[j] = np.where(bit, self.zeros[k] + ones, i - ones)
        return [x - at[0] for x in at[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k in range(self.levels):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol


class FMIndex:
    """Count and locate over one sequence of symbols >= FIRST, with GAP between documents."""

    def __init__(self, seq: np.ndarray, sample_rate: int = 16):
        sa = suffix_array(seq)
        bwt = seq[sa - 1].astype(np.int64)
        self.wavelets = WaveletMatrix(bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 1))])
        self.sampled = sa % sample_rate == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [start, end) of the suffixes that begin with each phrase (a row of equal length)."""
        n_symbols = len(self.before) - 1
        start = np.zeros(len(phrases), dtype=np.int64)
        end = np.full(len(phrases), self.before[-1], dtype=np.int64)
        end[(phrases < FIRST).any(axis=1) | (phrases >= n_symbols).any(axis=1)] = 0
        for step in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(start < end)
            if not len(live):
                break
            symbol = phrases[live, step]
            s, e = self.wavelets.rank(symbol, start[live], end[live])
            start[live], end[live] = self.before[symbol] + s, self.before[symbol] + e
        return start, np.maximum(start, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows, by walking back to the next sampled suffix."""
        place = np.empty(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            done = self.sampled[at]
            place[open_[done]] = self.samples[self.sample_no[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            if len(open_):
                symbol = self.wavelets.access(at)
                at = self.before[symbol] + self.wavelets.rank(symbol, at)[0]
                steps += 1
        return place


def _spans(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Union of windows [s, s + span), as sorted disjoint spans."""
    starts = np.unique(starts)
    new = np.flatnonzero(np.diff(starts, prepend=-span - 2) > span)
    last = np.append(new[1:] - 1, len(starts) - 1)
    return [(int(starts[a]), int(starts[b]) + span) for a, b in zip(new, last)]


class Shard:
    """Some documents under one FM-index, which is built at the first search and serves every block of items."""

    def __init__(self, docs: list[tuple[int, list[str]]], span: int, sample_rate: int):
        self.ids, self.span, self.sample_rate = [d for d, _ in docs], span, sample_rate
        self.symbols: dict[str, int] = defaultdict(count(FIRST).__next__)
        parts, begins, at = [], [], 0
        for _, words in docs:
            begins.append(at)
            parts += [np.fromiter(map(self.symbols.__getitem__, words), dtype=np.int64, count=len(words)), np.array([GAP])]
            at += len(words) + 1
        self.begin, self.seq = np.array(begins), np.concatenate([*parts, np.array([END])])
        self.index: FMIndex | None = None

    def search(self, items: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(item, doc, spans of words)."""
        phrases, owner, span = [], [], self.span
        for k, (_, words) in enumerate(items):
            own = np.array([self.symbols.get(w, END) for w in words], dtype=np.int64)
            if len(own) >= span:
                windows = np.lib.stride_tricks.sliding_window_view(own, span)
                phrases.append(windows)
                owner.append(np.full(len(windows), k))
        if not phrases or not self.ids:
            return
        self.index = self.index or FMIndex(self.seq, self.sample_rate)
        block, owner = np.concatenate(phrases), np.concatenate(owner)
        start, end = self.index.search(block)
        found = np.flatnonzero(end > start)
        if not len(found):
            return
        sizes = (end - start)[found]
        rows = np.repeat(start[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        place = self.index.locate(rows)
        item = np.repeat(owner[found], sizes)
        doc = np.searchsorted(self.begin, place, side="right") - 1
        order = np.lexsort((place, doc, item))
        item, doc, place = item[order], doc[order], place[order]
        cut = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        for a, b in zip(cut, [*cut[1:], len(item)]):
            yield items[item[a]][0], self.ids[doc[a]], _spans(place[a:b] - self.begin[doc[a]], span)


def search_shard(
    docs: list[tuple[int, list[str]]], items: list[tuple[int, list[str]]], span: int, sample_rate: int
) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(item, doc, spans of words) for one shard of documents."""
    return Shard(docs, span, sample_rate).search(items)


def _blocks(items: DataFrame, item_id: str, text_col: str, at_once: int) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    rows = items.select(F.col(item_id).cast("long"), text_col).filter(F.col(text_col).isNotNull())
    for i, t in rows.toLocalIterator():
        block.append((i, WORD.findall(t.lower())))
        if len(block) == at_once:
            yield block
            block = []
    if block:
        yield block


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    span: int = 12,
    shard_words: int = 1_500_000,
    sample_rate: int = 16,
    items_at_once: int = 50_000,
) -> DataFrame:
    """(item_id, doc_id, spans): spans are [first word, end word) of the document, merged.

    The items are the query set and go to every task, in broadcast blocks of at most items_at_once; the corpus is
    read and each shard indexed once, for all blocks. A span of a shard's documents is whole: shards end between
    documents."""
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(block) for block in _blocks(items, item_id, text_col, items_at_once)]
    schema = f"{item_id} long, {doc_id} long, spans array<struct<first:long,last:long>>"
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null and t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shards() -> Iterator[Shard]:
            shard, held = [], 0
            for pdf in batches:
                for d, t in zip(pdf["d"].tolist(), pdf["t"].tolist()):
                    words = WORD.findall(t.lower())
                    if len(words) >= span:
                        shard.append((d, words))
                        held += len(words) + 1
                        if held >= shard_words:
                            yield Shard(shard, span, sample_rate)
                            shard, held = [], 0
            if shard:
                yield Shard(shard, span, sample_rate)

        for shard in shards():
            for block in shared:
                rows = list(shard.search(block.value))
                yield pd.DataFrame(
                    {
                        item_id: pd.Series([r[0] for r in rows], dtype="int64"),
                        doc_id: pd.Series([r[1] for r in rows], dtype="int64"),
                        "spans": pd.Series([[{"first": a, "last": b} for a, b in r[2]] for r in rows], dtype=object),
                    }
                )

    return spread(source).mapInPandas(run, schema)
