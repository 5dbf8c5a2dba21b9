"""Cut oversized texts into pieces under a limit, at natural boundaries where there are any.

Size units are the tokens of a public byte-level tokenizer, that is, UTF-8 bytes. For each text the byte
offset of every character is a prefix sum, and the boundaries of each level (section, paragraph, line,
sentence, word, char) are one sorted array. A piece ends at the last boundary under the limit, found by
binary search level by level; the next begins the overlap before that end. Where no level has a
boundary, the cut is a hard one between two characters.

Defined results: null, empty and white-space texts and texts within the limit give no rows in the found
form and one piece (none if empty) in the piece form; texts of any length are handled whole, in time in
proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import strip

LEVELS = ("section", "paragraph", "line", "sentence", "word", "char")
_OPENS = {
    "section": re.compile(r"(?:^|(?<=\n))#"),
    "paragraph": re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"(?<=[.!?])\s+"),
    "word": re.compile(r"\s+"),
}
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


class Ruler:
    """Offsets and boundaries of one text."""

    def __init__(self, text: str):
        self.text = text = text.strip()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        self.offset = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        self.size = int(self.offset[-1])
        dense = np.flatnonzero(~np.isin(points, _SPACES))
        self._dense = dense
        self._bounds: dict[str, np.ndarray] = {}

    def bounds(self, level: str) -> np.ndarray:
        """Sorted starts of the level's units after the first, as character positions, those of all
        levels before included."""
        if level not in self._bounds:
            n = len(self.text)
            if level == "char":
                own = np.arange(1, n, dtype=np.int64)
            elif level == "section":
                own = np.array([m.start() for m in _OPENS[level].finditer(self.text)], dtype=np.int64)
            else:
                own = np.array([m.end() for m in _OPENS[level].finditer(self.text)], dtype=np.int64)
            k = LEVELS.index(level)
            if k:
                own = np.union1d(own, self.bounds(LEVELS[k - 1]))
            self._bounds[level] = own[(own > 0) & (own < n)]
        return self._bounds[level]

    def largest(self, level: str) -> int:
        """Size of the largest unit of a level, white space at its ends not counted."""
        cuts = np.concatenate([[0], self.bounds(level), [len(self.text)]])
        first = np.searchsorted(self._dense, cuts[:-1])
        last = np.searchsorted(self._dense, cuts[1:]) - 1
        some = last >= first
        if not some.any():
            return 0
        return int((self.offset[self._dense[last[some]] + 1] - self.offset[self._dense[first[some]]]).max())

    def cut_level(self, limit: int) -> str:
        """The first level at which every unit is within the limit."""
        return next((x for x in LEVELS[:-1] if self.largest(x) <= limit), "char")

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, str]]:
        """(start, end, level of the cut at the end) in characters; the last piece has level 'end'."""
        out, start, n = [], 0, len(self.text)
        while n:
            top = int(np.searchsorted(self.offset, self.offset[start] + limit, side="right")) - 1
            if top >= n:
                out.append((start, n, "end"))
                break
            # Half a piece at least, so that a boundary of a high level does not leave crumbs.
            least = int(np.searchsorted(self.offset, self.offset[start] + max(limit // 2, overlap + 4)))
            end, how = max(top, start + 1), "char"
            for level in LEVELS[:-1]:
                b = self.bounds(level)
                i = int(np.searchsorted(b, top, side="right")) - 1
                if i >= 0 and b[i] > least:
                    end, how = int(b[i]), level
                    break
            out.append((start, end, how))
            back = int(np.searchsorted(self.offset, self.offset[end] - overlap, side="right")) - 1
            start = back if start < back else end
        return out


def _over(df: DataFrame, text_col: str, limit: int) -> DataFrame:
    """Rows over the limit: the size test runs in the JVM, so that only these go to Python."""
    return df.filter(F.octet_length(strip(F.col(text_col))) > limit)


def cut_levels(df: DataFrame, id_col: str, text_col: str, limit: int = 4096) -> DataFrame:
    """(id, cut_at) of the texts above the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rulers = ((i, Ruler(t)) for i, t in zip(pdf["id"], pdf["text"]))
            rows = [(i, r.cut_level(limit)) for i, r in rulers if r.size > limit]
            yield pd.DataFrame(rows, columns=[id_col, "cut_at"])

    some = _over(df, text_col, limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return some.mapInPandas(run, f"{id_col} long, cut_at string")


def pieces(df: DataFrame, id_col: str, text_col: str, limit: int = 4096, overlap: int = 256) -> DataFrame:
    """(id, piece_no, byte_start, size, cut, piece): all pieces of all texts. A text within the limit is
    its own single piece; that case never leaves the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                r = Ruler(t)
                for k, (s, e, how) in enumerate(r.pieces(limit, overlap)):
                    rows.append((i, k, int(r.offset[s]), int(r.offset[e] - r.offset[s]), how, r.text[s:e]))
            yield pd.DataFrame(rows, columns=[id_col, "piece_no", "byte_start", "size", "cut", "piece"])

    schema = f"{id_col} long, piece_no int, byte_start long, size long, cut string, piece string"
    text = strip(F.col(text_col))
    some = _over(df, text_col, limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = df.filter((text != "") & (F.octet_length(text) <= limit)).select(
        F.col(id_col).cast("long").alias(id_col),
        F.lit(0).alias("piece_no"),
        F.lit(0).cast("long").alias("byte_start"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit("end").alias("cut"),
        text.alias("piece"),
    )
    return some.mapInPandas(run, schema).unionByName(whole)
