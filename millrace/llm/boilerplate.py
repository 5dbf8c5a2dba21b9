"""Page boilerplate against main content: a linear-chain CRF over the leaf units of a page.

Units are the text blocks between tags of html, or the lines of Markdown. Features are the unit's words
and shape, its ancestor tags and class words, its place, and under how many titles of its site it
occurs (so that copies of one article do not make its lines look like the site's). The weights are trained by train_boilerplate.py on labelled pages; labels are decoded by Viterbi.

The plan: one pass over the pages gives each unit its score without the site count, its md5 and a key
of site and masked text; keys are counted by title with partial aggregation; the few counts above one go
back to their units; a second pass over arrays of numbers (no text) decodes. The text is read once.

Defined results: null and empty pages give no units; a null or broken url makes the site '' (its units
are still counted together); pages of any size are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import site
from millrace.llm.crf import Chain, viterbi
from millrace.llm.units import (
    html_units, markdown_units, page_title, place_features, repeat_feature, site_word, tag_features, text_shape,
)
from millrace.session import spread, written

_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_DIGITS = re.compile(r"\d+")


class Model:
    """Weights of the CRF, and scores and labels of units."""

    def __init__(self, weights: dict[str, float], chain: Chain):
        self.weights, self.chain, self._known = weights, chain, {}
        self._word = {k[2:]: v for k, v in weights.items() if k[:2] == "w:"}
        self._pair = {tuple(k[2:].split(" ")): v for k, v in weights.items() if k[:2] == "b:"}
        self._first = {k[6:]: v for k, v in weights.items() if k[:6] == "first:"}
        self._places: dict[tuple, float] = {}
        self.repeat = {k: weights.get(repeat_feature(k), 0.0) for k in (1, 2, 3, 5, 20)}

    def __reduce__(self):
        return Model, (self.weights, self.chain)

    @classmethod
    def load(cls) -> Model:
        m = json.loads(Path(__file__).with_name("crf_weights.json").read_text())
        return cls(m["weights"], Chain(*(np.array(m[k]) for k in ("trans", "start", "end"))))

    def _text(self, text: str, name: str) -> float:
        key = (text, name)
        if key not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            names, words = text_shape(text, name)
            get = self.weights.get
            value = sum([get(f, 0.0) for f in names])
            if words:
                word, pair = self._word.get, self._pair.get
                value += sum([word(w, 0.0) for w in words]) + self._first.get(words[0], 0.0)
                value += sum([pair(p, 0.0) for p in zip(words, words[1:])])
            if len(text) > 160:
                return value
            self._known[key] = value
        return self._known[key]

    def _place(self, k: int, n: int, title: bool, code: bool) -> float:
        key = (min(k, 4), min(n - k, 5), title, code)
        if key not in self._places:
            self._places[key] = sum(self.weights.get(f, 0.0) for f in place_features(k, n, title, code))
        return self._places[key]

    def _tags(self, anc: tuple[str, ...], density: float) -> float:
        key = (anc, round(density * 4))
        if key not in self._places:
            if len(self._places) > 50_000:
                self._places.clear()
            self._places[key] = sum(self.weights.get(f, 0.0) for f in tag_features(anc, density))
        return self._places[key]

    def score_markdown(self, units: list[tuple[int, str, bool]], name: str) -> list[float]:
        n, title, out = len(units), False, []
        base = self.weights.get("is_md", 0.0)
        for k, (_, line, code) in enumerate(units):
            out.append(base + self._text(line, name) + self._place(k, n, title, code))
            title = title or (line.startswith("#") and not code)
        return out

    def score_html(self, units: list[tuple[str, tuple[str, ...], float]], name: str) -> list[float]:
        n, title, out = len(units), False, []
        base = self.weights.get("is_html", 0.0)
        for k, (text, anc, density) in enumerate(units):
            out.append(base + self._text(text, name) + self._place(k, n, title, False) + self._tags(anc, density))
            title = title or "h1" in anc or "h2" in anc
        return out

    def label_html(self, units: list, name: str) -> np.ndarray:
        """Labels without site counts."""
        score = np.array(self.score_html(units, name)) + self.repeat[1]
        return viterbi(score, np.array([len(score)]), self.chain)


def unit_key(host: str, text: str) -> int:
    """64-bit key of a unit within its site: markup, digits and case left out."""
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    bare = _DIGITS.sub("#", text.lstrip(" >*_#-+").rstrip(" *_").lower())
    return xxhash.xxh64_intdigest(host + "\n" + bare) - (1 << 63)


_ROWS = "tab string, rec_id long, score array<float>, key array<long>, md5 array<binary>, extra array<binary>, failed boolean, title long"


def scored(df: DataFrame, tab: str, id_col: str, text_col: str, kind: str, extra=None, hashes: bool = True, judge=None) -> DataFrame:
    """One row for each page: scores, keys and md5 of its units in order. extra: from the units (of html: their texts to be shown) of many pages in one list, the bytes to
    keep with each; pages without any unit come out as well then. judge: for
    html, a test of the text of the content (labels without site counts) and of noscript elements, kept as
    `failed`; pages without any unit come out as well then."""
    shared = df.sparkSession.sparkContext.broadcast(Model.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[], [], [], [], [], [], []]
                every: list = []
                for i, host, page in zip(*(part.column(k).to_pylist() for k in range(3))):
                    host, bad = host or "", False
                    name = site_word(host)
                    if kind == "html":
                        shown: list[str] | None = [] if extra else None
                        units = html_units(page, noscript=judge is not None, shown=shown)
                        quiet = [u[0] for u in units if "noscript" in u[1]]
                        units = [u for u in units if "noscript" not in u[1]] if quiet else units
                        texts = [u[0] for u in units]
                        score = model.score_html(units, name)
                        if judge:
                            own = viterbi(np.array(score) + model.repeat[1], np.array([len(score)]), model.chain) if score else []
                            bad = judge(" ".join([t for t, y in zip(texts, own) if not y] + quiet))
                    else:
                        units = markdown_units(page)
                        texts = [u[1] for u in units]
                        score = model.score_markdown(units, name)
                    if not texts and not judge and not extra:
                        continue
                    cols[5].append(bad)
                    named = page_title(units, kind)
                    cols[6].append(unit_key(host, named) if named else xxhash.xxh64_intdigest(f"{tab} {i}") - (1 << 63))
                    cols[0].append(i)
                    cols[1].append(score)
                    cols[2].append([unit_key(host, t) for t in texts])
                    cols[3].append([hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts] if hashes else [])
                    if extra:
                        every += shown[: len(units)] if kind == "html" else units
                if extra:
                    kept, k = extra(every), 0
                    for score in cols[1]:
                        cols[4].append(kept[k : k + len(score)])
                        k += len(score)
                else:
                    cols[4] = [[]] * len(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tab] * len(cols[0]), pa.string()),
                        pa.array(cols[0], pa.int64()),
                        pa.array(cols[1], pa.list_(pa.float32())),
                        pa.array(cols[2], pa.list_(pa.int64())),
                        pa.array(cols[3], pa.list_(pa.binary())),
                        pa.array(cols[4], pa.list_(pa.binary())),
                        pa.array(cols[5], pa.bool_()),
                        pa.array(cols[6], pa.int64()),
                    ],
                    names=["tab", "rec_id", "score", "key", "md5", "extra", "failed", "title"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("i"), site(F.col("url")).alias("s"), F.col(text_col).alias("p"))
    return spread(rows.filter("i is not null and p is not null and p <> ''")).mapInArrow(run, _ROWS)


def with_counts(rows: DataFrame) -> DataFrame:
    """rows (written) with `seen`: (place, titles of the site) of each unit that is under several. A unit
    of a third of all pages is one key here: counts are aggregated before the shuffle, and the way back is
    an equi-join that the adaptive skew join splits."""
    spots = rows.select("tab", "rec_id", F.posexplode("key").alias("place", "k"))
    once = rows.select("title", F.explode(F.array_distinct("key")).alias("k")).distinct()
    counts = once.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    seen = (
        spots.join(counts, "k")
        .groupBy("tab", "rec_id")
        .agg(F.collect_list(F.struct("place", "n")).alias("seen"))
    )
    return rows.join(seen, ["tab", "rec_id"], "left")


def decode(rows: DataFrame, emit, schema: str) -> DataFrame:
    """Viterbi over each page; emit(row, labels) gives the output rows of a page as tuples."""
    shared = rows.sparkSession.sparkContext.broadcast(Model.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        edges = np.array([2, 3, 5, 20])
        step = np.array([model.repeat[k] for k in (1, 2, 3, 5, 20)])
        target = None
        for batch in batches:
            lengths = batch.column("score").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            score = batch.column("score").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(lengths) - lengths
            count = np.ones(len(score), dtype=np.int64)
            seen = batch.column("seen")
            sizes = np.nan_to_num(seen.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = seen.flatten()
            if len(flat):
                place = flat.field("place").to_numpy(zero_copy_only=False)
                count[np.repeat(begin, sizes) + place] = flat.field("n").to_numpy(zero_copy_only=False)
            labels = viterbi(score + step[np.searchsorted(edges, count, side="right")], lengths, model.chain)
            cols = {c: batch.column(c).to_pylist() for c in ("tab", "rec_id", "md5", "extra")}
            rows_out = []
            for k in range(batch.num_rows):
                y = labels[begin[k] : begin[k] + lengths[k]]
                rows_out += emit(cols["tab"][k], cols["rec_id"][k], cols["md5"][k], cols["extra"][k], y)
            frame = pd.DataFrame(rows_out, columns=names)
            target = pa.schema(types)
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]
    names = [n for n, _ in types]
    return rows.select("tab", "rec_id", "score", "md5", "extra", "seen").mapInArrow(run, schema)


def _site_units(tab, rec, md5, extra, labels):
    own = {h for h, y in zip(md5, labels) if not y}
    return [(tab, rec, h.hex()) for h in {h for h, y in zip(md5, labels) if y} - own]


def boilerplate_units(parsed: DataFrame, raw: DataFrame, without: DataFrame | None = None, judge=None) -> DataFrame:
    """(tab, rec_id, unit_md5) of the distinct units that are not the page's own, over both tables.
    without: (tab, rec_id) of records left out; judge: a test for pages left out (see scored)."""
    rows = scored(parsed, "parsed_documents", "parsed_id", "markdown", "md").unionByName(
        scored(raw, "raw_pages", "page_id", "html", "html", judge=judge)
    )
    rows = with_counts(written(rows)).filter("not failed")
    if without is not None:
        rows = rows.join(without, ["tab", "rec_id"], "left_anti")
    return decode(rows, _site_units, "tab string, rec_id long, unit_md5 string")


def main_text(parsed: DataFrame) -> DataFrame:
    """(parsed_id, text): the lines of each document's own content, in order."""
    rows = with_counts(written(scored(parsed, "parsed_documents", "parsed_id", "markdown", "md", hashes=False, extra=_line_no)))
    return _without_lines(parsed, decode(rows, _bad_lines, "parsed_id long, line_no int"))


def main_texts(parsed: DataFrame, raw: DataFrame) -> DataFrame:
    """(tab, rec_id, text) over both tables, with the labels of boilerplate_units: the lines of each
    document's own content, and the units of each page's own content, one a line, in order. Null stays
    null; a page without content of its own gives ''."""
    rows = scored(parsed, "parsed_documents", "parsed_id", "markdown", "md", hashes=False, extra=_line_no).unionByName(
        scored(raw, "raw_pages", "page_id", "html", "html", hashes=False, extra=_utf8)
    )
    found = written(decode(with_counts(written(rows)), _own_text, "tab string, rec_id long, line_no int, text string"))
    bad = found.filter("tab = 'parsed_documents'").select(F.col("rec_id").alias("parsed_id"), "line_no")
    docs = _without_lines(parsed, bad).select(F.lit("parsed_documents").alias("tab"), F.col("parsed_id").alias("rec_id"), "text")
    pages = found.filter("tab = 'raw_pages'").select("tab", "rec_id", "text")
    blank = raw.filter("html is null or html = ''").select(F.lit("raw_pages").alias("tab"), F.col("page_id").alias("rec_id"), F.col("html").alias("text"))
    return docs.unionByName(pages).unionByName(blank)


def _without_lines(parsed: DataFrame, bad: DataFrame) -> DataFrame:
    """(parsed_id, text): the markdown of parsed without the lines (parsed_id, line_no) of bad."""
    bad = bad.groupBy("parsed_id").agg(F.collect_list("line_no").alias("drop"))
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    lines = F.split(F.col("markdown"), "\n", -1)
    return parsed.select("parsed_id", "markdown").join(bad, "parsed_id", "left").select(
        "parsed_id", F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n").alias("text")
    )


def _line_no(units: list) -> list[bytes]:
    return [b"%d" % u[0] for u in units]


def _bad_lines(tab, rec, md5, extra, labels):
    return [(rec, int(x)) for x, y in zip(extra, labels) if y]


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def _own_text(tab, rec, md5, extra, labels):
    if tab == "parsed_documents":
        return [(tab, rec, line, None) for _, line in _bad_lines(tab, rec, md5, extra, labels)]
    return [(tab, rec, None, "\n".join(x.decode() for x, y in zip(extra, labels) if not y))]
