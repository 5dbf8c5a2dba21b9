"""Language of documents and of the segments of mixed ones, by nearest centroid.

Sentences are TF-IDF vectors of hashed character n-grams (2 and 3, with word boundaries), normalised. Each
language has several centroids, clustered (spherical k-means) from the sentences of every labelled sample text:
the sentences are written once as n-gram counts, and each step is one pass over them of which only centroids
(or one sentence for each language) come to the driver. Sums are of whole parts, so that no order of rows
changes them. A sentence is as similar to a language as its nearest centroid by cosine. A sentence nearer to none than
REJECT is rejected: it neither begins nor ends a segment. Over the sentences of a document the best path
is taken that pays SWITCH for each change of language, so that a weak sentence follows its neighbours.

A sentence ends at a mark followed by white space; what follows the last mark of a line and is shorter
than six words belongs to the sentence before. Lines of the site (by the CRF of boilerplate.py), headings
and code count for none.

The dot products of a sentence are the sums of those of its words, kept for each word, so that a word is
cut into n-grams once for each task; norms are exact.

Defined results: null and empty texts, and texts without a sentence that is accepted, have no segment; an
empty table gives an empty result; label parts are compared before '-' or '_', in any case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import site
from millrace.llm.boilerplate import Model
from millrace.llm.crf import viterbi
from millrace.llm.units import markdown_units, site_word
from millrace.session import spread, written

DIM_BITS, ORDERS, CENTROIDS, ROUNDS = 16, (2, 3), 3, 10
#: Whole parts of a weight in which the sums of centroids are counted.
PARTS = 1 << 30
REJECT, SWITCH = 0.2, 0.2
SENTENCE = re.compile(r"(?<=[.!?؟…۔])[\"'»”)]*\s+")
_STOPS = re.compile(r"[.!?؟…۔][\"'»”)]*\s*$")
_MARKED = re.compile(r"[\[*_`>#]|https?:")
_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)|https?://\S+|[*_`>#]+")


def sentences(line: str) -> list[str]:
    """Sentences of a line, a short rest joined to the one before."""
    if _MARKED.search(line):
        line = _LINK.sub(r"\1", line)
    parts = [p for p in SENTENCE.split(line) if p]
    if len(parts) > 1 and not _STOPS.search(parts[-1]) and len(parts[-1].split()) < 6:
        parts[-2:] = [parts[-2] + " " + parts[-1]]
    return parts


def _grams(word: str) -> np.ndarray:
    w = f" {word} "
    out = [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]
    return np.array([xxhash.xxh32_intdigest(g) >> (32 - DIM_BITS) for g in out], dtype=np.int32)


#: Sentences of labelled texts: the distinct n-grams with their counts. head: the text, at its first sentence.
_COUNTED = pa.schema([("lang", pa.string()), ("head", pa.string()), ("sentence", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def counted(langs: list[str], texts: list[str]) -> pa.RecordBatch:
    out: list[tuple] = []
    for lang, text in zip(langs, texts):
        head: str | None = text
        for line in text.split("\n"):
            for s in sentences(line):
                if words := _WORD.findall(s.lower()):
                    at, n = np.unique(np.concatenate([_grams(w) for w in words]), return_counts=True)
                    out.append((lang, head, s, at, n.astype(np.int32)))
                    head = None
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), _COUNTED)] if out else [pa.array([], f.type) for f in _COUNTED], schema=_COUNTED)


class Steps:
    """One step of k-means over a batch of counted sentences. rows: k for each language (rows of zeros are none)."""

    def __init__(self, langs: list[str], idf: np.ndarray, k: int, rows: np.ndarray):
        self.langs, self.idf, self.k, self.rows = langs, idf, k, rows

    def _near(self, batch: pa.RecordBatch):
        number = {lang: i for i, lang in enumerate(self.langs)}
        own = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
        sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = batch.column("at").flatten().to_numpy(zero_copy_only=False)
        value = batch.column("n").flatten().to_numpy(zero_copy_only=False) * self.idf[at].astype(np.float64)
        begin = np.cumsum(sizes) - sizes
        value /= np.repeat(np.sqrt(np.add.reduceat(value * value, begin)), sizes)
        first, none = np.repeat(own * self.k, sizes), ~self.rows.any(axis=1)
        cosine = [np.where(none[own * self.k + j], -1, np.add.reduceat(self.rows[first + j, at] * value, begin)) for j in range(self.k)]
        return own, sizes, at, value, np.round(np.stack(cosine), 9)

    def farthest(self, batch: pa.RecordBatch) -> list[tuple]:
        """(lang, near, sentence, at, n) of the sentence of each language that is farthest from its centroids."""
        if not batch.num_rows:
            return []
        own, _, _, _, cosine = self._near(batch)
        near, text, best = cosine.max(axis=0).tolist(), batch.column("sentence").to_pylist(), {}
        for i, lang in enumerate(own.tolist()):
            if lang not in best or (near[i], text[i]) < (near[best[lang]], text[best[lang]]):
                best[lang] = i
        return [(self.langs[lang], near[i], text[i], *(batch.column(c)[i].as_py() for c in ("at", "n"))) for lang, i in best.items()]

    def sums(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the sentences nearest to each centroid: places (centroid and dimension) and PARTS."""
        if not batch.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own, sizes, at, value, cosine = self._near(batch)
        place, inverse = np.unique((np.repeat(own * self.k + cosine.argmax(axis=0), sizes) << DIM_BITS) + at, return_inverse=True)
        out = np.zeros(len(place), dtype=np.int64)
        np.add.at(out, inverse, np.rint(value * PARTS).astype(np.int64))
        return place, out


class Centroids:
    """Languages, centroids (one row each), their language numbers, and idf."""

    def __init__(self, langs: list[str], rows: np.ndarray, owner: np.ndarray, idf: np.ndarray):
        self.langs, self.rows, self.owner, self.idf = langs, rows, owner, idf
        self._words: dict[str, int] = {}
        self._grams: list[np.ndarray] = []
        self._dots: list[np.ndarray] = []

    def __reduce__(self):
        return Centroids, (self.langs, self.rows, self.owner, self.idf)

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], k: int = CENTROIDS, rounds: int = ROUNDS) -> Centroids:
        batch = counted([lang for lang, _ in samples], [text for _, text in samples])
        starts: dict[str, tuple] = {}
        for r in batch.to_pylist():
            if r["head"] is not None and (r["lang"] not in starts or r["head"] < starts[r["lang"]][0]):
                starts[r["lang"]] = (r["head"], r["at"], r["n"])
        df = np.bincount(batch.column("at").flatten().to_numpy(zero_copy_only=False), minlength=1 << DIM_BITS)
        return cls.clustered(
            batch.num_rows, df, {lang: x[1:] for lang, x in starts.items()}, lambda s: s.farthest(batch), lambda s: s.sums(batch), k, rounds
        )

    @classmethod
    def clustered(
        cls, n: int, df: np.ndarray, starts: dict[str, tuple], farthest: Callable[[Steps], list[tuple]],
        sums: Callable[[Steps], tuple[np.ndarray, np.ndarray]], k: int = CENTROIDS, rounds: int = ROUNDS,
    ) -> Centroids:
        """From the number of sentences, that of the sentences with each n-gram, a first sentence (at, n) for each
        language, and Steps over all sentences."""
        langs, dims = sorted(starts), 1 << DIM_BITS
        idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        rows = np.zeros((len(langs) * k, dims))

        def put(row: int, at, n) -> None:
            rows[row, at] = n * idf[at].astype(np.float64)
            rows[row] /= max(float(np.linalg.norm(rows[row])), 1e-9)

        # Farthest-first start: the same at every run.
        for lang, (at, m) in starts.items():
            put(langs.index(lang) * k, np.array(at), np.array(m))
        for j in range(1, k if langs else 0):
            for lang, near, _, at, m in farthest(Steps(langs, idf, k, rows)):
                if near < 1:  # else every sentence is one of the centroids
                    put(langs.index(lang) * k + j, np.array(at), np.array(m))
        last = None
        for _ in range(rounds if langs else 0):
            place, value = sums(Steps(langs, idf, k, rows))
            now = np.zeros(len(rows) * dims, dtype=np.int64)
            now[place] = value
            if last is not None and (now == last).all():
                break  # every further round would give these centroids again
            last, now = now, now.reshape(len(rows), dims).astype(np.float64)
            some = now.any(axis=1)
            rows[some] = now[some] / np.linalg.norm(now[some], axis=1)[:, None]
        some = rows.any(axis=1)
        return cls(langs, rows[some].astype(np.float32), np.repeat(np.arange(len(langs)), k)[some], idf)

    def _word(self, w: str) -> int:
        n = self._words.get(w)
        if n is None:
            g = _grams(w)
            n = self._words[w] = len(self._grams)
            self._grams.append(g)
            self._dots.append((self.rows[:, g] * self.idf[g]).sum(axis=1))
        return n

    def similar(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text to each language's nearest centroid (texts by languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        if len(self._grams) > 200_000:
            self._words, self._grams, self._dots = {}, [], []
        spelled, sizes = [], np.zeros(len(texts), dtype=np.int64)
        find = _WORD.findall
        for i, t in enumerate(texts):
            own = find(t.lower())
            sizes[i] = len(own)
            spelled += own
        if not spelled or not self.langs:
            return out
        words = list(map(self._words.get, spelled))
        if None in words:
            words = [self._word(w) if n is None else n for w, n in zip(spelled, words)]
        words = np.array(words)
        owner = np.repeat(np.arange(len(texts)), sizes)
        some = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[some]
        known, inverse = np.unique(words, return_inverse=True)
        dots = np.stack([self._dots[w] for w in known])
        dot = np.add.reduceat(dots[inverse], begin, axis=0)
        lengths = np.array([len(self._grams[w]) for w in known])
        flat = np.concatenate([self._grams[w] for w in known])
        first = np.cumsum(lengths) - lengths
        n = lengths[inverse]
        at = np.repeat(first[inverse] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bits = np.int64 if len(texts) >= 1 << (31 - DIM_BITS) else np.int32
        key = np.sort(np.repeat(owner.astype(bits) << DIM_BITS, n) | flat[at])
        new = np.flatnonzero(np.diff(key, prepend=bits(-1)))
        tf = np.diff(new, append=len(key))
        key = key[new]
        value = (tf * self.idf[key & bits((1 << DIM_BITS) - 1)]) ** 2
        norm = np.sqrt(np.bincount(key >> DIM_BITS, weights=value, minlength=len(texts)))[some]
        cosine = dot / np.maximum(norm, 1e-9)[:, None]
        for lang in range(len(self.langs)):
            out[some, lang] = cosine[:, self.owner == lang].max(axis=1)
        return out


def best_path(cosine: np.ndarray) -> np.ndarray:
    """Language number of each sentence (-1: rejected) of one document."""
    clear = cosine.max(axis=1) >= REJECT
    path = np.full(len(cosine), -1, dtype=np.int64)
    c = cosine[clear]
    if not len(c):
        return path
    if (c.argmax(axis=1) == c[0].argmax()).all():
        path[clear] = c[0].argmax()
        return path
    best, back = c[0].copy(), []
    for row in c[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    at = int(best.argmax())
    own = [at]
    for b in reversed(back):
        at = int(b[at])
        own.append(at)
    path[clear] = own[::-1]
    return path


def segments_of(cosine: np.ndarray, langs: list[str]) -> list[tuple[str, float, int]]:
    """(language, confidence, sentences) of each segment. Confidence: mean share by which the cosine
    exceeds that of the next best language."""
    if not langs:
        return []
    path = best_path(cosine)
    keep = path >= 0
    path, c = path[keep], cosine[keep]
    out = []
    starts = np.flatnonzero(np.diff(path, prepend=-2))
    for s, e in zip(starts, [*starts[1:], len(path)]):
        lang = path[s]
        own = c[s:e, lang]
        rest = np.delete(c[s:e], lang, axis=1)
        next_best = rest.max(axis=1) if rest.shape[1] else np.zeros(e - s)
        out.append((langs[lang], float(np.clip(1 - next_best / np.maximum(own, 1e-9), 0, 1).mean()), int(e - s)))
    return out


_NAMES = ["parsed_id", "seg_no", "lang", "confidence", "n_sentences"]
_ARROW = pa.schema(list(zip(_NAMES, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32()))))


def fit(samples: DataFrame) -> Centroids:
    """From every labelled text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield counted(part.column("language").to_pylist(), part.column("text").to_pylist())

    texts = samples.select("language", "text").filter("language is not null and text is not null")
    kinds = "lang string, head string, sentence string, at array<int>, n array<int>"
    rows = written(texts.mapInArrow(cut, kinds))
    starts = {r[0]: (r[1]["at"], r[1]["n"]) for r in rows.filter("head is not null").groupBy("lang").agg(F.min_by(F.struct("at", "n"), "head")).collect()}
    df = np.zeros(1 << DIM_BITS, dtype=np.int64)
    for at, n in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[at] = n

    def over_all(name: str, steps: Steps, kinds: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if name == "sums":
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in shared.value.sums(batch)], names=["place", "value"])
                elif found := shared.value.farthest(batch):
                    types = [pa.string(), pa.float64(), *(f.type for f in list(_COUNTED)[2:])]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), types)], names=["lang", "near", "sentence", "at", "n"])

        return rows.mapInArrow(run, kinds)

    def farthest(steps: Steps) -> list[tuple]:
        each = over_all("farthest", steps, "lang string, near double, sentence string, at array<int>, n array<int>")
        least = each.groupBy("lang").agg(F.min(F.struct("near", "sentence", "at", "n")).alias("x"))  # one row for each language
        return [(r["lang"], *r["x"]) for r in least.collect()]

    def sums(steps: Steps) -> tuple[np.ndarray, np.ndarray]:
        each = over_all("sums", steps, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        return each.column("place").to_numpy(), each.column("value").to_numpy()

    return Centroids.clustered(rows.count(), df, starts, farthest, sums)


def segments(parsed: DataFrame, samples: DataFrame) -> DataFrame:
    """(parsed_id, seg_no, lang, confidence, n_sentences) of every document. One pass, nothing shuffled:
    the lines of the site are told by the CRF without site counts."""
    shared = parsed.sparkSession.sparkContext.broadcast((fit(samples), Model.load()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, crf = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, pages, score = [], [], []
                for i, host, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    units = markdown_units(text)
                    if units:
                        ids.append(i)
                        pages.append(units)
                        score += crf.score_markdown(units, site_word(host or ""))
                lengths = np.array([len(u) for u in pages], dtype=np.int64)
                labels = viterbi(np.array(score) + crf.repeat[1], lengths, crf.chain).tolist() if score else []
                texts, sizes, k = [], [], 0
                for units in pages:
                    n = len(texts)
                    for (_, line, code), y in zip(units, labels[k : k + len(units)]):
                        if not (y or code or line[:1] == "#"):
                            texts += sentences(line)
                    k += len(units)
                    sizes.append(len(texts) - n)
                cosine, k, out = near.similar(texts), 0, []
                for i, n in zip(ids, sizes):
                    if n:
                        out += [(i, s, *seg) for s, seg in enumerate(segments_of(cosine[k : k + n], near.langs))]
                    k += n
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_NAMES), schema=_ARROW, preserve_index=False)

    rows = parsed.select(F.col("parsed_id").cast("long").alias("i"), site(F.col("url")).alias("s"), F.col("markdown").alias("t"))
    return spread(rows.filter("i is not null and t is not null and t <> ''")).mapInArrow(
        run, "parsed_id long, seg_no int, lang string, confidence double, n_sentences int"
    )


def label_language(label: Column) -> Column:
    """Language code of a label; null if the label says none."""
    base = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(~base.isin("", "und"), base)


def relabelled(parsed: DataFrame, segs: DataFrame) -> DataFrame:
    """(parsed_id, seg_no, lang) of the records that mix languages, or whose label is missing or wrong."""
    whole = segs.groupBy("parsed_id").agg(F.max("seg_no").alias("last"), F.min("lang").alias("only"))
    labels = parsed.select(F.col("parsed_id").cast("long").alias("parsed_id"), label_language(F.col("language")).alias("label"))
    odd = whole.join(labels, "parsed_id").filter((F.col("last") > 0) | F.col("label").isNull() | (F.col("label") != F.col("only")))
    return segs.join(odd.select("parsed_id"), "parsed_id", "left_semi").select("parsed_id", "seg_no", "lang")
