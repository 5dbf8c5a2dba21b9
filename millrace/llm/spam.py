"""Keyword-stuffed and link-list pages, by their rank-frequency curves and their distance from prose.

One pass counts the tokens of each page (words, sentence marks and bare addresses; a link counts by its
text) and hands on
only how many tokens occur how often: the rank-frequency curve with ties at their mid rank, fitted by SQL
windows over about ten rows for each page. The divergence is that of the page's token distribution from
the prose of its language; a page in several languages is held against their mixture, weighted by how
much of the page the sample texts of each cover. Slope,
residual and divergence all change with length, so each is compared with the line through the medians of
its language over length classes, drawn towards the line over all languages by the weight of SHRINK pages; the scale is the median absolute deviation. Pages of every length are
scored: under STEADY tokens the deviation asked for grows with the scatter of so few tokens. A page of
links is told by their number against its words, at every length.

Defined results: null and empty pages and pages without any token are never flagged; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import spread, written

#: Tokens under which the measures scatter by the root of STEADY over their number more than above.
STEADY = 50
#: Pages of a language at which its own line weighs as much as the line over all languages.
SHRINK = 30
#: Deviations from which a page is extreme, and the least distance in nats that counts for divergence.
DIVERGENCE_AT, CURVE_AT, LEAST_NATS, LEAST_SLOPE = 6.0, 9.0, 2.0, 0.45
_TOKEN = re.compile(r"<url>|[^\W_]+|[.!?؟…۔](?=\s|$)|[|·/#,;:—»•]")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_URL = re.compile(r"https?://\S+")
UNSEEN = math.log(0.2 / 3000)


def tokens(markdown: str) -> list[str]:
    return _TOKEN.findall(_URL.sub(" <url> ", _LINK.sub(r"\1", markdown)).lower())


def link_list(markdown: str, counts: Counter, links: int) -> bool:
    """Whether links stand in place of words: more bare addresses than words, or, without any sentence,
    more links of the text or of the page than words outside them."""
    words = sum(k for w, k in counts.items() if w[0].isalnum())
    if counts["<url>"] > words:
        return True
    if any(w in counts for w in ".!?؟…۔"):
        return False
    inside = _LINK.findall(markdown)
    words -= sum(w[0].isalnum() for t in inside for w in tokens(t))
    return max(counts["<url>"] + len(inside), links) > words


def prose_models(samples: DataFrame) -> dict[str, dict[str, float]]:
    """Log-probabilities of tokens by language, from every labelled sample text. Tokens are counted where the
    texts are; only the counts come to the driver, one row for each language and token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own: dict[str, Counter] = {}
            for language, text in zip(pdf["language"].tolist(), pdf["text"].tolist()):
                own.setdefault(language, Counter()).update(tokens(text))
            yield pd.DataFrame([(l, w, k) for l, c in own.items() for w, k in c.items()], columns=["language", "token", "n"])

    rows = samples.select("language", "text").filter("language is not null and text is not null")
    sums = rows.mapInPandas(run, "language string, token string, n long").groupBy("language", "token").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for language, token, k in sorted(sums.collect(), key=lambda r: (r["language"], -r["n"], r["token"])):
        counts.setdefault(language, {})[token] = k
    every = {l: sum(c.values()) * 1.25 for l, c in counts.items()}
    return {l: {w: math.log(k / every[l]) for w, k in c.items()} for l, c in sorted(counts.items())}


def divergence(counts: Counter, n: int, models: list[tuple[int, dict[str, float]]]) -> float:
    """Nats from the mixture of the models, weighted by their hits, to the counts."""
    if len(models) == 1:
        get = models[0][1].get
        return sum(k * (math.log(k / n) - get(w, UNSEEN)) for w, k in counts.items()) / n
    total = sum(h for h, _ in models) or 1
    parts = [(math.log(max(h, 1) / total), q) for h, q in models]
    out = 0.0
    for w, k in counts.items():
        best = max((a + q[w] for a, q in parts if w in q), default=UNSEEN)
        out += k * (math.log(k / n) - best)
    return out / n


def curves(parsed: DataFrame, samples: DataFrame, id_col: str = "parsed_id", text_col: str = "markdown") -> DataFrame:
    """(id, lang, n_tokens, divergence, links, link_list, slope, residual) of every page with a token."""
    shared = parsed.sparkSession.sparkContext.broadcast(prose_models(samples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        langs, where = list(models), {}
        for k, lang in enumerate(langs):
            for w in models[lang]:
                where[w] = (*where.get(w, ()), k)
        for pdf in batches:
            out = []
            for i, text, links in zip(pdf["id"].tolist(), pdf["text"].tolist(), pdf["links"].tolist()):
                c = Counter(tokens(text))
                n = sum(c.values())
                if not n:
                    continue
                held = [0] * len(langs)
                for w in c.keys() & where.keys():
                    for k in where[w]:
                        held[k] += c[w]
                hits = dict(zip(langs, held))
                best = max(hits, key=hits.get) if hits else "und"
                kl = divergence(c, n, [(h, models[lang]) for lang, h in hits.items() if 5 * h >= hits[best]])
                if 20 * hits.get(best, 0) < n:
                    best = "und"  # in no known language: no page to compare others with
                times = Counter(c.values())
                out.append((i, best, n, kl, links, link_list(text, c, links), list(times.keys()), list(times.values())))
            yield pd.DataFrame(out, columns=["id", "lang", "n_tokens", "divergence", "links", "link_list", "often", "kinds"])

    rows = parsed.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.size("extracted_links"), F.lit(0)).cast("long").alias("links"),
    ).filter("id is not null and text is not null and text <> ''")
    schema = "id long, lang string, n_tokens long, divergence double, links long, link_list boolean, often array<long>, kinds array<long>"
    pages = spread(rows).mapInPandas(run, schema)
    points = pages.select(
        "id", "lang", "n_tokens", "divergence", "links", "link_list", F.explode(F.arrays_zip("often", "kinds")).alias("p")
    ).select("id", "lang", "n_tokens", "divergence", "links", "link_list", F.col("p.often").alias("often"), F.col("p.kinds").alias("kinds"))
    down = Window.partitionBy("id").orderBy(F.desc("often"))
    x = F.log(F.sum("kinds").over(down) - (F.col("kinds") - 1) / 2)
    y, w = F.log("often"), F.col("kinds")
    s = points.select("*", x.alias("x"), y.alias("y")).groupBy("id", "lang", "n_tokens", "divergence", "links", "link_list").agg(
        F.sum(w).alias("sw"),
        F.sum(w * F.col("x")).alias("sx"),
        F.sum(w * F.col("y")).alias("sy"),
        F.sum(w * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(w * F.col("x") * F.col("y")).alias("sxy"),
        F.sum(w * F.col("y") * F.col("y")).alias("syy"),
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    vxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    slope = F.when(vx > 1e-9, vxy / vx).otherwise(F.lit(0.0))
    left = F.sqrt(F.greatest(vy - slope * vxy, F.lit(0.0)) / F.col("sw"))
    return s.select("id", "lang", "n_tokens", "divergence", "links", "link_list", slope.alias("slope"), left.alias("residual"))


def deviations(pages: DataFrame) -> DataFrame:
    """pages with how far each measure lies from the line of its language at its length, in measure and
    in deviations."""
    at = F.floor(F.log2("n_tokens") * 2) / 2
    pages = pages.withColumn("at", at)
    measures = ("slope", "residual", "divergence")
    med = pages.filter("lang <> 'und'").groupBy("lang", "at").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, 0.5, 1000).alias(m) for m in measures]
    )
    # A weighted line through the medians (languages times length classes: a few hundred rows).
    def line(by: list[str], name: str) -> DataFrame:
        n, x = F.col("n").cast("double"), F.col("at") + 0.25
        aggs = [F.sum(n).alias("sn"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx")]
        for m in measures:
            aggs += [F.sum(n * F.col(m)).alias(f"sy_{m}"), F.sum(n * x * F.col(m)).alias(f"sxy_{m}")]
        d = F.col("sn") * F.col("sxx") - F.col("sx") * F.col("sx")
        out = [*by, F.col("sn").alias(f"{name}_n")]
        for m in measures:
            b = F.when(d > 1e-9, (F.col("sn") * F.col(f"sxy_{m}") - F.col("sx") * F.col(f"sy_{m}")) / d).otherwise(F.lit(0.0))
            out += [b.alias(f"{name}_b_{m}"), ((F.col(f"sy_{m}") - b * F.col("sx")) / F.col("sn")).alias(f"{name}_a_{m}")]
        return (med.groupBy(*by) if by else med).agg(*aggs).select(*out)

    own, every = line(["lang"], "own"), line([], "all")
    joined = pages.join(F.broadcast(own), "lang", "left").crossJoin(F.broadcast(every))  # one row for each language; one row
    x = F.log2("n_tokens")
    trust = F.coalesce(F.col("own_n") / (F.col("own_n") + SHRINK), F.lit(0.0))
    for m in measures:
        a, b = (trust * F.coalesce(f"own_{k}_{m}", F.lit(0.0)) + (1 - trust) * F.col(f"all_{k}_{m}") for k in "ab")
        joined = joined.withColumn(f"{m}_off", F.col(m) - a - b * x)
    return joined.select(*pages.drop("at").columns, *[f"{m}_off" for m in measures])


def spam_pages(pages: DataFrame) -> DataFrame:
    """(id, slope_z, residual_z, divergence_z, flagged): pages is the result of curves."""
    off = deviations(pages)
    scale = off.agg(
        *[F.percentile_approx(F.when(F.col("lang") != "und", F.abs(f"{m}_off")), 0.5, 1000).alias(f"{m}_mad") for m in ("slope", "residual", "divergence")]
    )
    floor = {"slope": 0.03, "residual": 0.02, "divergence": 0.2}
    z = off.crossJoin(F.broadcast(scale))  # one row
    # Without any page to compare with (all are in no known language), the fixed prose model speaks alone.
    for m in floor:
        z = z.withColumn(f"{m}_off", F.coalesce(f"{m}_off", F.col(m))).withColumn(f"{m}_mad", F.coalesce(f"{m}_mad", F.lit(0.0)))
    for m, least in floor.items():
        z = z.withColumn(f"{m}_z", F.col(f"{m}_off") / F.greatest(F.col(f"{m}_mad") * 1.4826, F.lit(least)))
    wide = F.sqrt(F.lit(STEADY) / F.least("n_tokens", F.lit(STEADY)))
    flagged = (
        F.col("link_list")
        | ((F.col("divergence_z") > DIVERGENCE_AT * wide) & (F.col("divergence_off") > LEAST_NATS * wide))
        | ((F.col("slope_z") < -CURVE_AT * wide) & (F.col("slope_off") < -LEAST_SLOPE * wide))
        | ((F.col("residual_z") > CURVE_AT * wide) & (F.col("divergence_off") > LEAST_NATS / 2 * wide))
        | (F.col("residual_z") > 2 * CURVE_AT * wide)
    )
    return z.select("id", "lang", "n_tokens", "slope_z", "residual_z", "divergence_z", flagged.alias("flagged"))


def spam_cases(parsed: DataFrame, samples: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(parsed_id) of the flagged pages; records in `without` (failed pages) neither count nor come out."""
    pages = curves(parsed, samples)
    if without is not None:
        pages = pages.join(without.select(F.col("parsed_id").alias("id")), "id", "left_anti")
    return spam_pages(written(pages)).filter("flagged").select(F.col("id").alias("parsed_id"))
