"""Train the CRF of boilerplate.py: python -m millrace.llm.train_boilerplate DATA_DIR

Pages are labelled by recurrence over sites: a line is the site's if its form, with digits, rare words and
the site's own name masked, recurs on many sites; or if it ends in no sentence mark and its masked first
two words do; or if the very line recurs under a fair part of the titles of its own site. Everything else is the page's.
The bound on labelled pages is MAX_PAGES. Writes crf_weights.json beside this file."""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb

from millrace.llm import crf
from millrace.llm.residue import MESSAGES, PLACEHOLDER
from millrace.llm.spam import divergence, tokens
from millrace.llm.units import (
    WORD, html_units, markdown_units, page_title, place_features, repeat_feature, site_word, tag_features, text_features,
)

MAX_PAGES = 12_000
SITES, PREFIX_SITES, RARE = 5, 4, 40
OUT = Path(__file__).with_name("crf_weights.json")
_HOST = re.compile(r"^\s*[a-z]+://(?:[^/@]*@)?([^/:?#]*)", re.I)
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_DECOR = re.compile(r"^[\s>*_#\-+]+|[\s*_]+$")


def host_of(url: str) -> str:
    m = _HOST.match(url or "")
    return re.sub(r"^www\.", "", m.group(1).lower()) if m else ""


def bare(line: str) -> str:
    return " ".join(_DECOR.sub("", _LINK.sub(r"\1", line)).lower().split())


def main(data: str) -> None:
    con = duckdb.connect()
    md = con.execute(f"select parsed_id, job_id, url, markdown from read_parquet(['{data}/parsed_documents.parquet{"/*.parquet" if Path(data, "parsed_documents.parquet").is_dir() else ""}']) order by parsed_id").fetchall()
    raw = con.execute(f"select page_id, job_id, url, html from read_parquet(['{data}/raw_pages.parquet{"/*.parquet" if Path(data, "raw_pages.parquet").is_dir() else ""}']) order by page_id").fetchall()
    failed = re.compile(f"(?i){MESSAGES}|{PLACEHOLDER}")
    samples = con.execute(f"select language, text from '{data}/language_samples.parquet'").fetchall()
    prose: dict[str, Counter] = {}
    for language, text in samples:
        prose.setdefault(language, Counter()).update(tokens(text))
    prose = {l: {w: math.log(k / (sum(c.values()) * 1.25)) for w, k in c.items()} for l, c in prose.items()}

    def is_odd(text: str) -> bool:
        # Pages that look failed or stuffed teach no forms, and all their other lines are their own:
        # error messages and product lines recur over sites as well.
        c = Counter(tokens(text))
        n = sum(c.values())
        hits = {l: sum(k for w, k in c.items() if w in q) for l, q in prose.items()}
        kept = [(h, prose[l]) for l, h in hits.items() if 5 * h >= max(hits.values())]
        return bool(failed.search(text)) or (n >= 20 and divergence(c, n, kept) > 4.4)

    odd, titles = [], []
    pages = []  # (site, name, units as (text, features of place and tags))
    for _, _, url, text in md:
        site = host_of(url)
        units = markdown_units(text or "")
        title = False
        rows = []
        for k, (_, line, code) in enumerate(units):
            rows.append((line, place_features(k, len(units), title, code), code or line.startswith("#"), 1))
            title |= line.startswith("#") and not code
        pages.append((site, site_word(site), rows))
        odd.append(is_odd(" \n".join(r[0] for r in rows)))
        titles.append(page_title(units, "md") or f"md {len(pages)}")
    for _, _, url, text in raw:
        site = host_of(url)
        units = html_units(text or "")
        title = False
        rows = []
        for k, (line, anc, density) in enumerate(units):
            head = any(x in ("h1", "h2", "h4", "h5", "h6") for x in anc) or "pre" in anc
            rows.append((line, place_features(k, len(units), title, False) + tag_features(anc, density), head, 0))
            title |= any(x in ("h1", "h2") for x in anc)
        pages.append((site, site_word(site), rows))
        odd.append(is_odd(" \n".join(r[0] for r in rows)))
        titles.append(page_title(units, "html") or f"html {len(pages)}")

    df = Counter()
    for _, _, rows in pages:
        df.update({w for line, *_ in rows for w in WORD.findall(line.lower())})
    common = {w for w, n in df.items() if n >= RARE}
    names = {name for _, name, _ in pages}

    def form(line: str) -> str:
        t = WORD.sub(lambda m: m.group() if m.group() in common and m.group() not in names else "N", re.sub(r"\d+", "9", bare(line)))
        return re.sub(r"N( N)+", "N", t)

    forms, firsts, under, site_titles = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for (s, _, rows), skip, title in zip(pages, odd, titles):
        site_titles[s].add(title)
        for line in {x[0] for x in rows}:
            under[s, re.sub(r"\d+", "#", bare(line))].add(title)
            if skip:
                continue
            f = form(line)
            if len(f) < 140 and len(forms[f]) < SITES:
                forms[f].add(s)
            p = " ".join(f.split()[:2])
            if not re.search(r"[.!?؟…]$", f) and len(firsts[p]) < PREFIX_SITES:
                firsts[p].add(s)

    own = Counter({k: len(v) for k, v in under.items()})
    site_docs = {k: len(v) for k, v in site_titles.items()}

    def label(site: str, line: str, kept: bool) -> int:
        if kept:
            return 0
        f = form(line)
        if not re.search(r"[^\W\dN_]", f):
            return 0
        if len(forms[f]) >= SITES:
            return 1
        if not re.search(r"[.!?؟…]$", f) and len(firsts[" ".join(f.split()[:2])]) >= PREFIX_SITES:
            return 1
        n = own[site, re.sub(r"\d+", "#", bare(line))]
        return int(n >= 3 and n >= 0.08 * site_docs[site] and len(line) < 200)

    labelled = [(s, name, rows, [label(s, line, kept) for line, _, kept, _ in rows]) for s, name, rows in pages if rows]
    labelled = labelled[:: max(1, len(labelled) // MAX_PAGES)]
    held, fit = labelled[::5], [x for k, x in enumerate(labelled) if k % 5]

    def feats(site: str, name: str, rows: list) -> list[list[str]]:
        return [
            text_features(line, name) + place + [repeat_feature(own[site, re.sub(r"\d+", "#", bare(line))])]
            + ["is_md" if is_md else "is_html"]
            for line, place, _, is_md in rows
        ]

    seen = Counter(f for s, n, r, _ in fit for u in feats(s, n, r) for f in set(u))
    number = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 4))}
    x = [[[number[f] for f in u if f in number] for u in feats(s, n, r)] for s, n, r, _ in fit]
    w, chain = crf.train(x, [y for *_, y in fit], len(number))
    import numpy as np

    bad = Counter()
    tp = fp = fn = 0
    for s, n, r, y in held:
        score = np.array([sum(w[number[f]] for f in u if f in number) for u in feats(s, n, r)])
        got = crf.viterbi(score, np.array([len(score)]), chain)
        for (line, *_), a, b in zip(r, got, y):
            a, b = int(a), int(b)
            tp, fp, fn = tp + a * b, fp + a * (1 - b), fn + (1 - a) * b
            if a != b:
                bad[int(a), line[:150]] += 1
    print(f"held-out: precision {tp / (tp + fp):.4f} recall {tp / (tp + fn):.4f}; features {len(number)}")
    for (a, line), c in bad.most_common(60):
        print(c, "predicted", a, line)
    OUT.write_text(json.dumps({
        "weights": {f: round(float(w[i]), 3) for f, i in number.items() if abs(w[i]) >= 0.02},
        "trans": chain.trans.round(3).tolist(), "start": chain.start.round(3).tolist(), "end": chain.end.round(3).tolist(),
    }, ensure_ascii=False, indent=0, sort_keys=True))


if __name__ == "__main__":
    main(sys.argv[1])
