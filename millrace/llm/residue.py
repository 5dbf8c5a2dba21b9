"""Template residue and error-page text, by a positive-unlabelled naive Bayes classifier.

A record falls into passages (sentences and lines, of at most 30 words). Trusted positives are the
passages of records that a fixed list of well-known error messages or placeholder forms covers; all other
passages are unlabelled. Naive Bayes starts with the unlabelled ones as negatives and is refined
by expectation-maximization (a token counts once in a passage): trusted passages keep weight 1, the others take their posterior
where their record is residue for the most part, so that messages which no trusted form has are learnt. The model
is fitted on every record: texts are cut into tokens once and written, each round is one pass over them that
adds up counts by token, and only these counts come to the driver (one row for each token, words cut to five
letters). Weights are counted in whole parts, so that no order of rows changes the model. Every record is
scored. A record is a case if at least half of the words of its content lie in residue passages. In html
the content is what the CRF of boilerplate.py keeps, and the text of noscript elements.

Defined results: null and empty texts are no cases; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.boilerplate import scored
from millrace.session import spread, written

ROUNDS, SHARE = 6, 0.5
#: Whole parts of a passage in which its weight is counted.
PARTS = 1 << 20
#: Passages in which the model must have met a word that no trusted passage has, before the word counts.
LEARNT = 3
#: A record is trusted if it is shorter than SHORT characters or shows its form within its first OPENING ones.
SHORT, OPENING = 400, 120

#: Most that one word may say for residue: less than the prior holds against it, so that it takes two
#: (or one odd form, such as a placeholder).
MOST = 2.5

# Forms of placeholders, and messages that are trusted as signs of failed pages. Java and
# Python read these patterns alike.
PLACEHOLDER = (
    r"\{\{[^}]{0,80}\}\}|\{%[^%]{0,80}%\}|<%[^%]{0,80}%>|%%\w+%%|\[\[[^\]]{0,80}\]\]|@@[\w-]+@@|#\{[^}]{0,80}\}"
    r"|\$\{[^}]{0,80}\}|__\w+__|<Your [^>]{0,80}>|\[(?:insert|your) [^\]]{0,80}\]|\[[^\]]{0,80} goes here\]"
)
MESSAGES = (
    "404 not found|403 forbidden|401 unauthorized|500 internal server error|502 bad gateway|503 service unavailable"
    "|504 gateway time|access denied|access to this resource has been denied|page not found|internal server error"
    "|error establishing a database connection|fatal error: |checking your browser before|verify you are human"
    "|enable javascript|turn on scripts|javascript aktivieren|aktivieren sie javascript|activer javascript"
    "|activez javascript|activar javascript|active javascript|habilite javascript|ativar o javascript|ative o javascript"
    "|schakel javascript|javascript in te schakelen|включите javascript|works best with javascript"
    "|does not support scripts|something went wrong|no longer available|lorem ipsum dolor|\\[object object\\]"
    "|undefined \\w+: |nan \\w+: |placeholder for|goes here|your text here|type something here|sample text\\."
    "|blindtext|texte à remplacer|texto de relleno|traceback \\(most recent call last\\)|too many requests|request timed out"
    "|your session has expired|could not be found|seite nicht gefunden|page introuvable|est introuvable|página no encontrada"
    "|página solicitada no existe|página não encontrada|página não existe|pagina niet gevonden|страница не найдена"
    "|صفحه پیدا نشد|صفحه یافت نشد"
)
_SPLIT = re.compile(r"(?<=[.!?؟…])\s+|\n+")
_TOKEN = re.compile(rf"(?P<ph>{PLACEHOLDER})|(?P<tr>\b\w+\.(?:js|php|py|java)(?::\d+)?)|(?P<hex>\b(?=\w*\d)[0-9a-f]{{7,}}\b)|(?P<n>\d+)|(?P<w>[^\W\d_]+)")


#: Tokens of odd forms; a number is the empty token.
_KINDS = {"ph": "<ph>", "tr": "<tr>", "hex": "<hex>", "n": ""}
#: Without any of these a passage holds words and numbers only.
_ODD = re.compile(
    r"[{}<%\[@$#_.\d](?:(?<=[{}<%\[@$#])|(?<=_)_|(?<=\.)(?:js|php|py|java)\b|(?<=\d)(?:[a-f]|\d{6})|(?<=[a-f]\d))"
)
_PLAIN = re.compile(r"([^\W\d_]{1,5})[^\W\d_]*|\d+")


def passages(text: str) -> Iterator[list[str]]:
    """Tokens of each passage: words by their first five letters, numbers and odd forms by their kind."""
    for part in _SPLIT.split(text):
        if _ODD.search(part):
            tokens = [m.group().lower()[:5] if m.lastgroup == "w" else _KINDS[m.lastgroup] for m in _TOKEN.finditer(part)]
        else:
            tokens = _PLAIN.findall(part.lower())
        if len(tokens) <= 30:
            if tokens:
                yield tokens
            continue
        for at in range(0, len(tokens), 30):
            yield tokens[at : at + 30]


#: Passages of records: the distinct tokens of all passages in order, and of each passage how many are
#: distinct and how many it has.
_PASSAGES = pa.schema([("tokens", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


def passage_columns(texts: list[str]) -> list[pa.Array]:
    tokens, kinds, sizes, in_tokens, in_kinds = [], [], [], [0], [0]
    for t in texts:
        for p in passages(t):
            own = dict.fromkeys(p)
            tokens += own
            kinds.append(len(own))
            sizes.append(len(p))
        in_tokens.append(len(tokens))
        in_kinds.append(len(kinds))
    at = pa.array(in_kinds, pa.int32())
    return [
        pa.ListArray.from_arrays(pa.array(in_tokens, pa.int32()), pa.array(tokens, pa.string())),
        *(pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (kinds, sizes)),
    ]


class Residue:
    """Log-odds of tokens (0 for those left out), and decisions on passages and records."""

    def __init__(self, odds: dict[str, float], prior: float):
        self.odds, self.prior = odds, prior

    @classmethod
    def fit(cls, trusted: list[str], unlabelled: list[str], rounds: int = ROUNDS) -> Residue:
        sure, rest = ([set(p) for t in texts for p in passages(t)] for texts in (trusted, unlabelled))
        batch = pa.RecordBatch.from_arrays(passage_columns(unlabelled), schema=_PASSAGES)

        def taken(model: Residue) -> dict[str | None, tuple[int, int, int]]:
            return {t: x for t, *x in zip(*model.taken(batch))}

        return cls.refined(*(Counter(t for p in x for t in p) for x in (sure, rest)), len(sure), len(rest), taken, rounds)

    @classmethod
    def refined(
        cls, sure: Counter, rest: Counter, n_sure: int, n_rest: int,
        taken: Callable[[Residue], dict[str | None, list[int]]], rounds: int = ROUNDS,
    ) -> Residue:
        """From the number of trusted and of other passages that hold each token, and of all. taken(model): what
        Residue.taken counts over the other passages."""
        size = len(sure.keys() | rest.keys()) + 1
        model, got = cls({}, 0.0), {}
        for k in range(rounds):
            if k:
                last, got = got, taken(model)
                if got == last:
                    break  # every further round would give this model again
            yes, no, held = dict(sure), dict(rest), {}
            for t, (more, gone, n) in got.items():
                if t is not None:
                    yes[t] = yes.get(t, 0) + more / PARTS
                    no[t] -= gone / PARTS
                    held[t] = n
            n_yes, n_no = sum(yes.values()) + 1.0, sum(no.values()) + 1.0
            least, most = math.log(n_yes + 0.1 * size), math.log(n_no + 0.1 * size)
            odds = {}
            for t in yes.keys() | no.keys():
                v = math.log(yes.get(t, 0) + 0.1) - least - math.log(no.get(t, 0) + 0.1) + most
                v = max(-4.0, min(4.0 if t[:1] == "<" else MOST, v))
                # A word that no trusted passage has speaks for residue once LEARNT passages taken for residue hold it.
                if v < 0 or v and (t in sure or held.get(t, 0) >= LEARNT):
                    odds[t] = v
            share = (n_sure + got.get(None, (0,))[0] / PARTS) / max(1, n_sure + n_rest)
            prior = math.log(max(share, 1e-4) / max(1 - share, 1e-4))
            model = cls(odds, min(-MOST - 0.1, prior))
        return model

    def scores(self, batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the passages of a batch of _PASSAGES: their tokens, the number of distinct ones, the record of each
        passage, and its score."""
        tokens = batch.column("tokens").flatten().dictionary_encode()
        kinds = batch.column("kinds").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(batch.num_rows), batch.column("kinds").value_lengths().to_numpy(zero_copy_only=False))
        if not len(kinds):
            return tokens, kinds, of, np.zeros(0)
        get = self.odds.get
        odds = np.array([get(t, 0.0) for t in tokens.dictionary.to_pylist()])
        each = odds[tokens.indices.to_numpy(zero_copy_only=False)]
        return tokens, kinds, of, self.prior + np.add.reduceat(each, np.cumsum(kinds) - kinds)

    def taken(self, batch: pa.RecordBatch) -> tuple[list[str | None], list[int], list[int], list[int]]:
        """Of a batch of _PASSAGES, for each token in passages taken for residue in part: their weight, what
        of it the negatives lose (both in PARTS), and how many weigh more than a half. At None that of all."""
        tokens, kinds, of, score = self.scores(batch)
        weight = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        # Passages count by what their record is: in one that is not residue for the most part they stay
        # negative, so that odd passages of real pages do not draw others of their kind in, round by round.
        bad, every = (np.bincount(of, weights=w, minlength=batch.num_rows) for w in (kinds * (weight > 0.5), kinds))
        parts = np.rint(weight * PARTS).astype(np.int64) * (bad >= SHARE * every)[of]
        some = np.repeat(parts > 0, kinds)
        at, w = tokens.indices.to_numpy(zero_copy_only=False)[some], np.repeat(parts, kinds)[some]
        known, own = np.unique(at, return_inverse=True)
        out = []
        for x in (np.where(w > PARTS // 1000, w, 0), np.where(w >= PARTS - PARTS // 1000, PARTS, w), w > PARTS // 2):
            n = np.zeros(len(known), dtype=np.int64)
            np.add.at(n, own, x)
            out.append(n.tolist())
        names = tokens.dictionary.take(pa.array(known)).to_pylist() if len(known) else []
        return [*names, None], [*out[0], int(parts.sum())], [*out[1], 0], [*out[2], 0]

    def score(self, tokens) -> float:
        get = self.odds.get
        return self.prior + sum(get(t, 0.0) for t in set(tokens))

    def share(self, text: str) -> tuple[int, int]:
        """(tokens in residue passages, all tokens)."""
        bad = total = 0
        for p in passages(text):
            total += len(p)
            if self.score(p) > 0:
                bad += len(p)
        return bad, total


#: What every text that MESSAGES or PLACEHOLDER finds holds somewhere, to pass by most texts, and the letters
#: that a search without case takes for others though they are no capitals of theirs.
_LITERALS = [m.replace("\\[", "[").replace("\\]", "]").replace("\\(", "(").replace("\\)", ")").replace("\\.", ".") for m in MESSAGES.split("|")]
_IN_MESSAGES, _OTHER_CASE = [m.split("\\w")[0] for m in _LITERALS], re.compile("[\u0130\u0131\u017f\u1c80-\u1c88]")
_IN_FORMS = ["{{", "{%", "<%", "%%", "[[", "@@", "#{", "${", "__", "<Your ", "[insert ", "[your ", " goes here]"]
_MESSAGE, _FORM = re.compile(MESSAGES, re.I), re.compile(PLACEHOLDER)


def _message(text: str) -> bool:
    low = text.lower()
    maybe = any(m in low for m in _IN_MESSAGES) or not text.isascii() and _OTHER_CASE.search(text)
    return bool(maybe and _MESSAGE.search(text))


def _forms(text: str) -> int:
    return len(_FORM.findall(text)) if any(f in text for f in _IN_FORMS) else 0


def trusted(text: str) -> bool:
    """Prose about such things is long and mentions them in passing; a failed page opens with them or is short."""
    if len(text) >= SHORT and not _message(text[:OPENING]) and not _forms(text[:OPENING]):
        return False
    return _message(text) or _forms(text) > 2


def tokenised(parsed: DataFrame) -> DataFrame:
    """(parsed_id, sure, tokens, kinds, sizes) of every text_sample, written: whether it is trusted, and its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("t").to_pylist()
                sure = pa.array([trusted(t) for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("parsed_id"), sure, *passage_columns(texts)], names=["parsed_id", "sure", *_PASSAGES.names])

    rows = parsed.select(F.col("parsed_id").cast("long").alias("parsed_id"), F.col("text_sample").alias("t")).filter("t is not null and t <> ''")
    return written(spread(rows).mapInArrow(run, "parsed_id long, sure boolean, tokens array<string>, kinds array<int>, sizes array<int>"))


def fit(parsed: DataFrame) -> Residue:
    """The model, from every parsed_documents.text_sample and the trusted forms themselves."""
    return fit_tokenised(tokenised(parsed))


def fit_tokenised(rows: DataFrame) -> Residue:
    """The model from the result of tokenised."""
    sure, rest = Counter(), Counter()
    for r in rows.select("sure", F.explode("tokens").alias("t")).groupBy("sure", "t").count().collect():
        (sure if r["sure"] else rest)[r["t"]] = r["count"]
    n = {r["sure"]: r["n"] for r in rows.groupBy("sure").agg(F.sum(F.size("kinds")).alias("n")).collect()}
    seeds = [set(p) for m in _LITERALS for p in passages(m.replace("\\w+", "title"))]
    sure.update(t for p in seeds for t in p)
    others = rows.filter("not sure").select(*_PASSAGES.names)

    def taken(model: Residue) -> dict[str | None, list[int]]:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(shared.value.taken(batch), (pa.string(), *[pa.int64()] * 3))], names=["t", "more", "gone", "n"]
                )

        counts = others.mapInArrow(run, "t string, more long, gone long, n long").groupBy("t").agg(F.sum("more"), F.sum("gone"), F.sum("n"))
        got = {t: x for t, *x in counts.collect()}
        shared.unpersist()
        return got

    return Residue.refined(sure, rest, n.get(True, 0) + len(seeds), n.get(False, 0), taken)


def tokenised_cases(rows: DataFrame, model: Residue) -> DataFrame:
    """(parsed_id) of the records of tokenised that are residue."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, of, score = shared.value.scores(batch)
            sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            bad, total = (np.bincount(of, weights=w, minlength=batch.num_rows) for w in (sizes * (score > 0), sizes))
            found = (bad > 0) & (bad >= SHARE * total)
            yield pa.RecordBatch.from_arrays([batch.column("parsed_id").filter(pa.array(found))], names=["parsed_id"])

    return rows.filter("parsed_id is not null").select("parsed_id", *_PASSAGES.names).mapInArrow(run, "parsed_id long")


def parsed_cases(parsed: DataFrame, model: Residue | None = None) -> DataFrame:
    """(parsed_id) of the records whose text_sample is residue."""
    rows = tokenised(parsed)
    return tokenised_cases(rows, model or fit_tokenised(rows))


def html_judge(raw: DataFrame, model: Residue):
    """The test of a page's content for boilerplate.scored."""
    shared = raw.sparkSession.sparkContext.broadcast(model)

    def judge(content: str) -> bool:
        bad, total = shared.value.share(content)
        return bool(bad) and bad >= SHARE * total

    return judge


def raw_cases(raw: DataFrame, model: Residue) -> DataFrame:
    """(page_id) of the pages whose content is residue."""
    rows = scored(raw, "raw_pages", "page_id", "html", "html", hashes=False, judge=html_judge(raw, model))
    return rows.filter("failed").select(F.col("rec_id").alias("page_id"))
