"""Text and number columns: normal form, fingerprint, sizes, savings, keys, scores, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.urls import WS, strip

# Ranges of the scripts that the language fallback knows, in their order.
SCRIPTS = (("fa", "؀-ۿﮊ"), ("ru", "Ѐ-ӿ"), ("en", "A-Za-z"))
SCRIPT_SHARE = 0.4


def normal(c: Column) -> Column:
    """White space runs as one blank, none at the ends, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, f"{WS}+", " ")))


def fingerprint(c: Column) -> Column:
    """First 64 bits of SHA-256, unsigned, as a decimal string."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10)


def estimated_tokens(c: Column) -> Column:
    """A quarter of the code points, one at least, none for empty text."""
    n = F.length(c)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(F.lit(0)).cast("int")


def savings_pct(markdown_bytes: Column, raw_bytes: Column) -> Column:
    """Share of bytes saved by one document, in percent with one decimal."""
    return F.round((1 - markdown_bytes / F.greatest(F.lit(1), raw_bytes)) * 100, 1)


def cluster_savings_pct(markdown_bytes: Column, raw_bytes: Column) -> Column:
    """The same over all documents, halves rounded up; 0 without bytes."""
    return F.when(raw_bytes > 0, F.floor((1 - markdown_bytes / raw_bytes) * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def file_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def chunk_key(url: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, index.cast("string")), 256), 1, 12)


def clean_markdown(c: Column) -> Column:
    """Empty bullets out, blanks run together, none before punctuation, two line ends at most, stripped."""
    c = F.regexp_replace(c, r"(?md)^[\s\x{a0}\x{2000}-\x{200a}\x{3000}]*[-*][\s\x{a0}\x{2000}-\x{200a}\x{3000}]*$", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, f"{WS}+([,.:;?!])", "$1")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def script_counts(c: Column) -> Column:
    """Letters of each script the fallback knows, as a struct."""
    return F.struct(*[F.regexp_count(c, F.lit(f"[{chars}]")).cast("long").alias(lang) for lang, chars in SCRIPTS])


def script_language(sample: str) -> str:
    """Language by the script of a text: the first whose share is above the bound, else en."""
    n = {lang: len(re.findall(f"[{chars}]", sample)) for lang, chars in SCRIPTS}
    total = max(1, sum(n.values()))
    return next((lang for lang, _ in SCRIPTS if n[lang] / total > SCRIPT_SHARE), "en")


def script_language_col(c: Column) -> Column:
    """script_language as a column."""
    n = script_counts(c)
    total = F.greatest(F.lit(1).cast("long"), sum((n[lang] for lang, _ in SCRIPTS), F.lit(0).cast("long")))
    out = F.lit("en")
    for lang, _ in reversed(SCRIPTS):
        out = F.when(n[lang] / total > SCRIPT_SHARE, F.lit(lang)).otherwise(out)
    return out


def ascii_digits(c: Column) -> Column:
    """Persian digits as ASCII ones."""
    return F.translate(c, "۰۱۲۳۴۵۶۷۸۹", "0123456789")


def human_bytes(n: Column) -> Column:
    """Bytes as B, KB (one decimal) or MB (two); exact halves go to the even digit."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / 1024, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", F.bround(n / (1024 * 1024), 2)), F.lit(" MB")))
    )


def front_matter(fields: list[tuple[str, Column, bool]]) -> Column:
    """A YAML head: name, value, and whether the value is quoted (with '"' escaped)."""
    lines = [F.lit("---")]
    for name, value, quoted in fields:
        v = F.coalesce(value.cast("string"), F.lit(""))
        v = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"')) if quoted else v
        lines.append(F.concat(F.lit(f"{name}: "), v))
    return F.concat_ws("\n", *lines, F.lit("---"), F.lit(""), F.lit(""))
