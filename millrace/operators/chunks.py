"""Markdown to sections and overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import chunk_key, estimated_tokens
from millrace.functions.urls import WS, strip
from millrace.settings import DEFAULTS


def section_array(markdown: Column, title: Column) -> Column:
    """Sections of a text as array<struct<heading, text>>, in order: a line beginning with '#' opens one
    named by its rest; what comes before is named by the title, or 'Overview'; empty ones are left out.

    The text is cut at its heading lines by one regular expression, inside the row: no shuffle, no window."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(markdown, F.lit(""))), r"\n(?=#)", "\n\x01")
    parts = F.split(marked, "\n\x01", -1)

    def section(p: Column, i: Column) -> Column:
        first = F.substring_index(p, "\n", 1)
        named = F.when(i == 0, F.coalesce(F.nullif(title, F.lit("")), F.lit("Overview"))).otherwise(
            strip(F.regexp_replace(first, "^#+", ""))
        )
        text = F.when(i == 0, p).otherwise(F.substring(p, F.length(first) + 1, F.length(p)))
        return F.struct(named.alias("heading"), strip(text).alias("text"))

    return F.filter(F.transform(parts, section), lambda s: s["text"] != "")


def sections(docs: DataFrame, id_col: str, markdown: str, title: Column) -> DataFrame:
    """(id, section_no, heading, text)."""
    return docs.select(id_col, F.posexplode(section_array(F.col(markdown), title)).alias("section_no", "s")).select(
        id_col, F.col("section_no").cast("long").alias("section_no"), "s.heading", "s.text"
    )


def chunk_array(markdown: Column, title: Column, words: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Windows of `words` words, a step of words - overlap (20 at least), through each section; the last
    window may lie wholly in the one before."""
    step = max(20, words - overlap)

    def windows(s: Column) -> Column:
        w = F.split(s["text"], f"{WS}+", -1)
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
        return F.transform(
            starts, lambda i: F.struct(s["heading"].alias("section"), F.array_join(F.slice(w, i + 1, words), " ").alias("words"))
        )

    return F.flatten(F.transform(section_array(markdown, title), windows))


def chunks(docs: DataFrame, id_cols: list[str], markdown: str, url: Column, title: Column, words: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """id columns and chunk_id, index (from 1, through the document), url, title, section, content,
    estimated_tokens (of the words without the heading line). Everything happens inside the row."""
    rows = docs.select(
        *id_cols, url.alias("_url"), title.alias("_title"), F.posexplode(chunk_array(F.col(markdown), title, words, overlap)).alias("_i", "_c")
    )
    index = F.col("_i") + 1
    return rows.select(
        *id_cols,
        chunk_key(F.coalesce("_url", F.lit("")), index).alias("chunk_id"),
        index.cast("long").alias("index"),
        F.col("_url").alias("url"),
        F.coalesce("_title", F.lit("")).alias("title"),
        F.col("_c.section").alias("section"),
        F.concat(F.lit("### "), F.col("_c.section"), F.lit("\n\n"), F.col("_c.words")).alias("content"),
        estimated_tokens(F.col("_c.words")).cast("long").alias("estimated_tokens"),
    )


def carried_headings(lines: DataFrame, id_col: str) -> DataFrame:
    """lines (id, pos, line) with the heading each line stands under: the window form, for line tables."""
    heading = F.when(F.startswith("line", F.lit("#")), strip(F.regexp_replace("line", "^#+", "")))
    order = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(order))
