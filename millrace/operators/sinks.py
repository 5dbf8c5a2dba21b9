"""What leaves the engine: files of documents, bundles of sites, chunk and corpus exports, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions.text import file_key, front_matter
from millrace.functions.urls import slug
from millrace.operators.ordered import running
from millrace.settings import DEFAULTS


def newest_documents(docs: DataFrame, n: int = DEFAULTS.documents_limit, most: int = DEFAULTS.documents_most, tie: str = "parsed_id") -> DataFrame:
    """The last n documents, at most `most` (TakeOrderedAndProject: no global sort)."""
    return docs.orderBy(F.desc("parsed_at"), F.desc(tie)).limit(min(n, most))


def retained(docs: DataFrame, n: int = DEFAULTS.retained_documents, tie: str = "parsed_id") -> DataFrame:
    """The newest n documents; 0 keeps all."""
    return docs if n == 0 else docs.orderBy(F.desc("parsed_at"), F.desc(tie)).limit(n)


def markdown_files(docs: DataFrame, parsed_at: Column) -> DataFrame:
    """(path, content) of every document: <job>/<key of the address>.md with a YAML head."""
    head = front_matter(
        [
            ("url", F.col("url"), False),
            ("title", F.col("title"), True),
            ("job_id", F.col("job_id"), False),
            ("parsed_at", parsed_at, False),
            ("estimated_tokens", F.col("estimated_tokens"), False),
        ]
    )
    return docs.select(
        F.concat("job_id", F.lit("/"), file_key(F.col("url")), F.lit(".md")).alias("path"),
        F.concat(head, F.coalesce("markdown", F.lit(""))).alias("content"),
    )


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content) rows below a root on any file system that Arrow knows (a path, file:, hdfs:, s3:, gs:),
    each by a rename, so that a task that runs twice leaves the same files."""

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        for row in rows:
            path = f"{base}/{row['path']}"
            folder, _, name = path.rpartition("/")
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(row["content"].encode("utf-8"))
            store.move(part, path)

    files.select("path", "content").foreachPartition(put)


def document_json(columns: list[str]) -> Column:
    """One document as a JSON object; missing values stay as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def chunk_json(chunks: DataFrame, by: str) -> DataFrame:
    """(by, chunks): the chunks of each document as one JSON array in their order. A document's chunks are at most
    its words over the step; the corpus is never one array."""
    cols = [c for c in chunks.columns if c != by]
    listed = F.array_sort(F.collect_list(F.struct("index", *[c for c in cols if c != "index"])))
    objects = F.transform(listed, lambda c: F.struct(*[c[x].alias(x) for x in cols]))
    return chunks.groupBy(by).agg(F.to_json(objects, {"ignoreNullFields": "false"}).alias("chunks"))


def export_summary(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(total_count, bytes) of an export; the documents themselves are written by export_documents."""
    return docs.agg(F.count(F.lit(1)).alias("total_count"), F.coalesce(F.sum(F.octet_length(document_json(columns))), F.lit(0)).alias("json_bytes"))


def export_documents(docs: DataFrame, columns: list[str], path: str) -> None:
    """One JSON line for each document, in as many files as there are tasks."""
    docs.select(*columns).write.mode("overwrite").json(path)


def bundle_parts(docs: DataFrame, site: Column, parsed_at: Column, tie: str = "parsed_id") -> DataFrame:
    """The documents of every site as parts of its bundle: (site, idx, of, path, contents_line, content).

    A site with one document becomes <slug>.md with its head; others <slug>_combined.md, whose parts follow
    in newest-first order under a table of contents. Parts stay rows: a site may hold a third of all
    documents and never becomes one string in one task. The index runs over narrow rows only."""
    keyed = docs.withColumn("site", site)
    idx = running(keyed.select("site", "parsed_at", tie), "site", [F.desc("parsed_at"), F.desc(tie)], place="idx")
    size = keyed.groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    rows = keyed.join(idx.select(tie, "idx"), tie).join(size, "site")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Document "), F.col("idx").cast("string")))
    head = front_matter(
        [
            ("url", F.col("url"), False),
            ("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Document")), True),
            ("description", F.col("meta_description"), True),
            ("language", F.coalesce("language", F.lit("en")), False),
            ("estimated_tokens", F.col("estimated_tokens"), False),
            ("token_savings", F.concat(F.lit("-"), F.col("token_savings_pct").cast("string"), F.lit("%")), False),
            ("parsed_at", parsed_at, False),
        ]
    )
    text = F.coalesce("markdown", F.lit(""))
    part = F.concat_ws(
        "\n",
        F.concat(F.lit('<a name="doc-'), F.col("idx").cast("string"), F.lit('"></a>')),
        F.concat(F.lit("## ["), F.col("idx").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit("] "), title),
        F.concat(F.lit("> URL: "), "url", F.lit(" | Tokens: ~"), F.col("estimated_tokens").cast("string"), F.lit(" | Savings: -"), F.col("token_savings_pct").cast("string"), F.lit("%\n")),
        head,
        text,
        F.lit("\n\n---\n"),
    )
    single = F.col("of") == 1
    name = slug(F.col("site"))
    return rows.select(
        "site",
        "idx",
        "of",
        F.concat(name, F.lit("/"), name, F.when(single, ".md").otherwise("_combined.md")).alias("path"),
        F.when(~single, F.concat(F.col("idx").cast("string"), F.lit(". ["), title, F.lit("](#doc-"), F.col("idx").cast("string"), F.lit(") - `"), "url", F.lit("`"))).alias("contents_line"),
        F.when(single, F.concat(head, text)).otherwise(part).alias("content"),
    )


def bundle_heads(docs: DataFrame, site: Column) -> DataFrame:
    """The opening lines of every site's bundle: documents and tokens."""
    return (
        docs.withColumn("site", site)
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("estimated_tokens", F.lit(0)).cast("long")).alias("tokens"))
        .select(
            "site",
            "documents",
            "tokens",
            F.concat(
                F.lit("# Knowledge base: "), "site", F.lit("\n- **Total Documents:** "), F.col("documents").cast("string"),
                F.lit("\n- **Total Estimated LLM Tokens:** ~"), F.col("tokens").cast("string"), F.lit("\n\n## Table of Contents"),
            ).alias("head"),
        )
    )


def chunk_summary(chunks: DataFrame, words: int = DEFAULTS.chunk_words, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks")).select(
        "total_chunks", F.lit(words).alias("chunk_size_tokens"), F.lit(overlap).alias("overlap_tokens")
    )


def in_languages(docs: DataFrame, languages: list[str]) -> DataFrame:
    """Documents in the languages (or without one); all of them if none is left."""
    if not languages:
        return docs
    fits = F.coalesce("language", F.lit("")).isin(*languages, "")
    any_left = docs.filter(fits).limit(1).agg((F.count(F.lit(1)) > 0).alias("any_left"))
    return docs.crossJoin(F.broadcast(any_left)).filter(fits | ~F.col("any_left")).drop("any_left")  # one row


def claim_checks(pages: DataFrame) -> DataFrame:
    """pages with their key <job>/<16 hex>, which alone travels through queues."""
    return pages.withColumn("page_key", F.concat("job_id", F.lit("/"), F.substring(F.sha2(F.concat_ws("|", "url", F.col("page_id").cast("string")), 256), 1, 16)))


def reset(*paths: str) -> None:
    """Remove tables and checkpoints, on any file system; what is not there is no error."""
    spark = SparkSession.active()
    for p in paths:
        storage.delete(spark, p)
