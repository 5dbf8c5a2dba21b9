"""The queries of the ten problems, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import canonicalize
from millrace.llm import boilerplate, language, leaks, neardup, packing, residue, seen, site_lines, spam, splitting
from millrace.plans import catalogue
from millrace.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents")


def failed_and_spam(spark: SparkSession, d: str) -> DataFrame:
    """(parsed_id) of the cases of problems 4 and 5 among parsed_documents."""
    parsed = _parsed(spark, d)
    failed = written(residue.parsed_cases(parsed))
    return failed.unionByName(spam.spam_cases(parsed, table(spark, d, "language_samples"), failed))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parsed, raw = _parsed(spark, d), table(spark, d, "raw_pages")
    tokens = residue.tokenised(parsed)
    model = residue.fit_tokenised(tokens)
    failed = written(residue.tokenised_cases(tokens, model))
    bad = written(failed.unionByName(spam.spam_cases(parsed, table(spark, d, "language_samples"), failed)))
    # Raw pages of such records, by the job and address they share. Only ids and addresses move.
    of = parsed.select("parsed_id", "job_id", "url").join(bad, "parsed_id", "left_semi").select("job_id", "url").distinct()
    pages = raw.select("page_id", "job_id", "url").join(of, ["job_id", "url"], "left_semi").select("page_id")
    without = (
        bad.select(F.lit("parsed_documents").alias("tab"), F.col("parsed_id").alias("rec_id"))
        .unionByName(pages.select(F.lit("raw_pages").alias("tab"), F.col("page_id").alias("rec_id")))
    )
    return boilerplate.boilerplate_units(parsed, raw, without, residue.html_judge(raw, model))


def p1_main_text(spark: SparkSession, d: str) -> DataFrame:
    """(tab, rec_id, text) over parsed_documents.markdown and raw_pages.html."""
    return boilerplate.main_texts(_parsed(spark, d), table(spark, d, "raw_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    members, links = neardup.near_duplicates(
        parsed, "parsed_id", "markdown", threshold=0.6, shingle=3, min_words=40, without=residue.parsed_cases(parsed)
    )
    return neardup.all_pairs(members, links).select(F.col("a").alias("parsed_a"), F.col("b").alias("parsed_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Default parameters (five words, 0.8): for each record its class and the class's number of links."""
    members, links = neardup.near_duplicates(_parsed(spark, d), "parsed_id", "markdown")
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "class_id", "left").select(
        F.col("id").alias("parsed_id"), "class_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    segs = written(language.segments(parsed, table(spark, d, "language_samples")))
    found = language.relabelled(parsed, segs)
    return found.join(failed_and_spam(spark, d), "parsed_id", "left_anti")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(_parsed(spark, d), table(spark, d, "language_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parsed, raw = _parsed(spark, d), table(spark, d, "raw_pages")
    tokens = residue.tokenised(parsed)
    model = residue.fit_tokenised(tokens)
    a = residue.tokenised_cases(tokens, model).select(F.lit("parsed_documents").alias("tab"), F.col("parsed_id").alias("rec_id"))
    return a.unionByName(residue.raw_cases(raw, model).select(F.lit("raw_pages").alias("tab"), F.col("page_id").alias("rec_id")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return spam.spam_cases(parsed, table(spark, d, "language_samples"), residue.parsed_cases(parsed))


def p5_curves(spark: SparkSession, d: str) -> DataFrame:
    pages = spam.curves(_parsed(spark, d), table(spark, d, "language_samples"))
    return spam.spam_pages(written(pages)).withColumnRenamed("id", "parsed_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.recurring_lines(_parsed(spark, d), "parsed_id", "markdown", "url", failed_and_spam(spark, d))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Without every line that p6_found lists."""
    return site_lines.cleaned(_parsed(spark, d), "parsed_id", "markdown", "url", every=True, without=failed_and_spam(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "crawl_targets"), "target_id", canonicalize(F.col("url")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_report(table(spark, d, "crawl_targets"), "target_id", canonicalize(F.col("url")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any valid filling of p8_containers has in common: texts and size units packed, texts that are not whole
    though they fit, containers above any capacity, and whether at least 98 % of the space is used but for one
    container of each task."""
    rows = p8_containers(spark, d)
    cost = F.sum(F.col("size").cast("double") * F.col("size"))
    boxes = rows.groupBy("container_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), cost.alias("cost"))
    of_boxes = boxes.agg(
        F.count_if(F.col("size") > 8192).alias("overfull"),
        F.count_if(F.col("n") > 16).alias("too_many"),
        F.count_if((F.col("cost") > 0.9 * 8192 * 8192) & (F.col("n") > 1)).alias("too_dear"),
        (F.sum("size") >= 0.98 * 8192 * (F.count(F.lit(1)) - 1)).alias("tight"),
    )
    texts = rows.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    of_texts = texts.agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum("size").alias("units"),
        F.count_if((F.col("size") <= 8192) & (F.col("n") > 1)).alias("needlessly_cut"),
    )
    return of_texts.crossJoin(of_boxes)  # one row each


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Removal spans of each document, merged over the items."""
    spans = _leaks(spark, d).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.first", "s.last")
    by_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    # Spans of one document: at most its length over the span length.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:long,last:long>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["last"] >= s["first"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["last"], s["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return by_doc.select("doc_id", F.explode(merged).alias("s")).select(
        "doc_id", F.col("s.first").alias("first_word"), F.col("s.last").alias("end_word")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_levels(table(spark, d, "documents"), "doc_id", "text")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), "doc_id", "text")


def p10_whole(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of p10_pieces put together again: for each text the md5 of the whole, and whether all pieces are
    within the limit and each begins 256 size units before the end of the one before (less than one character
    more, as none is cut in two)."""
    rows = p10_pieces(spark, d)
    # Pieces of one text: at most its size over half a piece.
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "byte_start", "size", "piece"))).alias("p"))
    whole = F.aggregate(
        "p", F.to_binary(F.lit(""), F.lit("utf-8")), lambda out, x: F.concat(out, F.substr(x["piece"].cast("binary"), F.octet_length(out) - x["byte_start"].cast("int") + 1))
    )
    steps = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.when(k > 1, F.get("p", k - 2)["byte_start"] + F.get("p", k - 2)["size"] - F.get("p", k - 1)["byte_start"]))
    return parts.select(
        "doc_id",
        F.md5(whole).alias("text_md5"),
        F.forall("p", lambda x: x["size"] <= 4096).alias("within"),
        F.forall(steps, lambda n: n.isNull() | n.between(256, 259)).alias("overlapped"),
    )


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    trimmed = catalogue._trim("text")
    grams12 = "unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS g"
    return {
        "p2_groups": """
            WITH w AS (SELECT parsed_id, regexp_extract_all(lower(markdown), '[\\p{L}\\p{N}]+') AS w FROM parsed_documents
                       WHERE markdown IS NOT NULL),
            s AS (SELECT DISTINCT parsed_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
                  FROM w WHERE len(w) >= 5),
            n AS (SELECT parsed_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY parsed_id),
            c AS (SELECT parsed_id, n, min(parsed_id) OVER (PARTITION BY h) AS class_id FROM n),
            r AS (SELECT s.parsed_id, s.g, c.n FROM s JOIN c USING (parsed_id) WHERE c.class_id = c.parsed_id),
            p AS (SELECT a.parsed_id AS a, b.parsed_id AS b FROM r a JOIN r b ON a.g = b.g AND a.parsed_id < b.parsed_id
                  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
            l AS (SELECT x AS class_id, count(*) AS k FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY x)
            SELECT c.parsed_id, c.class_id, c.n::BIGINT AS n_shingles, coalesce(l.k, 0)::BIGINT AS n_links
            FROM c LEFT JOIN l ON l.class_id = c.class_id""",
        "p9_found": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
            e AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
            dg AS (SELECT doc_id, {grams12} FROM d WHERE len(w) >= 12),
            eg AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, {grams12} FROM e WHERE len(w) >= 12))
            SELECT DISTINCT eg.item_id, dg.doc_id FROM dg JOIN eg USING (g)""",
        "p8_invariants": f"""
            WITH t AS (SELECT strlen({trimmed}) AS n FROM documents WHERE text IS NOT NULL)
            SELECT count(*) AS texts, sum(n)::BIGINT AS units, 0::BIGINT AS needlessly_cut, 0::BIGINT AS overfull, 0::BIGINT AS too_many,
              0::BIGINT AS too_dear, true AS tight FROM t WHERE n > 0""",
        "p9_spans": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
            e AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
            dg AS (SELECT doc_id, unnest(range(0, len(w) - 11)) AS p, {grams12} FROM d WHERE len(w) >= 12),
            eg AS (SELECT DISTINCT g FROM (SELECT {grams12} FROM e WHERE len(w) >= 12)),
            h AS (SELECT DISTINCT doc_id, p FROM dg JOIN eg USING (g)),
            i AS (SELECT *, coalesce(p - lag(p) OVER w > 12, true) AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
            s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i)
            SELECT doc_id, min(p)::BIGINT AS first_word, max(p)::BIGINT + 12 AS end_word FROM s GROUP BY doc_id, k""",
        "p10_whole": f"""
            SELECT doc_id, md5({trimmed}) AS text_md5, true AS within, true AS overlapped FROM documents WHERE {trimmed} <> ''""",
        "p10_found": """
            WITH t AS (SELECT doc_id, trim(text, E' \\n\\r\\t\\x0b\\x0c') AS t FROM documents),
            s AS (SELECT doc_id, string_split(regexp_replace(t, E'\\n#', E'\\x01#', 'g'), E'\\x01') AS u FROM t WHERE strlen(t) > 4096),
            p AS (SELECT *, flatten(list_transform(u, lambda x: regexp_split_to_array(x, '\\n[ \\t\\r]*(\\n[ \\t\\r]*)+'))) AS v FROM s),
            l AS (SELECT *, flatten(list_transform(v, lambda x: string_split(x, E'\\n'))) AS w FROM p),
            n AS (SELECT *, flatten(list_transform(w, lambda x: string_split(regexp_replace(x, '([.!?])\\s+', E'\\\\1\\x01', 'g'), E'\\x01'))) AS x FROM l),
            o AS (SELECT *, flatten(list_transform(x, lambda z: regexp_split_to_array(z, '\\s+'))) AS y FROM n),
            m AS (SELECT doc_id, list_transform([u, v, w, x, y],
                    lambda a: list_max(list_transform(a, lambda b: strlen(trim(b, E' \\n\\r\\t\\x0b\\x0c'))))) AS m FROM o)
            SELECT doc_id, CASE WHEN m[1] <= 4096 THEN 'section' WHEN m[2] <= 4096 THEN 'paragraph' WHEN m[3] <= 4096 THEN 'line'
                WHEN m[4] <= 4096 THEN 'sentence' WHEN m[5] <= 4096 THEN 'word' ELSE 'char' END AS cut_at FROM m""",
    }
