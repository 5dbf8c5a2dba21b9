"""All queries of the core, by name, and the SQL that gives the same rows.

The SQL is written for DuckDB and states each result again from its definition; queries without SQL are
those whose rows SQL cannot give (markup trees, punycode, streams), tested on small fixtures instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.operators import chunks as ch
from millrace.operators import deadletters, extract, frontier, jobs, outcomes, sinks, submit
from millrace.schemas import COUNTERS, CRAWL_TARGET, RAW_PAGE
from millrace.session import table, written
from millrace.settings import DEFAULTS
from millrace.sources import seeds
from millrace.streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A moment that stands for now in the queries over timestamps of the tables.
NOW_MS = 1_770_000_000_000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Fixed values in SQL: white space at the ends of a text; parts of an address; its canonical form, for hosts
# in ASCII (null for others, as canonicalize(idn=False) gives it).
_TRIM = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


def _canonical_sql(source: str, key: str, url: str = "url") -> str:
    """CTEs ending in canon(key, canonical)."""
    up = "x"
    for _ in range(6):
        up = f"regexp_replace({up}, '/[^/]+/\\.\\.(/|$)', '/')"
    return rf"""
      p0 AS (SELECT {key} AS k, regexp_replace({_trim(url)}, '[\t\r\n]', '', 'g') AS s FROM {source}),
      p1 AS (SELECT k, regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$',
               ['scheme', 'auth', 'path', 'query', 'frag']) AS p FROM p0),
      p2 AS (SELECT k, lower(p.scheme) AS scheme, regexp_replace(p.auth, '^.*@', '') AS hp, p.path AS path, p.query AS query FROM p1),
      p3 AS (SELECT *, lower(regexp_extract(hp, '^([^:]*)(:(.*))?$', 1)) AS host, regexp_extract(hp, '^([^:]*)(:(.*))?$', 3) AS port FROM p2),
      p4 AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '(/\.)+(/|$)', '/', 'g'), '^$', '/') END AS x FROM p3),
      canon AS (SELECT k, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT regexp_matches(host, '[^\x00-\x7f]')
          AND (port = '' OR regexp_matches(port, '^[0-9]+$'))
        THEN scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
          || {up} || CASE WHEN query = '?' THEN '' ELSE coalesce(query, '') END END AS canonical FROM p4)"""


# --- addresses


@query(f"WITH {_canonical_sql('crawl_targets', 'target_id')} SELECT k AS target_id, canonical FROM canon")
def canonical_urls(spark, d):
    """URL1, URL2 in the native form: null for hosts outside ASCII."""
    return table(spark, d, "crawl_targets").select("target_id", urls.canonicalize(F.col("url"), idn=False).alias("canonical"))


@query()
def canonical_urls_idn(spark, d):
    """URL1 with punycode."""
    return table(spark, d, "crawl_targets").select("target_id", urls.canonicalize(F.col("url")).alias("canonical"))


@query(
    f"""WITH {_canonical_sql('crawl_targets', 'target_id')}
    SELECT regexp_extract(canonical, '^https?://([^/?#:]*)', 1) AS host, count(*) AS n FROM canon WHERE canonical IS NOT NULL GROUP BY 1"""
)
def host_counts(spark, d):
    """Of hosts in ASCII; host_counts_idn has all."""
    return _host_counts(spark, d, False)


@query()
def host_counts_idn(spark, d):
    return _host_counts(spark, d, True)


def _host_counts(spark, d, idn: bool) -> DataFrame:
    c = table(spark, d, "crawl_targets").select(urls.canonicalize(F.col("url"), idn).alias("c")).filter("c is not null")
    return c.groupBy(urls.url_host(F.col("c")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT target_id, lower(regexp_extract(coalesce(url, ''), '^[hH][tT][tT][pP][sS]?://([^/?#]+)', 1)) AS host FROM crawl_targets"""
)
def routing_hosts(spark, d):
    """URL9."""
    return table(spark, d, "crawl_targets").select("target_id", urls.routing_host(F.coalesce("url", F.lit(""))).alias("host"))


_SCOPE = r"""(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\.+$', ''), '^www\.', ''))"""


def _scope_sql(h: str, s: str) -> str:
    a, b = _SCOPE.format(h), _SCOPE.format(s)
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR ends_with({a}, '.' || {b})))"


@query(
    f"""WITH {_canonical_sql('crawl_targets', 'target_id')},
    h AS (SELECT k, regexp_extract(coalesce(canonical, ''), '^https?://([^/?#:]*)', 1) AS host FROM canon)
    SELECT t.target_id, {_scope_sql('h.host', 't.scope_host')} AS in_scope FROM crawl_targets t JOIN h ON h.k = t.target_id"""
)
def scope_tests(spark, d):
    """URL6 of every target against its scope; hosts outside ASCII are in none (scope_tests_idn has them)."""
    return _scope_tests(spark, d, False)


@query()
def scope_tests_idn(spark, d):
    return _scope_tests(spark, d, True)


def _scope_tests(spark, d, idn: bool) -> DataFrame:
    host = urls.url_host(F.coalesce(urls.canonicalize(F.col("url"), idn), F.lit("")))
    return table(spark, d, "crawl_targets").select("target_id", urls.in_scope(host, F.col("scope_host")).alias("in_scope"))


@query(
    f"""WITH s AS (SELECT DISTINCT coalesce(scope_host, '') AS scope_host FROM jobs),
    h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM raw_pages)
    SELECT host, count(*) AS scopes FROM h JOIN s ON {_scope_sql('host', 'scope_host')} GROUP BY host"""
)
def scope_matrix(spark, d):
    """URL6 between all hosts of pages and all scopes of jobs, as an equi-join on every suffix of a host."""
    scopes = table(spark, d, "jobs").select(F.coalesce("scope_host", F.lit("")).alias("scope_host")).distinct()
    bare = F.regexp_replace(F.regexp_replace(F.lower("scope_host"), r"\.+$", ""), r"^www\.", "")
    scopes = scopes.select(bare.alias("suffix"), "scope_host").filter("suffix <> ''")
    hosts = table(spark, d, "raw_pages").select(urls.site(F.col("url")).alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        hosts.select("host", F.explode(suffixes).alias("suffix")).join(scopes, "suffix").groupBy("host").agg(F.count(F.lit(1)).alias("scopes"))
    )


@query(
    rf"""WITH p AS (SELECT page_id, stay_in_domain, scope_host, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM raw_pages)
    SELECT page_id, NOT coalesce(stay_in_domain, false) OR {_scope_sql('host', "coalesce(nullif(scope_host, ''), host)")} AS allowed FROM p"""
)
def redirect_scope(spark, d):
    """URL8, URL7: whether the final address of a page stays in scope."""
    p = table(spark, d, "raw_pages")
    host = urls.url_host(F.lower(urls.strip(F.col("url"))))
    scope = F.coalesce(F.nullif(F.col("scope_host"), F.lit("")), host)
    return p.select("page_id", (~F.coalesce("stay_in_domain", F.lit(False)) | urls.in_scope(host, scope)).alias("allowed"))


@query(
    f"""SELECT target_id, regexp_matches(lower({_trim("coalesce(url, '')")}), '^https?://(\\[[^\\]]*\\]|[^/?#:]+)') AS valid FROM crawl_targets"""
)
def target_validity(spark, d):
    """URL10."""
    host = urls.url_host(F.lower(urls.strip(F.coalesce("url", F.lit("")))))
    return table(spark, d, "crawl_targets").select("target_id", (host != "").alias("valid"))


_LINKS = rf"""
    l AS (SELECT parsed_id, url, unnest(extracted_links) AS href FROM parsed_documents),
    n AS (SELECT row_number() OVER () AS i, * FROM l),
    {_canonical_sql('n', 'i', 'href')},
    o AS (SELECT n.parsed_id, n.href, c.canonical AS t, regexp_extract(coalesce(c.canonical, ''), '^https?://([^/?#:]*)', 1) AS host,
            lower(regexp_extract(n.url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS own FROM n JOIN canon c ON c.k = n.i)"""
_ASSET = r"\.(" + "|".join(urls.ASSET_EXTENSIONS) + ")$"


@query(
    rf"""WITH {_LINKS}
    SELECT parsed_id, href, CASE WHEN t IS NOT NULL AND NOT regexp_matches(lower(regexp_extract(t, '^https?://[^/?#]*([^?#]*)', 1)), '{_ASSET}') THEN t END AS target,
      CASE WHEN t IS NOT NULL AND NOT regexp_matches(lower(regexp_extract(t, '^https?://[^/?#]*([^?#]*)', 1)), '{_ASSET}') AND {_scope_sql('host', 'own')} THEN t END AS target_in_site
    FROM o"""
)
def link_targets(spark, d):
    """URL3, URL4, URL5, URL7 of every link of every document."""
    links = table(spark, d, "parsed_documents").select("parsed_id", "url", F.explode("extracted_links").alias("href"))
    base, href = F.col("url"), F.col("href")
    return links.select(
        "parsed_id",
        "href",
        urls.link_target(base, href, F.lit(False), idn=False).alias("target"),
        urls.link_target(base, href, F.lit(True), idn=False).alias("target_in_site"),
    )


@query(
    r"""SELECT parsed_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''),
      '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '[?#].*$', ''), '[^A-Za-z0-9_\-]', '_', 'g'), '^_+|_+$', '', 'g'), 80), ''), 'scraped_document') AS slug
    FROM parsed_documents"""
)
def site_slugs(spark, d):
    """URL12."""
    return table(spark, d, "parsed_documents").select("parsed_id", urls.slug(F.col("url")).alias("slug"))


# --- seeds and submission


@query(f"SELECT target_id, {_trim('url')} AS url FROM crawl_targets WHERE {_trim('url')} <> '' AND {_trim('url')}[1] <> '#'")
def seed_lines(spark, d):
    """SRC1 over the submitted addresses as lines."""
    return seeds.seed_lines(table(spark, d, "crawl_targets").select("target_id", "url"), "url")


_KINDS = f"""
    {_canonical_sql('crawl_targets', 'target_id')},
    {_canonical_sql('jobs', 'job_id').replace('p0', 'q0').replace('p1', 'q1').replace('p2', 'q2').replace('p3', 'q3').replace('p4', 'q4').replace('canon AS', 'seen0 AS')},
    seen AS (SELECT DISTINCT canonical FROM seen0 WHERE canonical IS NOT NULL),
    f AS (SELECT canonical, min(k) AS first_id FROM canon WHERE canonical IS NOT NULL GROUP BY 1),
    kinds AS (SELECT t.target_id, t.url, c.canonical, CASE WHEN coalesce({_trim('t.url')}, '') = '' THEN 'blank' WHEN c.canonical IS NULL THEN 'invalid'
        WHEN t.target_id > f.first_id THEN 'duplicate' WHEN c.canonical IN (FROM seen) THEN 'seen' ELSE 'enqueued' END AS kind
      FROM crawl_targets t JOIN canon c ON c.k = t.target_id LEFT JOIN f USING (canonical))"""


# Punycode is beyond the SQL, so the queries with SQL take hosts outside ASCII as invalid; those named _idn do not.
def _kinds(spark, d, idn: bool = False) -> DataFrame:
    seen = table(spark, d, "jobs").select(urls.canonicalize(F.col("url"), idn).alias("url")).filter("url is not null")
    return submit.classified(table(spark, d, "crawl_targets").select("target_id", "url"), seen, pos="target_id", idn=idn)


@query(f"WITH {_KINDS} SELECT target_id, canonical, kind FROM kinds")
def submitted_kinds(spark, d):
    """SRC3, JN1, ST2, ST3: every submitted address against the batch and the addresses of the jobs."""
    return _kinds(spark, d).select("target_id", "canonical", "kind")


@query(
    f"""WITH {_KINDS} SELECT target_id, canonical AS url, 0::INTEGER AS depth, 2::INTEGER AS max_depth, 5::INTEGER AS priority, true AS stay_in_domain,
      regexp_extract(canonical, '^https?://([^/?#:]*)', 1) AS scope_host, 0::INTEGER AS attempts FROM kinds WHERE kind = 'enqueued'"""
)
def submitted_targets(spark, d):
    """SRC2: the targets of the accepted addresses (without their new job ids)."""
    return _targets(_kinds(spark, d))


def _targets(kinds: DataFrame) -> DataFrame:
    k = kinds.filter("kind = 'enqueued'")
    return submit.targets(k.withColumnRenamed("url", "given"), job_id=F.col("target_id")).withColumnRenamed("job_id", "target_id")


@query(
    f"""WITH {_KINDS} SELECT count(*) AS total_received, count(*) FILTER (kind = 'enqueued') AS enqueued_count,
      count(*) FILTER (kind IN ('duplicate', 'seen')) AS deduplicated_count, count(*) FILTER (kind = 'invalid') AS invalid_count FROM kinds"""
)
def submit_report(spark, d):
    """AG6 in counts, over everything."""
    return submit.report(_kinds(spark, d))


@query(
    f"""WITH {_KINDS} SELECT floor(target_id / 1000)::BIGINT AS batch, count(*) AS total_received, count(*) FILTER (kind = 'enqueued') AS enqueued_count,
      count(*) FILTER (kind IN ('duplicate', 'seen')) AS deduplicated_count, count(*) FILTER (kind = 'invalid') AS invalid_count,
      coalesce(list(canonical ORDER BY target_id) FILTER (kind = 'enqueued'), []) AS enqueued_urls,
      coalesce(list(canonical ORDER BY target_id) FILTER (kind = 'seen'), []) AS deduplicated_urls,
      coalesce(list(url ORDER BY target_id) FILTER (kind = 'invalid'), []) AS invalid_urls FROM kinds GROUP BY 1"""
)
def batch_reports(spark, d):
    """SRC3, AG6 with the lists, one row for each thousand addresses (the API's bound of a batch)."""
    return submit.batch_report(_kinds(spark, d), pos="target_id")


@query()
def submitted_kinds_idn(spark, d):
    """submitted_kinds with punycode."""
    return _kinds(spark, d, True).select("target_id", "canonical", "kind")


@query()
def submitted_targets_idn(spark, d):
    return _targets(_kinds(spark, d, True))


@query()
def submit_report_idn(spark, d):
    return submit.report(_kinds(spark, d, True))


@query()
def batch_reports_idn(spark, d):
    return submit.batch_report(_kinds(spark, d, True), pos="target_id")


@query("SELECT target_id, job_id, url, depth, max_depth, priority, stay_in_domain, scope_host, attempts FROM crawl_targets")
def target_json(spark, d):
    """SRC4: targets written as JSON lines and read again."""
    t = table(spark, d, "crawl_targets").withColumn("created_at", F.col("created_at").cast("string"))
    # The record has no number of its own: each line carries that of its target beside it.
    lines = seeds.target_json(t.select("target_id", *[f.split()[0] for f in CRAWL_TARGET.split(", ")]))
    back = lines.select(F.get_json_object("value", "$.target_id").cast("long").alias("target_id"), F.from_json("value", CRAWL_TARGET).alias("t"))
    return back.select("target_id", "t.*").drop("created_at")


# --- text and numbers

_NORM = r"lower(regexp_replace(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g'))"


@query(f"SELECT doc_id, ('0x' || substr(sha256({_NORM.format('text')}), 1, 16))::UBIGINT::VARCHAR AS fingerprint FROM documents")
def content_fingerprints(spark, d):
    """FN1, FN2."""
    return table(spark, d, "documents").select("doc_id", text.fingerprint(text.normal(F.col("text"))).alias("fingerprint"))


@query(
    f"""WITH n AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents),
    f AS (SELECT doc_id, CASE WHEN t <> '' THEN ('0x' || substr(sha256(t), 1, 16))::UBIGINT::VARCHAR ELSE '' END AS fp FROM n)
    SELECT doc_id, fp <> '' AND doc_id > min(doc_id) OVER (PARTITION BY fp) AS is_duplicate FROM f"""
)
def content_dedup(spark, d):
    """JN2, WN6, ST3: the first of each body stays; texts without content are exempt."""
    t = text.normal(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", F.when(t != "", text.fingerprint(t)).otherwise("").alias("fingerprint"))
    return extract.first_of_content(written(docs), order=("doc_id",)).select("doc_id", "is_duplicate")


@query(
    """SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END::INTEGER AS estimated_tokens,
      strlen(text)::BIGINT AS n_bytes FROM documents"""
)
def token_stats(spark, d):
    """FN3, FN4."""
    return table(spark, d, "documents").select(
        "doc_id", text.estimated_tokens(F.col("text")).alias("estimated_tokens"), F.octet_length("text").cast("long").alias("n_bytes")
    )


@query(
    """SELECT parsed_id, round((1 - markdown_bytes / greatest(1, raw_html_bytes)::DOUBLE) * 100, 1) AS token_savings_pct FROM parsed_documents"""
)
def token_savings(spark, d):
    """FN5."""
    return table(spark, d, "parsed_documents").select(
        "parsed_id", text.savings_pct(F.col("markdown_bytes"), F.col("raw_html_bytes")).alias("token_savings_pct")
    )


@query(
    """SELECT parsed_id, left(sha1(url), 16) AS file_key, left(sha256(url || '1'), 12) AS chunk_key, job_id || '/' || left(sha1(url), 16) AS item_key
    FROM parsed_documents"""
)
def content_keys(spark, d):
    """FN7."""
    key = text.file_key(F.col("url"))
    return table(spark, d, "parsed_documents").select(
        "parsed_id", key.alias("file_key"), text.chunk_key(F.col("url"), F.lit(1)).alias("chunk_key"), F.concat("job_id", F.lit("/"), key).alias("item_key")
    )


@query(
    """SELECT target_id, (10 - least(10, greatest(1, coalesce(priority, 5))))::BIGINT * 10000000000000 + (epoch_us(created_at) // 1000) AS score FROM crawl_targets"""
)
def queue_scores(spark, d):
    """FN8."""
    return table(spark, d, "crawl_targets").select("target_id", frontier.queue_score(F.col("priority"), F.unix_millis("created_at")).alias("score"))


@query(
    """SELECT event_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.2f MB', b / 1048576) END AS size
    FROM (SELECT event_id, (value * value * 1000)::BIGINT AS b FROM (SELECT event_id, floor(value) AS value FROM events))"""
)
def human_sizes(spark, d):
    """FN16."""
    v = F.floor("value")
    return table(spark, d, "events").select("event_id", text.human_bytes(v * v * 1000).alias("size"))


@query(
    """SELECT parsed_id, translate(text_sample, '۰۱۲۳۴۵۶۷۸۹', '0123456789') AS sample FROM parsed_documents"""
)
def ascii_digits(spark, d):
    """FN15."""
    return table(spark, d, "parsed_documents").select("parsed_id", text.ascii_digits(F.col("text_sample")).alias("sample"))


_COUNT = "len(regexp_extract_all({0}, '[{1}]'))"


@query(
    f"""WITH c AS (SELECT parsed_id, {_COUNT.format('text_sample', '\\x{600}-\\x{6ff}\\x{fb8a}')} AS fa,
      {_COUNT.format('text_sample', '\\x{400}-\\x{4ff}')} AS ru, {_COUNT.format('text_sample', 'A-Za-z')} AS en FROM parsed_documents)
    SELECT parsed_id, fa, ru, en, CASE WHEN fa / greatest(1, fa + ru + en) > 0.4 THEN 'fa' WHEN ru / greatest(1, fa + ru + en) > 0.4 THEN 'ru'
      ELSE 'en' END AS language FROM c"""
)
def script_languages(spark, d):
    """AG11, the fallback of HT5."""
    c = text.script_counts(F.col("text_sample"))
    return table(spark, d, "parsed_documents").select("parsed_id", c["fa"].alias("fa"), c["ru"].alias("ru"), c["en"].alias("en"), text.script_language_col(F.col("text_sample")).alias("language"))


@query(
    r"""WITH a AS (SELECT parsed_id, regexp_replace(markdown, '(?m)^[\s\x0b\x{85}\x{a0}]*[-*][\s\x0b\x{85}\x{a0}]*$', '', 'g') AS m FROM parsed_documents),
    b AS (SELECT parsed_id, regexp_replace(regexp_replace(regexp_replace(m, '[ \t]+', ' ', 'g'), '[\s\x0b]+([,.:;?!])', '\1', 'g'), '\n{3,}', E'\n\n', 'g') AS m FROM a)
    SELECT parsed_id, md5(regexp_replace(m, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS markdown_md5 FROM b"""
)
def cleaned_markdown(spark, d):
    """HT17."""
    return table(spark, d, "parsed_documents").select("parsed_id", F.md5(text.clean_markdown(F.col("markdown"))).alias("markdown_md5"))


@query(
    """SELECT letter_id, CASE WHEN queue = 'frontier' THEN CASE WHEN json_valid(payload) THEN payload ->> '$.job_id' END
      ELSE nullif(regexp_extract(payload, '^([^/]+)/', 1), '') END AS job_id FROM dead_letters"""
)
def job_keys(spark, d):
    """FN19."""
    p = F.col("payload")
    valid = F.when(F.expr("try_parse_json(payload)").isNotNull(), deadletters.job_key_of_json(p))
    return table(spark, d, "dead_letters").select(
        "letter_id", F.when(F.col("queue") == "frontier", valid).otherwise(deadletters.job_key_of_page(p)).alias("job_id")
    )


# --- sections and chunks

_SECTIONS = rf"""
    x AS (SELECT parsed_id, title, url, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM
      (SELECT parsed_id, title, url, string_split(regexp_replace(E'\n' || coalesce(markdown, ''), E'\n#', E'\n\x01#', 'g'), E'\n\x01') AS s FROM parsed_documents)),
    y AS (SELECT parsed_id, title, url, i, CASE WHEN i = 1 THEN coalesce(nullif(title, ''), 'Overview') ELSE {_trim("regexp_replace(string_split(part, E'\\n')[1], '^#+', '')")} END AS heading,
      {_trim("CASE WHEN i = 1 THEN part ELSE substr(part, length(string_split(part, E'\\n')[1]) + 1) END")} AS text FROM x),
    sections AS (SELECT *, row_number() OVER (PARTITION BY parsed_id ORDER BY i) - 1 AS section_no FROM y WHERE text <> '')"""


@query(f"WITH {_SECTIONS} SELECT parsed_id, section_no, heading, text FROM sections")
def markdown_sections(spark, d):
    """GEN1, WN4."""
    return ch.sections(table(spark, d, "parsed_documents"), "parsed_id", "markdown", F.col("title"))


_CHUNKS = rf"""{_SECTIONS},
    w AS (SELECT parsed_id, title, url, section_no, heading, regexp_split_to_array(text, '[\s\x0b\x{{85}}\x{{a0}}]+') AS w FROM sections),
    v AS (SELECT *, unnest(range(0, len(w), 350)) AS o FROM w),
    u AS (SELECT parsed_id, title, url, heading, array_to_string(w[o + 1:o + 400], ' ') AS c,
      row_number() OVER (PARTITION BY parsed_id ORDER BY section_no, o) AS i FROM v)"""


@query(
    f"""WITH {_CHUNKS} SELECT parsed_id, left(sha256(url || i), 12) AS chunk_id, i AS index, url, coalesce(title, '') AS title, heading AS section,
      '### ' || heading || E'\n\n' || c AS content, greatest(1, length(c) // 4)::BIGINT AS estimated_tokens FROM u"""
)
def chunks(spark, d):
    """GEN2, WN5, FN7."""
    return ch.chunks(table(spark, d, "parsed_documents"), ["parsed_id"], "markdown", F.col("url"), F.col("title"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, 400::INTEGER AS chunk_size_tokens, 50::INTEGER AS overlap_tokens FROM u")
def chunk_summary(spark, d):
    """The head of SNK5."""
    return sinks.chunk_summary(chunks(spark, d))


@query(
    f"""WITH {_CHUNKS}, c AS (SELECT parsed_id, i, {{'chunk_id': left(sha256(url || i), 12), 'index': i::BIGINT, 'url': url, 'title': coalesce(title, ''), 'section': heading,
      'content': '### ' || heading || E'\\n\\n' || c, 'estimated_tokens': greatest(1, length(c) // 4)::BIGINT}} AS o FROM u)
    SELECT parsed_id, md5(to_json(list(o ORDER BY i))::VARCHAR) AS chunks_md5 FROM c GROUP BY parsed_id"""
)
def chunk_export(spark, d):
    """SNK5: the whole array of every document."""
    return sinks.chunk_json(chunks(spark, d), "parsed_id").select("parsed_id", F.md5("chunks").alias("chunks_md5"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS pos FROM documents),
    h AS (SELECT doc_id, count(DISTINCT pos) FILTER (line[1] = '#') AS headings FROM l GROUP BY 1),
    c AS (SELECT doc_id, pos, last_value(CASE WHEN line[1] = '#' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS at FROM l)
    SELECT c.doc_id, c.at::BIGINT AS heading_line, count(*) AS lines FROM c GROUP BY 1, 2"""
)
def lines_by_heading(spark, d):
    """WN4 in the window form over a table of lines."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    marked = ch.carried_headings(lines.withColumn("line", F.when(F.startswith("line", F.lit("#")), F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise("")), "doc_id")
    return marked.groupBy("doc_id", F.col("heading").cast("long").alias("heading_line")).agg(F.count(F.lit(1)).alias("lines"))


# --- frontier

_ROUTED = """
    r AS (SELECT *, lower(regexp_extract(coalesce(url, ''), '^[hH][tT][tT][pP][sS]?://([^/?#]+)', 1)) AS host,
      (10 - least(10, greatest(1, coalesce(priority, 5))))::BIGINT * 10000000000000 + (epoch_us(created_at) // 1000) AS score FROM crawl_targets)"""


def _routed(spark, d) -> DataFrame:
    t = table(spark, d, "crawl_targets").withColumn("score", frontier.queue_score(F.col("priority"), F.unix_millis("created_at")))
    return frontier.route(t)[0].select("target_id", "host", "score", "depth", "attempts")


@query(f"WITH {_ROUTED} SELECT count(*) FILTER (host <> '') AS routed, count(*) FILTER (host = '') AS unroutable, count(DISTINCT host) FILTER (host <> '') AS hosts FROM r")
def routing_report(spark, d):
    """DC4."""
    t = table(spark, d, "crawl_targets")
    routed, dead = frontier.route(t.drop("created_at"))
    return routed.agg(F.count(F.lit(1)).alias("routed"), F.countDistinct("host").alias("hosts")).crossJoin(
        dead.agg(F.count(F.lit(1)).alias("unroutable"))
    )  # one row each


@query(f"WITH {_ROUTED} SELECT target_id, host, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score, target_id) AS rn FROM r WHERE host <> '') WHERE rn = 1")
def next_claims(spark, d):
    """WN1."""
    return frontier.next_claims(_routed(spark, d), None, NOW_MS, "target_id").select("target_id", "host", "score")


@query(
    f"""WITH {_ROUTED}, g AS (SELECT *, row_number() OVER w AS place,
      1769000000000 + coalesce(sum(1000 + 500 * attempts) OVER (PARTITION BY host ORDER BY score, target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS contact_ms
      FROM r WHERE host <> '' WINDOW w AS (PARTITION BY host ORDER BY score, target_id))
    SELECT target_id, host, place::BIGINT AS place, contact_ms::BIGINT AS contact_ms FROM g"""
)
def politeness_plan(spark, d):
    """WN2."""
    gap = F.lit(1000) + 500 * F.col("attempts")
    return frontier.politeness_plan(_routed(spark, d), gap, "target_id", 1_769_000_000_000).select("target_id", "host", "place", "contact_ms")


_HOSTS = f"{_ROUTED}, hosts AS (SELECT host, max((epoch_us(created_at) // 1000)) AS ready_at_ms FROM r WHERE host <> '' GROUP BY host)"


def _hosts(spark, d) -> DataFrame:
    t = frontier.route(table(spark, d, "crawl_targets"))[0]
    return t.groupBy("host").agg(F.max(F.unix_millis("created_at")).alias("ready_at_ms"))


@query(f"WITH {_HOSTS} SELECT min(ready_at_ms) AS next_ready_ms FROM hosts")
def next_ready(spark, d):
    """WN3."""
    return frontier.next_ready(_hosts(spark, d))


@query(
    f"""WITH {_HOSTS}, b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score, target_id) AS rn FROM r JOIN hosts USING (host) WHERE ready_at_ms <= {NOW_MS})
    SELECT target_id, host, ready_at_ms FROM b WHERE rn = 1 ORDER BY ready_at_ms, host LIMIT 50"""
)
def claim_scan(spark, d):
    """WN1 over hosts that are ready, one scan of 50 (TK6)."""
    hosts = _hosts(spark, d)
    best = frontier.next_claims(_routed(spark, d), hosts, NOW_MS, "target_id")
    return frontier.claim_order(best, hosts).select("target_id", "host", "ready_at_ms")


@query(
    """SELECT target_id, (epoch_us(created_at) // 1000) + 5000 * attempts AS not_before_ms FROM crawl_targets WHERE attempts > 0 AND (epoch_us(created_at) // 1000) + 5000 * attempts <= 1770000000000
    ORDER BY 2, 1 LIMIT 500"""
)
def due_retries(spark, d):
    """SM4, TK6: delayed targets that are due, one move of 500."""
    t = table(spark, d, "crawl_targets").filter("attempts > 0")
    t = t.select("target_id", (F.unix_millis("created_at") + 5000 * F.col("attempts")).alias("not_before_ms"))
    return frontier.due_retries(t, NOW_MS, "target_id")


@query(f"WITH {_ROUTED} SELECT host, count(*) AS scheduled FROM (SELECT DISTINCT host, job_id, url, depth, max_depth, priority FROM r WHERE host <> '') GROUP BY host")
def scheduled_once(spark, d):
    """JN8."""
    item = ["job_id", "url", "depth", "max_depth", "priority"]
    t = frontier.route(table(spark, d, "crawl_targets"))[0].select("host", *item)
    return frontier.scheduled_once(t, item).groupBy("host").agg(F.count(F.lit(1)).alias("scheduled"))


_LEASES = """
    p AS (SELECT letter_id, letter_id || ':' || payload AS item FROM dead_letters WHERE queue = 'frontier'),
    l AS (SELECT sha1(letter_id || ':' || payload) AS lease_id, failed_at_ms AS deadline_ms FROM dead_letters WHERE reason <> 'invalid URL'),
    n AS (SELECT sha1(letter_id || ':' || payload) AS lease_id, length(payload) % 6 AS n FROM dead_letters)"""


@query(
    f"""WITH {_LEASES}, b AS (SELECT coalesce(l.lease_id, sha1(p.item)) AS lease_id, p.item, l.deadline_ms, n.n FROM p FULL JOIN l ON l.lease_id = sha1(p.item)
      LEFT JOIN n ON n.lease_id = coalesce(l.lease_id, sha1(p.item))),
    a AS (SELECT *, CASE WHEN item IS NULL THEN CASE WHEN deadline_ms <= 1768000000000 THEN 'drop' ELSE 'wait' END WHEN deadline_ms IS NULL THEN 'adopt'
      WHEN deadline_ms > 1768000000000 THEN 'keep' WHEN coalesce(n, 0) + 1 > 3 THEN 'dead' ELSE 'requeue' END AS action FROM b)
    SELECT lease_id, action, CASE WHEN action = 'adopt' THEN 1768000120000 ELSE deadline_ms END::BIGINT AS deadline_ms FROM a"""
)
def lease_reaper(spark, d):
    """JN5, AG10, DC8, SM5. Letters of the frontier stand for items in processing, those for other reasons than
    an invalid address for leases: so some items have no lease, some leases no item."""
    t = table(spark, d, "dead_letters").withColumn("item", F.concat(F.col("letter_id").cast("string"), F.lit(":"), F.col("payload")))
    lease = F.sha1("item").alias("lease_id")
    return frontier.reap(
        t.filter("queue = 'frontier'").select("item"),
        t.filter("reason <> 'invalid URL'").select(lease, F.col("failed_at_ms").alias("deadline_ms")),
        t.select(lease, (F.length("payload") % 6).alias("n")),
        1_768_000_000_000,
    ).select("lease_id", "action", "deadline_ms")


@query(
    """SELECT t.target_id FROM crawl_targets t WHERE EXISTS (SELECT 1 FROM raw_pages p WHERE p.job_id = t.job_id AND p.scope_host = t.scope_host)"""
)
def fenced_commits(spark, d):
    """JN9: targets count as settled only while their job and scope are held."""
    held = table(spark, d, "raw_pages").select("job_id", "scope_host")
    return frontier.fenced(table(spark, d, "crawl_targets"), held, ["job_id", "scope_host"]).select("target_id")


@query(
    """WITH i AS (SELECT job_id, 'seeds' AS producer, 1 AS lane FROM jobs UNION ALL SELECT job_id, 'children', 1 FROM crawl_targets WHERE depth > 0
      UNION ALL SELECT job_id, 'due', 0 FROM crawl_targets WHERE attempts > 0)
    SELECT producer, lane::INTEGER AS lane, count(*) AS n, count(DISTINCT job_id) AS jobs FROM i GROUP BY 1, 2"""
)
def ingest_union(spark, d):
    """ST1."""
    t = table(spark, d, "crawl_targets")
    rows = frontier.ingest(
        seeds=table(spark, d, "jobs").select("job_id"), children=t.filter("depth > 0").select("job_id"), due=t.filter("attempts > 0").select("job_id")
    )
    return rows.groupBy("producer", "lane").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"))


# --- outcomes

_FETCH_COLUMNS = """SELECT target_id, url, scope_host, stay_in_domain, attempts,
      CASE WHEN target_id % 23 = 0 THEN 'robots.txt fetch failed' END AS robots_error, target_id % 19 <> 0 AS allowed, (target_id % 7) * 10000 AS crawl_delay_ms,
      target_id % 29 = 0 AS blocked_address, CASE WHEN target_id % 17 = 0 THEN 'connection reset' END AS net_error,
      [200, 200, 200, 404, 429, 503, 301][target_id % 7 + 1] AS status, CASE WHEN target_id % 13 = 0 THEN 'https://elsewhere.test/' ELSE url END AS final_url,
      ['text/html; charset=utf-8', 'application/pdf', '', 'application/xhtml+xml'][target_id % 4 + 1] AS content_type, ['<!DOCTYPE html><html>', '%PDF-1.7', '  <Div>', '{"a": 1}', '<!-- x -->', '<divan>'][target_id % 6 + 1] AS body_head,
      (target_id % 3) * 30000 AS retry_after_ms FROM crawl_targets"""
_OUT_SCOPE = rf"lower(regexp_extract({_trim('final_url')}, '(?i)^https?://([^/?#:]*)', 1))"


@query(
    rf"""WITH f AS ({_FETCH_COLUMNS}),
    g AS (SELECT *, regexp_extract(lower({_trim("coalesce(url, '')")}), '^https?://([^/?#:]*)', 1) AS host,
      regexp_extract(lower(final_url), '^https?://([^/?#:]*)', 1) AS final_host,
      greatest(1000, least(crawl_delay_ms, 30000)) AS gap, least(retry_after_ms, 3600000) AS wait, coalesce(attempts, 0) + 1 AS attempt FROM f),
    k AS (SELECT *, CASE WHEN host = '' THEN 1 WHEN robots_error IS NOT NULL THEN 2 WHEN NOT allowed THEN 3 WHEN blocked_address THEN 4 WHEN net_error IS NOT NULL THEN 5
      WHEN status = 429 OR status >= 500 THEN 6 WHEN status NOT BETWEEN 200 AND 299 THEN 7
      WHEN coalesce(stay_in_domain, false) AND NOT {_scope_sql('final_host', "coalesce(nullif(scope_host, ''), host)")} THEN 8
      WHEN content_type = 'application/pdf' OR (content_type = '' AND NOT regexp_matches(lower(body_head), '^[\s]*(<!doctype html|<div|<!--)[ >]')) THEN 9 ELSE 10 END AS rule FROM g)
    SELECT target_id,
      CASE WHEN rule IN (1, 4) THEN 'dead' WHEN rule IN (2, 5, 6) THEN CASE WHEN attempt >= 3 THEN 'dead' ELSE 'delay' END WHEN rule = 10 THEN 'push' ELSE 'finish' END AS action,
      CASE WHEN rule IN (1, 4, 7) THEN 'pages_failed' WHEN rule IN (2, 5, 6) THEN CASE WHEN attempt >= 3 THEN 'pages_failed' ELSE 'fetch_retries' END
        WHEN rule = 10 THEN 'pages_fetched' ELSE 'pages_skipped' END AS counter,
      CASE WHEN rule IN (1, 3) THEN 0 WHEN rule = 2 THEN 1000 WHEN rule = 4 THEN 0 WHEN rule = 6 THEN greatest(gap, wait) ELSE gap END::BIGINT AS gap_ms,
      CASE WHEN rule IN (2, 5, 6) AND attempt < 3 THEN greatest(least(5000 * (2 ** (attempt - 1))::BIGINT, 300000), CASE WHEN rule = 6 THEN wait ELSE 0 END) END::BIGINT AS delay_ms,
      CASE WHEN rule = 1 THEN 'invalid URL' WHEN rule = 3 THEN 'robots' WHEN rule = 4 THEN 'blocked address' WHEN rule = 7 THEN 'HTTP ' || status
        WHEN rule = 8 THEN 'redirected out of scope' WHEN rule = 9 THEN 'not html' WHEN rule IN (2, 5, 6) THEN
        coalesce(CASE rule WHEN 2 THEN robots_error WHEN 5 THEN net_error END, 'HTTP ' || status) || CASE WHEN attempt >= 3 THEN ' (after ' || attempt || ' attempts)' ELSE '' END END AS reason
    FROM k"""
)
def fetch_outcomes(spark, d):
    """DC1, DC2, FN9, FN10, DC3. The fetches are derived from the targets' numbers."""
    k = F.col("target_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    f = table(spark, d, "crawl_targets").select(
        "target_id", "url", "scope_host", "stay_in_domain", "attempts",
        F.when(k % 23 == 0, "robots.txt fetch failed").alias("robots_error"),
        (k % 19 != 0).alias("allowed"),
        ((k % 7) * 10000).alias("crawl_delay_ms"),
        (k % 29 == 0).alias("blocked_address"),
        F.when(k % 17 == 0, "connection reset").alias("net_error"),
        pick([200, 200, 200, 404, 429, 503, 301], 7).alias("status"),
        F.when(k % 13 == 0, "https://elsewhere.test/").otherwise(F.col("url")).alias("final_url"),
        pick(["text/html; charset=utf-8", "application/pdf", "", "application/xhtml+xml"], 4).alias("content_type"),
        pick(["<!DOCTYPE html><html>", "%PDF-1.7", "  <Div>", '{"a": 1}', "<!-- x -->", "<divan>"], 6).alias("body_head"),
        ((k % 3) * 30000).alias("retry_after_ms"),
    )
    return outcomes.fetch_outcomes(f).select("target_id", "action", "counter", "gap_ms", "delay_ms", "reason")


@query(
    """WITH o AS (SELECT target_id, coalesce(attempts, 0) + 1 AS attempt, (target_id % 5) * 100000 AS ra FROM crawl_targets)
    SELECT target_id, attempt::INTEGER AS attempt, greatest(least(5000 * (2 ** (attempt - 1))::BIGINT, 300000), least(ra, 3600000))::BIGINT AS backoff_ms FROM o"""
)
def retry_plan(spark, d):
    """FN9 without the random part."""
    attempt = (F.coalesce("attempts", F.lit(0)) + 1).cast("int")
    return table(spark, d, "crawl_targets").select(
        "target_id", attempt.alias("attempt"), outcomes.backoff_ms(attempt, (F.col("target_id") % 5) * 100000).alias("backoff_ms")
    )


@query(
    """SELECT target_id, CASE target_id % 5 WHEN 0 THEN greatest(target_id - 300, 0) * 1000 WHEN 1 THEN greatest(epoch_us(created_at) // 1000000 * 1000 - 1768000000000, 0)
      ELSE 0 END::BIGINT AS retry_after_ms FROM crawl_targets"""
)
def retry_after(spark, d):
    """FN11: headers made of the targets' numbers and times: seconds, dates, white space, words, none."""
    k, sent = F.col("target_id"), F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(k % 5 == 0, (k - 300).cast("string")).when(k % 5 == 1, F.concat(sent, F.lit(" GMT"))).when(k % 5 == 2, " ").when(k % 5 == 3, F.concat(F.lit("in "), k.cast("string")))
    now = F.timestamp_millis(F.lit(1_768_000_000_000))
    return table(spark, d, "crawl_targets").select("target_id", outcomes.retry_after_ms(header, now).alias("retry_after_ms"))


@query(
    f"""SELECT page_id, CASE WHEN coalesce({_trim('content_type')}, '') = '' THEN regexp_matches(lower(coalesce(html, '')), '^[\\s]*(<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a|<style|<title|<b|<body|<br|<p|<!--)[ >]')
      ELSE lower({_trim("split_part(content_type, ';', 1)")}) IN ('text/html', 'application/xhtml+xml') END AS is_html FROM raw_pages"""
)
def html_media(spark, d):
    """FN12."""
    return table(spark, d, "raw_pages").select("page_id", outcomes.is_html(F.col("content_type"), F.col("html")).alias("is_html"))


@query(
    """SELECT page_id, least(strlen(html), 4096)::BIGINT AS kept_bytes, strlen(html) > 4096 AS truncated FROM raw_pages"""
)
def truncated_bodies(spark, d):
    """FN13 with a cap of 4 KiB."""
    body, cut = outcomes.capped_body(F.col("html"), 4096)
    return table(spark, d, "raw_pages").select("page_id", F.octet_length(body).cast("long").alias("kept_bytes"), cut.alias("truncated"))


@query(
    """WITH a AS (SELECT event_id, [10, 100, 127, 169, 172, 192, 0, 8, 223, 224, 240][event_id % 11 + 1] AS a, [0, 16, 31, 32, 64, 127, 128, 168, 254][event_id % 9 + 1] AS b,
        event_id % 256 AS c, event_id * 7 % 256 AS d FROM events),
    v AS (SELECT *, concat(a, '.', b, '.', c, '.', d) AS v4 FROM a)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '::ffff:' || v4 ELSE v4 END AS addr,
      NOT (a IN (10, 127) OR a BETWEEN 224 AND 239 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
        OR (a = 192 AND b = 168) OR (a = 0 AND (b = 0 AND c = 0 AND d = 0 OR event_id % 3 = 0)) OR (a = 240 AND event_id % 3 = 0)
        OR (a = 192 AND b = 0 AND c IN (0, 2) AND event_id % 3 = 0)) AS is_public FROM v"""
)
def public_addresses(spark, d):
    """FN14 over addresses made of the events' numbers, a third of them IPv4 inside IPv6."""
    k = F.col("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    v4 = F.concat_ws(".", pick([10, 100, 127, 169, 172, 192, 0, 8, 223, 224, 240]), pick([0, 16, 31, 32, 64, 127, 128, 168, 254]), k % 256, k * 7 % 256)
    e = table(spark, d, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("::ffff:"), v4)).otherwise(v4).alias("addr"))
    return e.select("event_id", "addr", outcomes.public_address(F.col("addr")).alias("is_public"))


_POLICY = """
    pol AS (SELECT host, [200, 404, 503, 200][k % 4 + 1] AS status,
      CASE WHEN k % 4 = 0 THEN E'User-agent: *\\nDisallow: /item/\\nAllow: /item/old\\nCrawl-delay: 2\\n' ELSE E'User-agent: other\\nDisallow: /\\n\\nUser-agent: millrace\\nDisallow: /wiki/\\n' END AS body
      FROM (SELECT host, length(host) AS k FROM (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM raw_pages)))"""


@query(
    f"""WITH {_POLICY}, q AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM raw_pages)
    SELECT q.host, q.path, CASE WHEN status = 404 THEN true WHEN status = 503 THEN false WHEN starts_with(body, 'User-agent: *') THEN NOT starts_with(path, '/item/') OR starts_with(path, '/item/old')
      ELSE NOT starts_with(path, '/wiki/') END AS allowed, CASE WHEN status = 200 AND starts_with(body, 'User-agent: *') THEN 2000 ELSE 0 END::BIGINT AS crawl_delay_ms
    FROM q JOIN pol USING (host)"""
)
def robots_decisions(spark, d):
    """JN4, DC5, DC6: policies made up for every host of the pages."""
    p = table(spark, d, "raw_pages")
    host = urls.url_host(F.lower("url"))
    pol = p.select(host.alias("host")).distinct().withColumn("k", F.length("host"))
    body = F.when(F.col("k") % 4 == 0, "User-agent: *\nDisallow: /item/\nAllow: /item/old\nCrawl-delay: 2\n").otherwise(
        "User-agent: other\nDisallow: /\n\nUser-agent: millrace\nDisallow: /wiki/\n"
    )
    pol = pol.select("host", F.element_at(F.array(*map(F.lit, [200, 404, 503, 200])), (F.col("k") % 4 + 1).cast("int")).alias("status"), body.alias("body"))
    requests = p.select(host.alias("host"), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1).alias("path")).distinct()
    return outcomes.robots_decisions(requests, written(pol))


@query(
    f"""SELECT page_id, status_code AS status FROM raw_pages WHERE epoch_ms(fetched_at) + CASE WHEN status_code >= 500 THEN 3600000 ELSE 86400000 END
      > (SELECT max(epoch_ms(fetched_at)) - 43200000 FROM raw_pages)"""
)
def fresh_policies(spark, d):
    """SM6, SM7: the fetches of the pages taken as fetches of policies, half a day before the last of them."""
    p = table(spark, d, "raw_pages").select("page_id", F.col("status_code").alias("status"), F.unix_millis("fetched_at").alias("fetched_ms"))
    now = p.agg(F.max("fetched_ms")).first()[0] - 43_200_000
    return outcomes.fresh_policies(p, now).select("page_id", "status")


# --- jobs and metrics

_COUNTER_OF = "['pages_fetched', 'pages_failed', 'pages_skipped', 'fetch_retries', 'pages_parsed', 'pages_duplicate', 'links_enqueued'][event_id % 7 + 1]"


@query(
    f"""WITH e AS (SELECT user_id AS job_id, {_COUNTER_OF} AS c FROM events)
    SELECT job_id, {", ".join(f"count(*) FILTER (c = '{c}') AS {c}" for c in COUNTERS)} FROM e GROUP BY job_id"""
)
def job_counters(spark, d):
    """AG2 over the event log."""
    names = F.array(*map(F.lit, COUNTERS))
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("counter"))
    return jobs.counters(e)


@query(
    """WITH l AS (SELECT user_id AS job_id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 1 ELSE -1 END AS delta, (epoch_us(ts) // 1000) AS at_ms, event_type = 'click' AS claimed FROM events),
    j AS (SELECT job_id, sum(delta) AS outstanding, max(at_ms) FILTER (delta < 0) AS last_finish, bool_or(claimed OR delta < 0) AS began FROM l GROUP BY 1)
    SELECT job_id, outstanding::BIGINT AS outstanding, CASE WHEN outstanding <= 0 THEN 'completed' WHEN began THEN 'running' ELSE 'enqueued' END AS status,
      CASE WHEN outstanding <= 0 THEN last_finish END AS completed_at_ms FROM j"""
)
def job_accounting(spark, d):
    """AG3: events as a log of enqueued and finished items."""
    e = table(spark, d, "events")
    more = F.col("event_type").isin("signup", "view", "click")
    return jobs.accounting(
        e.select(
            F.col("user_id").alias("job_id"),
            F.when(more, 1).otherwise(-1).alias("delta"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
            (F.col("event_type") == "click").alias("claimed"),
        )
    )


@query(
    """SELECT status, count(*) AS jobs, coalesce(sum(outstanding), 0)::BIGINT AS outstanding, coalesce(sum(pages_fetched), 0)::BIGINT AS pages_fetched,
      coalesce(sum(pages_parsed), 0)::BIGINT AS pages_parsed, coalesce(sum(pages_duplicate), 0)::BIGINT AS pages_duplicate FROM jobs GROUP BY status"""
)
def job_states(spark, d):
    """JN6, AG2 over the stored jobs."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return table(spark, d, "jobs").groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), *map(total, ("outstanding", "pages_fetched", "pages_parsed", "pages_duplicate"))
    )


@query(
    """SELECT j.job_id, j.status, j.outstanding FROM jobs j WHERE j.job_id = (SELECT min(job_id) FROM jobs)"""
)
def job_lookup(spark, d):
    """JN6."""
    all_jobs = table(spark, d, "jobs")
    first = all_jobs.agg(F.min("job_id").alias("m")).first()["m"]
    return jobs.job_status(all_jobs, first).select("job_id", "status", "outstanding")


_TOTALS = """count(*) AS documents, coalesce(sum(raw_html_bytes), 0)::BIGINT AS raw_html_bytes, coalesce(sum(markdown_bytes), 0)::BIGINT AS markdown_bytes,
      coalesce(sum(estimated_tokens), 0)::BIGINT AS markdown_tokens"""


@query(f"SELECT {_TOTALS} FROM parsed_documents")
def totals(spark, d):
    """AG1, AG7."""
    return jobs.totals(table(spark, d, "parsed_documents"))


@query(
    f"""WITH t AS (SELECT {_TOTALS} FROM parsed_documents)
    SELECT CASE WHEN raw_html_bytes > 0 THEN floor((1 - markdown_bytes / raw_html_bytes::DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS token_savings_pct,
      round(documents / greatest(1.0, 7.5), 1) AS docs_per_s, documents - 10 AS session_documents FROM t"""
)
def savings_and_speed(spark, d):
    """FN6, AG8 for a session of 7.5 seconds that began at ten documents."""
    t = jobs.totals(table(spark, d, "parsed_documents"))
    s = jobs.throughput(F.col("documents"), F.lit(7.5), F.lit(10))
    return t.select(text.cluster_savings_pct(F.col("markdown_bytes"), F.col("raw_html_bytes")).alias("token_savings_pct"), s["docs_per_s"].alias("docs_per_s"), s["session_documents"].alias("session_documents"))


_METRICS = f"""{_canonical_sql('crawl_targets', 'target_id')},
    m AS (SELECT (SELECT count(*) FROM crawl_targets WHERE attempts = 0) AS pending_queue,
      (SELECT count(DISTINCT lower(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^/?#]+)', 1))) FROM crawl_targets WHERE regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#]')) AS active_hosts,
      (SELECT count(*) FROM jobs WHERE status = 'running') AS in_flight_processing, (SELECT count(*) FROM crawl_targets WHERE attempts > 0) AS delayed_retry,
      (SELECT count(*) FROM dead_letters WHERE queue = 'frontier') AS dead_letter, (SELECT count(*) FROM dead_letters WHERE queue = 'raw_pages') AS raw_pages_dead_letter,
      (SELECT count(*) FROM raw_pages) AS raw_pages_for_parser,
      (SELECT count(*) FROM raw_pages r WHERE NOT EXISTS (SELECT 1 FROM parsed_documents p WHERE p.job_id = r.job_id AND p.url = r.url)) AS raw_pages_in_flight, (SELECT count(DISTINCT canonical) FROM canon) AS unique_urls_seen,
      documents AS parsed_documents_total, markdown_tokens AS total_markdown_tokens_est, markdown_bytes, raw_html_bytes,
      CASE WHEN raw_html_bytes > 0 THEN floor((1 - markdown_bytes / raw_html_bytes::DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS token_savings_pct
      FROM (SELECT {_TOTALS} FROM parsed_documents))"""


@query(f"WITH {_METRICS} SELECT * FROM m")
def cluster_metrics(spark, d):
    """AG4, AG5; unique_urls_seen without hosts outside ASCII (cluster_metrics_idn counts them)."""
    return _cluster_metrics(spark, d, False)


@query()
def cluster_metrics_idn(spark, d):
    return _cluster_metrics(spark, d, True)


def _waiting(spark, d) -> DataFrame:
    """Pages, and those of them without a document yet."""
    p = table(spark, d, "raw_pages").select("job_id", "url")
    done = table(spark, d, "parsed_documents").select("job_id", "url").distinct().withColumn("parsed", F.lit(True))
    return p.join(done, ["job_id", "url"], "left").agg(F.count(F.lit(1)).alias("raw_pages_for_parser"), F.count_if(F.col("parsed").isNull()).alias("raw_pages_in_flight"))


def _cluster_metrics(spark, d, idn: bool) -> DataFrame:
    t, letters = table(spark, d, "crawl_targets"), table(spark, d, "dead_letters")
    host = urls.routing_host(F.col("url"))
    of_targets = t.select("attempts", F.nullif(host, F.lit("")).alias("host"), urls.canonicalize(F.col("url"), idn).alias("c")).agg(
        F.count_if(F.col("attempts") == 0).alias("pending_queue"),
        F.countDistinct("host").alias("active_hosts"),
        F.count_if(F.col("attempts") > 0).alias("delayed_retry"),
        F.countDistinct("c").alias("unique_urls_seen"),
    )
    totals_ = jobs.totals(table(spark, d, "parsed_documents"))
    return jobs.cluster_metrics(
        targets=of_targets,
        jobs=table(spark, d, "jobs").agg(F.count_if(F.col("status") == "running").alias("in_flight_processing")),
        letters=letters.agg(F.count_if(F.col("queue") == "frontier").alias("dead_letter"), F.count_if(F.col("queue") == "raw_pages").alias("raw_pages_dead_letter")),
        pages=_waiting(spark, d),
        totals=totals_.withColumnsRenamed({"documents": "parsed_documents_total", "markdown_tokens": "total_markdown_tokens_est"}),
    )


_LINES = " UNION ALL ".join(
    f"SELECT {3 * k}::INTEGER AS line_no, '# HELP {name} {text_}' AS line UNION ALL SELECT {3 * k + 1}, '# TYPE {name} {kind}' UNION ALL SELECT {3 * k + 2}, '{name} ' || {field} FROM m"
    for k, (kind, name, text_, field) in enumerate([("gauge", *g) for g in jobs.GAUGES] + [("counter", *g) for g in jobs.TOTALS])
)


@query(f"WITH {_METRICS} {_LINES}")
def prometheus_lines(spark, d):
    """SNK7, GEN4."""
    return jobs.prometheus_lines(cluster_metrics(spark, d))


@query()
def prometheus_lines_idn(spark, d):
    return jobs.prometheus_lines(cluster_metrics_idn(spark, d))


@query("SELECT count(DISTINCT url) AS unique_urls_seen FROM parsed_documents")
def unique_urls(spark, d):
    """AG5."""
    return submit.distinct_addresses(table(spark, d, "parsed_documents"))


# --- dead letters


@query("SELECT letter_id, reason, failed_at_ms FROM dead_letters WHERE queue = 'frontier' ORDER BY failed_at_ms DESC, letter_id DESC LIMIT 20")
def newest_letters(spark, d):
    """TK3."""
    return deadletters.newest(table(spark, d, "dead_letters"), "frontier").select("letter_id", "reason", "failed_at_ms")


_REPLAY = """SELECT letter_id, CASE WHEN ok THEN 'replayed' ELSE 'dropped' END AS outcome, CASE WHEN ok THEN payload ->> '$.job_id' END AS job_id,
      CASE WHEN ok THEN payload ->> '$.url' END AS url FROM (SELECT letter_id, failed_at_ms, payload,
        coalesce(json_valid(payload) AND coalesce(CASE WHEN json_valid(payload) THEN payload ->> '$.url' END, '') <> '', false) AS ok FROM dead_letters WHERE queue = 'frontier'{0})"""


@query(_REPLAY.format(" ORDER BY failed_at_ms, letter_id LIMIT 100"))
def replay_oldest(spark, d):
    """TK4, DC9: one request for the oldest hundred."""
    return deadletters.replay_targets(table(spark, d, "dead_letters")).drop("target")


@query(_REPLAY.format(""))
def replay_all(spark, d):
    """DC9 over every letter."""
    return deadletters.replay_targets(table(spark, d, "dead_letters"), None).drop("target")


@query(
    """WITH k AS (SELECT DISTINCT payload FROM dead_letters WHERE queue = 'raw_pages' AND reason <> 'payload missing or expired')
    SELECT letter_id, CASE WHEN payload IN (FROM k) THEN 'replayed' ELSE 'dropped' END AS outcome FROM dead_letters WHERE queue = 'raw_pages'"""
)
def replay_pages(spark, d):
    """JN7: all pages exist but those whose letter says that they do not."""
    letters = table(spark, d, "dead_letters")
    live = letters.filter("queue = 'raw_pages' and reason <> 'payload missing or expired'").select(F.col("payload").alias("page_key"))
    return deadletters.replay_pages(letters, live, None).select("letter_id", "outcome")


@query(
    """SELECT letter_id, coalesce(json_valid(payload) AND json_type(payload, '$.job_id') = 'VARCHAR' AND json_type(payload, '$.url') = 'VARCHAR'
      AND json_type(payload, '$.depth') IN ('UBIGINT', 'BIGINT') AND json_type(payload, '$.max_depth') IN ('UBIGINT', 'BIGINT'), false) AS good
      FROM (SELECT letter_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM dead_letters WHERE queue = 'frontier')"""
)
def letter_validity(spark, d):
    """The good and the malformed targets (DC7 for targets, SRC8's unparseable rows)."""
    letters = table(spark, d, "dead_letters").filter("queue = 'frontier'").select("letter_id", "payload")
    good, bad = deadletters.split_targets(letters)
    return good.select("letter_id", F.lit(True).alias("good")).unionByName(bad.select("letter_id", F.lit(False).alias("good")))


@query(
    """SELECT target_id, 'unroutable' AS reason, 1770000000000::BIGINT AS failed_at_ms FROM crawl_targets WHERE NOT regexp_matches(coalesce(url, ''), '^[hH][tT][tT][pP][sS]?://[^/?#]')"""
)
def dead_letter_append(spark, d):
    """SNK9, DC4."""
    dead = frontier.route(table(spark, d, "crawl_targets").select("target_id", "url"))[1]
    e = deadletters.envelope(dead, F.col("payload"), F.col("reason"), F.lit(NOW_MS))
    return e.select(F.get_json_object("payload", "$.target_id").cast("long").alias("target_id"), "reason", "failed_at_ms")


# --- documents out


@query("SELECT parsed_id, url, estimated_tokens FROM parsed_documents ORDER BY parsed_at DESC, parsed_id DESC LIMIT 10")
def latest_documents(spark, d):
    """SRC8, TK2."""
    return sinks.newest_documents(table(spark, d, "parsed_documents")).select("parsed_id", "url", "estimated_tokens")


@query("SELECT parsed_id FROM parsed_documents ORDER BY parsed_at DESC, parsed_id DESC LIMIT 500")
def retained_documents(spark, d):
    """SNK1, TK5 with a cap of 500."""
    return sinks.retained(table(spark, d, "parsed_documents").select("parsed_id", "parsed_at"), 500).select("parsed_id")


@query(
    r"""SELECT job_id || '/' || left(sha1(url), 16) || '.md' AS path, md5('---' || E'\nurl: ' || url || E'\ntitle: "' || replace(coalesce(title, ''), '"', '\"') || E'"\njob_id: ' || job_id
      || E'\nparsed_at: ' || (epoch_us(parsed_at) // 1000) || E'\nestimated_tokens: ' || estimated_tokens || E'\n---\n\n' || coalesce(markdown, '')) AS content_md5 FROM parsed_documents"""
)
def markdown_files(spark, d):
    """SNK2, FN17."""
    files = sinks.markdown_files(table(spark, d, "parsed_documents"), F.unix_millis("parsed_at"))
    return files.select("path", F.md5("content").alias("content_md5"))


_EXPORTED = ["parsed_id", "url", "title", "meta_description", "extracted_links", "markdown", "estimated_tokens", "language"]


@query("SELECT parsed_id, md5(to_json({" + ", ".join(f"'{c}': {c}" for c in _EXPORTED) + "})::VARCHAR) AS json_md5 FROM parsed_documents")
def document_export(spark, d):
    """SNK3, SNK6: the JSON of every document, whole."""
    return table(spark, d, "parsed_documents").select("parsed_id", F.md5(sinks.document_json(_EXPORTED)).alias("json_md5"))


@query("SELECT count(*) AS total_count, coalesce(sum(strlen(to_json({" + ", ".join(f"'{c}': {c}" for c in _EXPORTED) + "})::VARCHAR)), 0)::BIGINT AS json_bytes FROM parsed_documents")
def export_count(spark, d):
    """The head of SNK3: how many documents, and the bytes of their JSON."""
    return sinks.export_summary(table(spark, d, "parsed_documents"), _EXPORTED)


_SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"


@query(
    rf"""WITH b AS (SELECT *, {_SITE} AS site FROM parsed_documents),
    i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY parsed_at DESC, parsed_id DESC) AS idx, count(*) OVER (PARTITION BY site) AS of FROM b),
    h AS (SELECT *, coalesce(nullif(title, ''), 'Document ' || idx) AS t, E'---\nurl: ' || url || E'\ntitle: "' || replace(coalesce(nullif(title, ''), 'Untitled Document'), '"', '\"')
      || E'"\ndescription: "' || replace(coalesce(meta_description, ''), '"', '\"') || E'"\nlanguage: ' || coalesce(language, 'en') || E'\nestimated_tokens: ' || estimated_tokens
      || E'\ntoken_savings: -' || token_savings_pct || E'%\nparsed_at: ' || (epoch_us(parsed_at) // 1000) || E'\n---\n\n' AS head FROM i)
    SELECT site, idx, of, regexp_replace(site, '[^A-Za-z0-9_\-]', '_', 'g') || '/' || regexp_replace(site, '[^A-Za-z0-9_\-]', '_', 'g') || CASE WHEN of = 1 THEN '.md' ELSE '_combined.md' END AS path,
      CASE WHEN of > 1 THEN idx || '. [' || t || '](#doc-' || idx || ') - `' || url || '`' END AS contents_line,
      md5(CASE WHEN of = 1 THEN head || coalesce(markdown, '') ELSE '<a name="doc-' || idx || E'"></a>\n## [' || idx || '/' || of || '] ' || t || E'\n> URL: ' || url || ' | Tokens: ~' || estimated_tokens
        || ' | Savings: -' || token_savings_pct || E'%\n\n' || head || E'\n' || coalesce(markdown, '') || E'\n\n\n---\n' END) AS content_md5 FROM h"""
)
def site_bundles(spark, d):
    """SNK4."""
    parts = sinks.bundle_parts(table(spark, d, "parsed_documents"), urls.site(F.col("url")), F.unix_millis("parsed_at"))
    return parts.withColumn("content_md5", F.md5("content")).drop("content")


@query(
    rf"""WITH s AS (SELECT {_SITE} AS site, count(*) AS documents, coalesce(sum(estimated_tokens), 0)::BIGINT AS tokens FROM parsed_documents GROUP BY 1)
    SELECT *, '# Knowledge base: ' || site || E'\n- **Total Documents:** ' || documents || E'\n- **Total Estimated LLM Tokens:** ~' || tokens
      || E'\n\n## Table of Contents' AS head FROM s"""
)
def bundle_heads(spark, d):
    """SNK4, AG7."""
    return sinks.bundle_heads(table(spark, d, "parsed_documents"), urls.site(F.col("url")))


@query("SELECT parsed_id FROM parsed_documents WHERE coalesce(language, '') IN ('fa', 'de', '')")
def language_filter(spark, d):
    """DC11."""
    return sinks.in_languages(table(spark, d, "parsed_documents").select("parsed_id", "language"), ["fa", "de"]).select("parsed_id")


@query(
    """SELECT page_id, job_id || '/' || left(sha256(url || '|' || page_id), 16) AS page_key FROM raw_pages"""
)
def claim_checks(spark, d):
    """SNK8."""
    return sinks.claim_checks(table(spark, d, "raw_pages").select("page_id", "job_id", "url")).select("page_id", "page_key")


@query(
    """SELECT page_id, (epoch_us(fetched_at) // 1000) + 604800000 > 1770000000000 AS live FROM raw_pages"""
)
def payload_lookup(spark, d):
    """JN3, SM6: page keys against the payloads that have not expired."""
    p = sinks.claim_checks(table(spark, d, "raw_pages").select("page_id", "job_id", "url", F.unix_millis("fetched_at").alias("fetched_ms")))
    live = pipeline.live(p, "fetched_ms", DEFAULTS.page_ttl_ms, NOW_MS).select("page_key")
    found, missing = deadletters.page_payloads(p.select("page_id", "page_key"), live)
    return found.select("page_id", F.lit(True).alias("live")).unionByName(missing.select("page_id", F.lit(False).alias("live")))


# --- pages


@query()
def parsed_pages(spark, d):
    """HT1-HT19, FN1-FN5, JN2: the flagship. Pages to documents, duplicates by content out."""
    docs = extract.first_of_content(written(extract.documents(table(spark, d, "raw_pages"))))
    return docs.filter("error is null and not is_duplicate").select(
        "page_id", "job_id", "url", "title", "meta_description", "language", "metadata", "extracted_links", "text_sample", "markdown",
        "fingerprint", "estimated_tokens", "raw_html_bytes", "markdown_bytes", "token_savings_pct",
    )


def _unescaped(c: str) -> str:
    """Named entities, and decimal ones of Latin-1, Cyrillic and Arabic, decoded in SQL."""
    c = f"replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160))"
    return (
        f"replace(list_aggregate(list_transform(regexp_extract_all({c}, '&#[0-9]+;|[^&]+|&'), lambda x: CASE WHEN regexp_matches(x, '^&#[0-9]+;$')"
        " THEN chr(try_cast(regexp_extract(x, '[0-9]+') AS INTEGER)) ELSE x END), 'string_agg', ''), '&amp;', '&')"
    )



@query(
    f"""SELECT page_id, coalesce({_trim(_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
      CASE WHEN regexp_matches(html, '(?i)<html[^>]*lang=') THEN lower(regexp_extract(html, '(?i)<html[^>]*lang="?([A-Za-z]+)', 1)) END AS lang_attr FROM raw_pages"""
)
def page_titles(spark, d):
    """HT2, HT5: titles, and languages where the page states one."""
    e = extract.extract(table(spark, d, "raw_pages").select("page_id", "html", F.col("html").rlike("(?i)<html[^>]*lang=").alias("says")))
    return e.select("page_id", "title", F.when(F.col("says"), F.col("language")).alias("lang_attr"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<a\s[^>]*href=')) AS hrefs FROM raw_pages"""
)
def page_hrefs(spark, d):
    """URL11, before resolution: links of every page, those in menus and footers included."""
    return extract.extract(table(spark, d, "raw_pages").select("page_id", "html")).select("page_id", F.size("hrefs").cast("long").alias("hrefs"))


@query()
def page_markdown(spark, d):
    """HT6-HT19."""
    return extract.documents(table(spark, d, "raw_pages")).select("page_id", "text_sample", "markdown", "fingerprint")


@query(
    rf"""SELECT page_id, coalesce({_trim(_unescaped("regexp_extract(html, '(?is)<meta name=.description. content=.([^>]*).>', 1)"))}, '') AS meta_description,
      len(regexp_extract_all(html, '(?i)<meta +(property|name)=.(og:|twitter:|article:|author|date|pubdate|application-name)'))::BIGINT AS keys FROM raw_pages"""
)
def page_metadata(spark, d):
    """HT3, HT4: descriptions, and how many keys of metadata there are."""
    e = extract.extract(table(spark, d, "raw_pages").select("page_id", "html"))
    return e.select("page_id", "meta_description", F.size("metadata").cast("long").alias("keys"))


_ASSET_PATH = r"lower(regexp_extract(canonical, '^https?://[^/?#]*([^?#]*)', 1))"
_RESOLVED = rf"""
    pg AS (SELECT page_id, job_id, url, depth, max_depth, stay_in_domain, scope_host, regexp_extract({_trim('url')}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS root,
        unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<a\s[^>]*?href=[\x22\x27]?([^\x22\x27\s>]*)', 1)) AS href FROM raw_pages),
    hr AS (SELECT row_number() OVER () AS i, *, CASE WHEN href[1] = '/' AND href[2] <> '/' THEN root || href ELSE href END AS whole FROM pg WHERE href[1] <> '#'),
    {_canonical_sql('hr', 'i', 'whole')},
    ow AS (SELECT row_number() OVER () AS i, url FROM (SELECT DISTINCT url FROM raw_pages)),
    {_canonical_sql('ow', 'i').replace('p0', 'q0').replace('p1', 'q1').replace('p2', 'q2').replace('p3', 'q3').replace('p4', 'q4').replace('canon AS', 'own0 AS')},
    own AS (SELECT ow.url, own0.canonical AS self FROM ow JOIN own0 ON own0.k = ow.i),
    ln AS (SELECT DISTINCT page_id, job_id, depth, max_depth, stay_in_domain, scope_host, c.canonical FROM hr JOIN canon c ON c.k = hr.i JOIN own USING (url)
      WHERE c.canonical IS NOT NULL AND c.canonical IS DISTINCT FROM own.self AND NOT regexp_matches({_ASSET_PATH}, '{_ASSET}')
        AND (NOT coalesce(stay_in_domain, false) OR {_scope_sql("regexp_extract(c.canonical, '^https?://([^/?#:]*)', 1)", "coalesce(nullif(scope_host, ''), regexp_extract(lower(hr.url), '^ *https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))")}))"""


@query(f"WITH {_RESOLVED} SELECT page_id, list(canonical ORDER BY canonical) AS links FROM ln GROUP BY page_id")
def page_links(spark, d):
    """URL11, TK1: the links of every page that may be followed, each once, in order."""
    return extract.documents(table(spark, d, "raw_pages")).select("page_id", F.col("extracted_links").alias("links")).filter("size(links) > 0")


@query(
    f"""WITH {_RESOLVED}, ch AS (SELECT canonical AS url, job_id, depth + 1 AS depth, max_depth, stay_in_domain, scope_host,
        row_number() OVER (PARTITION BY canonical ORDER BY depth, job_id, max_depth NULLS FIRST, stay_in_domain NULLS FIRST, scope_host NULLS FIRST) AS rn FROM ln WHERE depth + 1 <= max_depth)
    SELECT job_id, depth::INTEGER AS depth, max_depth, 5::INTEGER AS priority, stay_in_domain, scope_host, url FROM ch
    WHERE rn = 1 AND url NOT IN (SELECT self FROM own WHERE self IS NOT NULL)"""
)
def page_children(spark, d):
    """URL11, URL13, GEN3, TK1: new targets from the links of pages, less the pages' own addresses."""
    pages = table(spark, d, "raw_pages")
    docs = written(extract.documents(pages).select("job_id", "url", "depth", "max_depth", "stay_in_domain", "scope_host", "extracted_links"))
    return submit.children(docs, docs.select(urls.canonicalize(F.col("url")).alias("url")).distinct())


@query(
    """WITH l AS (SELECT job_id, url AS page, unnest(extracted_links) AS url FROM parsed_documents),
    g AS (SELECT url, min(job_id) AS job_id FROM l GROUP BY url)
    SELECT url, job_id FROM g WHERE url NOT IN (SELECT url FROM parsed_documents WHERE url IS NOT NULL)"""
)
def child_targets(spark, d):
    """URL13, GEN3, JN1, ST3 over the stored links of all documents, each address once."""
    p = table(spark, d, "parsed_documents")
    docs = p.select(
        "job_id", "extracted_links", F.lit(0).alias("depth"), F.lit(1).alias("max_depth"), F.lit(True).alias("stay_in_domain"), F.lit("").alias("scope_host")
    )
    return submit.children(docs, p.select("url")).select("url", "job_id")


@query(
    """SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'payload missing or expired' WHEN page_id % 11 = 0 THEN 'malformed RawPage: no JSON'
      WHEN page_id % 7 = 0 THEN 'malformed RawPage: ' || CASE WHEN url IS NULL THEN 'url, ' ELSE '' END || 'html field required' ELSE NULL END AS reason FROM raw_pages"""
)
def page_letters(spark, d):
    """DC7: which claimed payloads are pages. Some are cut, some lack their html, some are gone."""
    good, dead = _claimed_pages(spark, d)
    return dead.unionByName(good.select("page_id", F.lit(None).cast("string").alias("reason")))


def _claimed_pages(spark, d) -> tuple[DataFrame, DataFrame]:
    p, k = table(spark, d, "raw_pages"), F.col("page_id")
    fields = [f.split()[0] for f in RAW_PAGE.split(", ")]
    whole = F.to_json(F.struct(*[F.when(k % 7 != 0, F.col(c)).alias(c) if c == "html" else F.col(c) for c in fields]))
    payload = F.when(k % 13 != 0, F.when(k % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole))
    return deadletters.split_pages(p.select("page_id", payload.alias("payload")))


@query()
def parse_outcomes(spark, d):
    """DC7: what becomes of every claimed page: committed, duplicate, or dead (also if it is no page at all)."""
    good, dead = _claimed_pages(spark, d)
    docs = extract.documents(good).select("page_id", "fetched_at", "fingerprint", "error")
    docs = extract.first_of_content(written(docs))
    outcome = F.when(F.col("error").isNotNull(), "dead").when(F.col("is_duplicate"), "duplicate").otherwise("commit")
    every = docs.select("page_id", outcome.alias("outcome")).unionByName(dead.select("page_id", F.lit("dead").alias("outcome")))
    return every.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


@query()
def streamed_documents(spark, d):
    """SM1, SM2, SM3, SM5, SRC7: the pages as a stream to the end, and what was committed."""
    from millrace.session import shared_dir
    from uuid import uuid4

    root = f"{shared_dir(spark)}/millrace/stream-{uuid4().hex}"
    source = table(spark, d, "raw_pages")
    pipeline.run_pages(spark, f"{d}/raw_pages.parquet", source.schema, root, files_per_batch=16).awaitTermination()
    return pipeline.committed(spark, root, "documents").select("page_id", "url", "title", "fingerprint", "estimated_tokens")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
