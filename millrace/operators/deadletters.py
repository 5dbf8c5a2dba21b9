"""Dead letters: reading, appending, replay; payload lookups of claimed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import CRAWL_TARGET, RAW_PAGE
from millrace.settings import DEFAULTS


def newest(letters: DataFrame, queue: str, limit: int = DEFAULTS.dead_letters_limit, tie: str = "letter_id") -> DataFrame:
    return letters.filter(F.col("queue") == queue).orderBy(F.desc("failed_at_ms"), F.desc(tie)).limit(limit)


def envelope(items: DataFrame, payload: Column, reason: Column, failed_at_ms: Column) -> DataFrame:
    return items.select(payload.alias("payload"), reason.alias("reason"), failed_at_ms.cast("long").alias("failed_at_ms"))


def replay_targets(letters: DataFrame, count: int | None = DEFAULTS.replay_count, tie: str = "letter_id") -> DataFrame:
    """The oldest `count` frontier letters with what becomes of them: replayed (attempts reset, in `target`)
    if the payload reads as an object with an address, else dropped. count=None takes all letters."""
    old = letters.filter("queue = 'frontier'")
    if count is not None:
        old = old.orderBy("failed_at_ms", tie).limit(count)
    # The payload goes back as it was, only attempts change: fields of a wrong type stay as they are.
    fields = F.from_json("payload", "map<string,string>")
    good = (F.coalesce(F.get_json_object("payload", "$.url"), F.lit("")) != "") & fields.isNotNull()
    t = F.from_json("payload", CRAWL_TARGET)
    return old.select(
        tie,
        F.when(good, "replayed").otherwise("dropped").alias("outcome"),
        F.when(good, F.get_json_object("payload", "$.job_id")).alias("job_id"),
        F.when(good, F.get_json_object("payload", "$.url")).alias("url"),
        F.when(good, F.to_json(t.withField("attempts", F.lit(0)))).alias("target"),
    )


def replay_pages(letters: DataFrame, pages: DataFrame, count: int | None = DEFAULTS.replay_count, tie: str = "letter_id") -> DataFrame:
    """The oldest page letters, replayed if their payload (the page key) still exists."""
    old = letters.filter("queue = 'raw_pages'")
    if count is not None:
        old = old.orderBy("failed_at_ms", tie).limit(count)
    live = pages.select(F.col("page_key").alias("payload")).distinct().withColumn("live", F.lit(True))
    return old.join(live, "payload", "left").select(tie, "payload", F.when(F.col("live"), "replayed").otherwise("dropped").alias("outcome"))


def split_targets(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows) of target JSON: from_json gives null for a wrong type, so the required
    fields are tested one by one."""
    t = raw.withColumn("t", F.from_json(column, CRAWL_TARGET))
    good = F.col("t").isNotNull()
    for f in ("job_id", "url", "depth", "max_depth"):
        good = good & F.col(f"t.{f}").isNotNull()
    return t.filter(good).select(*raw.columns, "t.*"), t.filter(~F.coalesce(good, F.lit(False))).select(*raw.columns)


def page_payloads(ids: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with their page, ids whose payload is missing or expired)."""
    return ids.join(pages, "page_key"), ids.join(pages.select("page_key"), "page_key", "left_anti")


def malformed_pages(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Raw page JSON with error: the reason of the dead letter, or null."""
    p = F.from_json(column, RAW_PAGE)
    missing = F.array_compact(F.array(*[F.when(p[f].isNull(), F.lit(f)) for f in ("job_id", "url", "status_code", "depth", "max_depth", "html")]))
    # A cut payload reads as a record of nulls; only the parser tells that it is no JSON at all.
    error = F.when(p.isNull() | F.try_parse_json(column).isNull(), "malformed RawPage: no JSON").when(
        F.size(missing) > 0, F.concat(F.lit("malformed RawPage: "), F.array_join(missing, ", "), F.lit(" field required"))
    )
    return raw.withColumn("error", error)


def split_pages(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(pages read from their JSON, dead letters with their reason) of claimed payloads; a null payload is one that is
    missing or has expired."""
    told = malformed_pages(raw, column)
    reason = F.when(F.col(column).isNull(), "payload missing or expired").otherwise(F.col("error"))
    told = told.withColumn("reason", reason).drop("error")
    others = [c for c in raw.columns if c != column]
    good = told.filter("reason is null").withColumn("p", F.from_json(column, RAW_PAGE)).select(*others, "p.*")
    return good, told.filter("reason is not null").select(*others, "reason")


def job_key_of_json(item: Column) -> Column:
    return F.get_json_object(item, "$.job_id")


def job_key_of_page(page_key: Column) -> Column:
    return F.nullif(F.regexp_extract(page_key, "^([^/]+)/", 1), F.lit(""))
