"""The continuous form: raw pages stream in, documents, totals, children and counters are committed.

Every output of a micro-batch goes below its own batch number and is overwritten when the batch is run
again, the commit mark last: a batch that is redelivered after a failure has the effect of one. Content
seen in earlier batches is anti-joined from the committed fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import storage
from millrace.operators import extract, frontier, jobs, outcomes, submit
from millrace.session import written
from millrace.settings import DEFAULTS, Settings


def page_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Raw pages as they arrive in a folder (or the one file that is given)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if storage.is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """What was committed below root/name; None before the first commit."""
    there = set(storage.names(spark, f"{root}/{name}"))
    paths = [f"{root}/{name}/{at}" for at in storage.names(spark, f"{root}/commits") if at in there]
    return spark.read.parquet(*paths) if paths else None


def commit_batch(root: str) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: pages of one batch to documents, children, counters, totals."""

    def run(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        at = f"batch_id={batch_id}"
        storage.delete(spark, f"{root}/commits/{at}")

        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{root}/{name}/{at}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        parsed = put(extract.documents(pages), "parsed")
        docs = extract.first_of_content(parsed)
        before = committed(spark, root, "documents")
        if before is not None:
            known = before.select("fingerprint").filter("fingerprint <> ''").distinct().withColumn("known", F.lit(True))
            docs = docs.join(known, "fingerprint", "left").withColumn("is_duplicate", F.col("is_duplicate") | F.coalesce("known", F.lit(False))).drop("known")
        docs = put(docs, "judged")
        kept = put(docs.filter("error is null and not is_duplicate").drop("is_duplicate"), "documents")
        seen = committed(spark, root, "children")
        children = put(submit.children(kept, seen), "children")
        events = (
            docs.select("job_id", F.when(F.col("error").isNotNull(), "pages_failed").when(F.col("is_duplicate"), "pages_duplicate").otherwise("pages_parsed").alias("counter"))
            .unionByName(children.select("job_id", F.lit("links_enqueued").alias("counter")))
        )
        put(jobs.counters(events), "counters")
        put(jobs.totals(kept), "totals")
        storage.touch(spark, f"{root}/commits/{at}")

    return run


def run_pages(spark: SparkSession, source: str, schema, root: str, files_per_batch: int = 1, continuous: str | None = None) -> StreamingQuery:
    """Start the stream: all that is there (availableNow), or on a processing-time trigger."""
    writer = page_stream(spark, source, schema, files_per_batch).writeStream.foreachBatch(commit_batch(root)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def distinct_content(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed deduplication in stream state, without expiry."""
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window with a watermark, for monitoring; late rows beyond it are dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def live(rows: DataFrame, at: str, ttl_ms: int, now_ms: int) -> DataFrame:
    """Rows whose time to live has not run out."""
    return rows.filter(F.col(at) + F.lit(ttl_ms) > now_ms)


def crawl(step: Callable[[int], int], max_pages: int) -> int:
    """Driver loop of micro-batches: step(n) handles one and returns its pages; stops after max_pages or
    when nothing is left. Returns the pages handled."""
    done = n = 0
    while done < max_pages:
        got = step(n)
        if not got:
            break
        done, n = done + got, n + 1
    return done


def turn(
    state: dict[str, DataFrame], fetch: Callable[[DataFrame], DataFrame], now_ms: int, s: Settings = DEFAULTS, tie: str = "target_id", stopping: bool = False
) -> dict[str, DataFrame]:
    """One turn of the crawl over tables, in the order of a worker: retries that are due are promoted, the best
    target of every ready host is claimed and fetched, the outcomes are settled.

    state: `scheduled` targets with host and score, `delayed` the same with not_before_ms, `hosts` (host,
    ready_at_ms). fetch adds what fetch_outcomes reads; with stopping=True nothing is fetched and claims are
    released. The result: the new state, and `pages` (to the parser), `dead`, `counters` of this turn."""
    due = written(frontier.due_retries(state["delayed"], now_ms, tie, s.promote_batch))
    delayed = state["delayed"].join(due.select(tie), tie, "left_anti")
    scheduled = written(state["scheduled"].unionByName(due.drop("not_before_ms")))
    claims = written(frontier.next_claims(scheduled, state["hosts"], now_ms, tie))
    if stopping:
        settled = {"release": claims}
        return state | {"scheduled": scheduled, "delayed": written(delayed), "pages": claims.limit(0), "dead": claims.limit(0)} | settled
    told = written(outcomes.fetch_outcomes(fetch(claims), s))
    to = frontier.settle(told)
    columns = scheduled.columns
    again = to["delay"].withColumn("attempts", (F.coalesce("attempts", F.lit(0)) + 1).cast("int")).withColumn("not_before_ms", F.lit(now_ms) + F.col("delay_ms"))
    contacted = told.select("host", (F.lit(now_ms) + F.col("gap_ms")).alias("next_ms"))
    hosts = state["hosts"].join(contacted, "host", "full_outer").select("host", F.coalesce("next_ms", "ready_at_ms").alias("ready_at_ms"))
    return {
        "scheduled": written(scheduled.join(claims.select(tie), tie, "left_anti")),
        "delayed": written(delayed.unionByName(again.select(*columns, "not_before_ms"))),
        "hosts": written(hosts),
        "pages": to["push"],
        "dead": to["dead"].select(tie, "reason"),
        "counters": told.groupBy("counter").agg(F.count(F.lit(1)).alias("n")),
        "release": claims.limit(0),
    }
