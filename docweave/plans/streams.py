"""Queries over time and state: admission, ingest, sessions and latency windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import chunking
from docweave.plans.catalog import query
from docweave.plans.frames import Frames
from docweave.runtime import materialize, shared_dir
from docweave.streaming import admission, jobs


def _stream(spark, sf: str, table: str):
    """A table as a stream; it may be one file or a folder of files. As a pattern the path may name either."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def requests(events):
    return events.select("event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


# The walk of one user event by event; the list holds the admitted times of the window.
ADMISSION_SQL = """
    WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (
      SELECT key, n, event_id, at_us, true AS admitted, 0.0::DOUBLE AS retry_after_s, [at_us] AS held FROM e WHERE n = 1
      UNION ALL
      SELECT key, n, event_id, at_us, len(live) < {limit}, CASE WHEN len(live) < {limit} THEN 0.0 ELSE (live[1] + {window} - at_us) / 1e6 END,
             CASE WHEN len(live) < {limit} THEN list_append(live, at_us) ELSE live END
      FROM (SELECT e.*, list_filter(w.held, lambda h: h > e.at_us - {window}) AS live FROM walk w JOIN e ON e.key = w.key AND e.n = w.n + 1))
    SELECT event_id, key, at_us, admitted, retry_after_s, false AS late FROM walk"""
TWO_A_DAY = ADMISSION_SQL.format(limit=2, window=86_400_000_000)


@query("admission_batch", sql=TWO_A_DAY)
def admission_batch(spark, sf):
    """At most two admitted events per user and day."""
    return admission.admission_batch(requests(Frames(spark, sf).table("events")), 2, 86400)


@query("admission_dense", sql=ADMISSION_SQL.replace("user_id", "0").format(limit=3, window=3_600_000_000).replace("PARTITION BY 0 ", ""))
def admission_dense(spark, sf):
    """Three events an hour for all users together: one key that holds every event."""
    events = requests(Frames(spark, sf).table("events")).withColumn("key", F.lit(0).cast("long"))
    return admission.admission_dense(events, 3, 3600, 1000)


@query("admission_event_time", sql=TWO_A_DAY)
def admission_event_time(spark, sf):
    """The same decisions for events that arrive up to six hours late, in four deliveries, and a closing event that lets the watermark pass."""
    delay_s, deliveries = 6 * 3600, 4
    events = requests(Frames(spark, sf).table("events"))
    arrived = materialize(events.withColumn("arrival", F.col("at_us") + F.pmod(F.xxhash64("event_id"), F.lit(delay_s * 1_000_000))))
    first, last = arrived.agg(F.min("arrival"), F.max("arrival")).first()
    if first is None:
        first = last = 0
    delivery = F.floor((F.col("arrival") - first) * deliveries / (last - first + 1))
    parts = [arrived.where(delivery == number).drop("arrival") for number in range(deliveries)]
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("key"),
                                    F.lit(last + (delay_s + 2 * 86400) * 1_000_000).cast("long").alias("at_us"))
    decided = jobs.replay([*parts, closing], lambda stream: admission.admission_event_time(stream, 2, 86400, delay_s))
    return decided.where("key >= 0")


@query("admission_per_minute", sql="""
    SELECT event_id, true AS admitted FROM events e WHERE (
      SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.ts <= e.ts AND o.ts > e.ts - INTERVAL 60 SECOND) <= 10""")
def admission_per_minute(spark, sf):
    """Ten per minute: the events are sparse enough that the plain count decides."""
    rows = admission.admission_batch(requests(Frames(spark, sf).table("events")), 10, 60)
    return rows.where("admitted").select("event_id", "admitted")


@query("admission_stream", sql=TWO_A_DAY)
def admission_stream(spark, sf):
    return jobs.run_to_table(admission.admission_stream(requests(_stream(spark, sf, "events")), 2, 86400))


def uploads(df):
    return df.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.octet_length("text").cast("long").alias("size_bytes"),
                     F.lit("text/plain").alias("content_type"), "text")


@query("stream_ingest", sql="""
    SELECT min(doc_id) AS document_id FROM documents GROUP BY sha256(text)""")
def stream_ingest(spark, sf):
    """Documents that reach the index: one per distinct text."""
    target = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    jobs.stream_ingest(uploads(_stream(spark, sf, "documents")), target, "\n").awaitTermination()
    return jobs.current_chunks(spark, target).select("document_id").distinct()


@query("stream_ingest_chunks")
def stream_ingest_chunks(spark, sf):
    target = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    jobs.stream_ingest(uploads(_stream(spark, sf, "documents")), target, "\n").awaitTermination()
    return jobs.current_chunks(spark, target).select("document_id", "seq", "token_count", "content")


def sessions(events):
    """The first signup of a user opens a session of 168 hours."""
    opened = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("token")).agg(F.min("ts").alias("opened_at"))
    return opened.withColumn("expires_at", F.col("opened_at") + F.expr("INTERVAL 168 HOURS"))


SESSION_SQL = """
    WITH s AS (SELECT user_id AS token, min(ts) AS opened_at FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT e.event_id, e.user_id AS token FROM events e JOIN s ON s.token = e.user_id
    WHERE e.ts >= s.opened_at AND e.ts < s.opened_at + INTERVAL 168 HOUR"""


@query("active_sessions", sql=SESSION_SQL)
def active_sessions(spark, sf):
    events = Frames(spark, sf).table("events")
    return jobs.active_sessions(events.withColumnRenamed("user_id", "token"), sessions(events)).select("event_id", "token")


@query("active_sessions_stream", sql=SESSION_SQL)
def active_sessions_stream(spark, sf):
    static = sessions(Frames(spark, sf).table("events"))
    stream = _stream(spark, sf, "events").withColumnRenamed("user_id", "token")
    return jobs.run_to_table(jobs.active_sessions(stream, static).select("event_id", "token"))


@query("purge_sessions", sql="""
    SELECT user_id AS token FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING min(ts) + INTERVAL 168 HOUR > TIMESTAMP '2024-01-10 00:00:00'""")
def purge_sessions(spark, sf):
    return jobs.purge_expired(sessions(Frames(spark, sf).table("events")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("token")


def event_turns(events):
    """Events as a turn log: errors fail, signups carry no model time."""
    kind = F.col("event_type")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "error", "error").otherwise("ok").alias("status"),
                         F.when(kind != "signup", F.round(F.col("value") * 100).cast("long")).alias("latency_ms"),
                         F.round(F.col("value") * 10).cast("long").alias("retrieval_ms"), F.when(kind == "view", F.col("event_id") % 97).alias("completion_tokens"))


WINDOW_SQL = """
    WITH t AS (SELECT date_trunc('day', ts) AS w, event_type = 'error' AS failed, CASE WHEN event_type NOT IN ('signup', 'error') THEN CAST(round(value * 100) AS BIGINT) END AS m,
                      CAST(round(value * 10) AS BIGINT) AS r, CASE WHEN event_type = 'view' THEN event_id % 97 END AS k, event_type = 'signup' AS refused FROM events),
    g AS (SELECT w, count(*) AS turns, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE refused) AS refusals, count(m) AS model_ms_samples, max(m) AS model_ms_max,
                 list_sort(list(m) FILTER (WHERE m IS NOT NULL)) AS ms, list_sort(list(r)) AS rs FROM t GROUP BY w)
    SELECT strftime(w, '%Y-%m-%d') AS day, turns, errors, refusals, model_ms_samples, model_ms_max, ms[CAST(ceil(0.5 * len(ms)) AS BIGINT)] AS model_ms_p50,
           ms[CAST(ceil(0.95 * len(ms)) AS BIGINT)] AS model_ms_p95, rs[CAST(ceil(0.95 * len(rs)) AS BIGINT)] AS retrieval_p95 FROM g"""
WINDOW_COLUMNS = ["turns", "errors", "refusals", "model_ms_samples", "model_ms_max", "model_ms_p50", "model_ms_p95", "retrieval_p95"]


@query("latency_windows", sql=WINDOW_SQL)
def latency_windows(spark, sf):
    rows = jobs.latency_windows(event_turns(Frames(spark, sf).table("events")))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *WINDOW_COLUMNS)


@query("latency_stream", sql=WINDOW_SQL + """
    WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def latency_stream(spark, sf):
    """Windows that the watermark has closed."""
    rows = jobs.run_to_table(jobs.latency_windows(event_turns(_stream(spark, sf, "events"))))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *WINDOW_COLUMNS)


@query("chunk_batch_build")
def chunk_batch_build(spark, sf):
    """The batch twin of the streaming ingest: deduplicate, then chunk."""
    from docweave.operators import ingest
    docs = uploads(Frames(spark, sf).table("documents")).withColumn("sha256", F.sha2("text", 256))
    unique = ingest.dedup_exact(docs).where("NOT is_duplicate")
    return chunking.chunk_documents(unique, separator="\n")[0].select("document_id", "seq", "token_count", "content")
