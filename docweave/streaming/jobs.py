"""Structured Streaming jobs: ingest, session checks and latency windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from docweave.operators import chunking, index, ingest
from docweave.operators.corpus import latency_figures, latency_samples
from docweave.runtime import salted_join, shared_dir


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into a parquet table of the shared folder and read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    job = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
           .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replay(arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed a streaming transformation one frame after the other and return all it appended.

    Each frame is written to a source folder and processed by a run that goes on from the checkpoint of the one
    before, as a job does that is restarted between deliveries.
    """
    spark = arrivals[0].sparkSession
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    for frame in arrivals:
        frame.write.mode("append").parquet(f"{base}/in")
        made = transform(spark.readStream.schema(frame.schema).parquet(f"{base}/in"))
        job = (made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
               .trigger(availableNow=True).start())
        job.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


# --- ingest -------------------------------------------------------------------------------------


def _known(spark, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of earlier batches; a repeated batch does not see its own first attempt."""
    try:
        rows = spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("batch_id") < batch_id)


def ingest_batch(batch: DataFrame, batch_id: int, target: str, separator: str = r"\n\s*\n") -> None:
    """Validate, deduplicate against everything known, chunk and index one batch.

    Each table is partitioned by batch and a batch overwrites only its own partition, so a repeated
    batch leaves the same result. A document id seen again with new content replaces its chunks at
    read time, see ``current_chunks``.
    """
    spark = batch.sparkSession
    valid, refused = ingest.split_valid(ingest.validate_documents(batch.withColumn("sha256", F.sha2("text", 256))))
    known = _known(spark, f"{target}/registry", batch_id, "document_id long, sha256 string, batch_id int")
    judged = ingest.dedup_exact(valid, known.groupBy("sha256").agg(F.min("document_id").alias("document_id")))
    repeated = known.select("document_id", "sha256").distinct().withColumn("_again", F.lit(True))
    judged = salted_join(judged, repeated, ["document_id", "sha256"], "left", "document_id")
    fresh = judged.where(~F.col("is_duplicate") & F.col("_again").isNull())
    chunks, errors = chunking.chunk_documents(fresh, separator=separator)

    def write(df: DataFrame, name: str) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/{name}")

    write(fresh.select("document_id", "sha256"), "registry")
    write(judged.where("is_duplicate").select("document_id", F.lit("duplicate").alias("error_code"), "survivor_id").unionByName(
        refused.select("document_id", "error_code", F.lit(None).cast("long").alias("survivor_id"))).unionByName(
        errors.select("document_id", "error_code", F.lit(None).cast("long").alias("survivor_id"))), "quarantine")
    keyed = chunks.withColumn("chunk_id", F.xxhash64("document_id", "seq", "content"))
    write(keyed, "chunks")
    # Postings are built from the written chunks, so the documents are not packed twice.
    written = spark.read.parquet(f"{target}/chunks").where(F.col("batch_id") == batch_id).drop("batch_id")
    write(index.build_index(written).postings, "postings")


def stream_ingest(documents: DataFrame, target: str, separator: str = r"\n\s*\n"):
    """Continuous ingest of (document_id, filename, size_bytes, content_type, text) rows."""
    return (documents.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch.persist(), batch_id, target, separator))
            .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())


def current_chunks(spark, target: str) -> DataFrame:
    """Chunks of the latest version of every document."""
    registry = spark.read.parquet(f"{target}/registry").groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return salted_join(spark.read.parquet(f"{target}/chunks"), registry, ["document_id", "batch_id"], "left_semi", "chunk_id")


# --- sessions -----------------------------------------------------------------------------------


def active_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events inside the session of their token; a token belongs to one session.

    Works for a static and for a streaming event side. Static events of a hot token spread over salts.
    """
    if events.isStreaming:
        joined = events.join(sessions, "token")
    else:
        joined = salted_join(events, sessions, ["token"], "inner", "event_id")
    return joined.where((F.col("ts") >= F.col("opened_at")) & (F.col("ts") < F.col("expires_at")))


def purge_expired(sessions: DataFrame, now) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


# --- latency ------------------------------------------------------------------------------------


def latency_windows(turns: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Latency figures per event-time window; works on batch and streaming turns with ``ts``.

    The state of a window holds distinct sample values with counts, not the turns.
    """
    rows = turns.withWatermark("ts", delay) if turns.isStreaming else turns
    figures = latency_samples(rows).groupBy(F.window("ts", width)).agg(*latency_figures())
    return figures.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *figures.columns[1:])
