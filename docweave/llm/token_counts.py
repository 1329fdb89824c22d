"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Every change is a signed row: an insert adds a document and its tokens, a delete takes them away, a revised
count does both. A batch is summed by key and written as one folder; a folder counts once it is complete, and a
batch id that is complete is never written again, so a repeated commit changes nothing. Totals are the sum of
all complete folders. Nulls in source or language form a key of their own.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.llm.arrays import map_batches, text_bytes
from docweave.llm.registry import query
from docweave.llm.tokens import default_path, word_ids
from docweave.runtime import materialize, shared_dir

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long"


class Rollup:
    """Totals kept as one folder of deltas per committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def is_committed(self, batch: str) -> bool:
        return self.files.exists(self._at(f"batch={batch}", "_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds signed rows (``SCHEMA``) under a batch id; False if that batch is there already.

        A folder left by a run that was cut off has no success mark and is written anew.
        """
        if self.is_committed(batch):
            return False
        (deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
         .where("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch}"))
        return True

    def batches(self) -> list[str]:
        if not self.files.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self._at())]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.is_committed(n.removeprefix("batch=")))

    def totals(self) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return (rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0"))


def signed(rows: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Inserts (+1) or deletes (-1) from rows of counted documents."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * F.col(tokens)).cast("long").alias("tokens"))


def revised(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Deltas of documents that stay but whose count changed."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.col(after) - F.col(before)).cast("long").alias("tokens"))


def counted(documents: DataFrame, tokenizer: str, version: str = "word_bpe_49k") -> DataFrame:
    """One row per document and tokenizer version: ids of the word tokenizer, and white-space separated words.

    ``revision`` is a second text of the row; ``revised_tokens`` is its count, null where there is none. A null
    or empty text has 0 tokens.
    """

    def work(batch):
        cache = word_ids(tokenizer)
        made = [[], [], []]
        for text, revision in zip(batch.column("text").to_pylist(), batch.column("revision").to_pylist()):
            for number, count in enumerate((lambda t: len(cache.ids(t)) // 4, lambda t: len(t.split()) if t else 0)):
                for values, value in zip(made, (number, count(text), None if revision is None else count(revision))):
                    values.append(value)
        twice = pa.array([row for row in range(batch.num_rows) for _ in (0, 1)], pa.int64())
        names = [(version, "white_space")[n] for n in made[0]]
        return [*(batch.column(c).take(twice) for c in ("doc_id", "source", "lang", "content")), names, pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64())]

    return map_batches(documents, work, "doc_id long, source string, lang string, content string, tokenizer_version string, tokens long, revised_tokens long")


def history(documents: DataFrame, tokenizer: str, path: str) -> Rollup:
    """Four commits over a whole table: every document is loaded; documents with repeated lines are revised to
    one occurrence of each line; later copies of an equal text are deleted; the last batch is sent again."""
    rollup = Rollup(documents.sparkSession, path)
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    rows = materialize(counted(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text",
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("content"), F.when(once != F.col("text"), once).alias("revision")), tokenizer))
    rollup.commit("1-load", signed(rows, 1))
    rollup.commit("2-revise", revised(rows.where("revised_tokens is not null"), "tokens", "revised_tokens"))
    now = rows.withColumn("now", F.coalesce("revised_tokens", "tokens"))
    # The first document of each content stays: all rows go, and the first comes back. Both sums combine before any shuffle.
    first = now.groupBy("content", "tokenizer_version").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "source", "lang", "now")).alias("kept"))
    kept = first.select("kept.source", "kept.lang", "tokenizer_version", "kept.now")
    copies = signed(now, -1, "now").unionByName(signed(kept, 1, "now"))
    rollup.commit("3-delete-copies", copies)
    rollup.commit("3-delete-copies", copies)
    return rollup


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return history(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").totals()
