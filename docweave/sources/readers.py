"""Corpus readers: files to text rows with an explicit decoding outcome."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docweave.functions import text as tx

# Readable extensions and their kind.
TEXT_KINDS = {".txt": "txt", ".md": "md", ".log": "log", ".html": "html", ".htm": "html"}
BOM_UTF8 = b"\xef\xbb\xbf"


@F.pandas_udf(T.StringType())
def _decode(data: pd.Series, charset: pd.Series) -> pd.Series:
    def strict(raw, name):
        try:
            return bytes(raw).decode(name) if raw is not None and name is not None else None
        except UnicodeDecodeError:
            return None

    return pd.Series([strict(raw, name) for raw, name in zip(data, charset)], dtype=object)


def strict_decode(data, charset) -> Column:
    """Text in another character set, or NULL when any byte is malformed; nothing is replaced.

    The built-in decode raises on malformed input and knows no GB18030 without a legacy setting, so
    the few files that are not UTF-8 are decoded here. Rows with a NULL charset cost nothing.
    """
    charset = F.lit(charset) if isinstance(charset, str) else charset
    return _decode(F.when(charset.isNotNull(), tx.as_column(data)), charset)


def decode_text(data) -> Column:
    """UTF-8 with or without a byte order mark, else GB18030, else NULL."""
    data = tx.as_column(data)
    has_bom = F.substring(data, 1, 3) == F.lit(BOM_UTF8)
    body = F.when(has_bom, F.substring(data, F.lit(4), F.length(data))).otherwise(data)
    valid = F.is_valid_utf8(body.cast("string"))
    return F.when(valid, body.cast("string")).otherwise(strict_decode(data, F.when(~valid, "gb18030")))


def read_text_corpus(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """One row per file: path, filename, kind, size, sha256, text, error_code.

    ``binaryFile`` splits by file, so a corpus of many files spreads over the cluster and file
    sizes come from metadata. The file source itself skips files of zero bytes.
    """
    kinds = kinds or TEXT_KINDS
    extension = tx.suffix("path")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[extension]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.col("kind").isNotNull(), decode_text("content"))
    return files.withColumn("kind", kind).select(
        "path", tx.base_name("path").alias("filename"), "kind",
        F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), text.alias("text"),
        F.when(F.col("kind").isNull(), "unsupported_ext").when((F.col("length") == 0) | (text == ""), "empty_file")
        .when(text.isNull(), "bad_encoding").alias("error_code"))
