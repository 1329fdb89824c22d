"""Session settings, durable intermediate results and bounded broadcasts."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# A broadcast side above this many estimated bytes takes the shuffled or sliced way instead.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_session(app_name: str = "docweave", cpus: int | str = "*", shuffle_partitions: int = 8,
                **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOCWEAVE_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; only a local master may fall back to a
    temporary folder, because there the driver and the executors share one disk; it goes when the driver ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    chosen = tempfile.mkdtemp(prefix="docweave-")
    atexit.register(shutil.rmtree, chosen, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The table survives executor loss, is computed once, cuts the lineage of later plans, and its size
    is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, name: str, value) -> DataFrame:
    """Adds a costly column that is evaluated once per row.

    The optimizer copies a projected expression into every filter and projection above it; it does not
    copy the output of a generator, here an explode of one element.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when the input has fewer splits than cores; large inputs keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def persist(df: DataFrame) -> DataFrame:
    """Reuse a frame inside one job; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def width(value, kind: T.DataType):
    """Bytes of a value in a row, with all that it holds; a null takes its fixed place only."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            return F.lit(16) + F.coalesce(F.array_size(value), F.lit(0)) * 8
        return F.lit(16) + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + width(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.MapType):
        return width(F.map_keys(value), T.ArrayType(kind.keyType)) + width(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def estimated_bytes(df: DataFrame, *columns: str, overhead: int = 48) -> int:
    """Size of the named columns, of all without names, by one distributed aggregate.

    ``overhead`` is what a row costs beside its values in a hash table: its head, the key and the place in the table.
    """
    total = sum((width(F.col(f"`{name}`"), df.schema[name].dataType) for name in columns or df.columns), F.lit(overhead))
    return int(df.agg(F.sum(total.cast("long")).alias("total")).first()["total"] or 0)


def broadcast_if_small(df: DataFrame, *columns: str, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring the side; larger sides are left to a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df, *(columns or df.columns)) <= limit else df


def measured_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """A join side with a hint: a broadcast within the limit, beyond it a shuffle.

    Without a hint the planner goes by the size of the files, and packed files of a few megabytes can hold rows of hundreds,
    which the driver then gathers.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df.hint("merge")


def bounded_slices(df: DataFrame, key: str, *columns: str, limit: int = BROADCAST_LIMIT_BYTES) -> list[DataFrame]:
    """Split a frame by a hash of its key into slices that each stay below the broadcast limit."""
    count = max(1, math.ceil(estimated_bytes(df, *(columns or df.columns)) / (limit / 2)))
    if count == 1:
        return [df]
    bucket = F.pmod(F.xxhash64(key), F.lit(count))
    return [df.where(bucket == number) for number in range(count)]


def read_tables(spark: SparkSession, sf_dir: str):
    """Reader for the driver's parquet tables."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: str,
                salts: int = 16, measured: bool = False) -> DataFrame:
    """Equi-join whose left side may hold a hot key.

    Left rows of one key spread over ``salts`` sub-keys by a hash of ``spread``; every right row
    is repeated once per salt, so each left row still meets each right row of its key once.
    ``measured`` says that the right side is beyond the broadcast limit: the planner goes by the size of its files, without
    the repeats, and would gather it in the driver if they are small.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge") if measured else right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of a large table that a bounded set of keys asks for.

    The small side is written once and measured. Within the broadcast limit the large table is only
    scanned; beyond it both sides are shuffled.
    """
    return large.join(measured_side(materialize(small)), keys, how)


def ranked(df: DataFrame, keys: list[str], bucket, order: list, name: str = "rank") -> DataFrame:
    """Row number within keys, computed per bucket plus an offset.

    ``bucket`` must rise with ``order``. A hot key is ranked bucket by bucket in parallel, and only
    the small table of bucket counts is accumulated per key.
    """
    from pyspark.sql import Window

    placed = df.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = placed.withColumn("_local", F.row_number().over(
        Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    joined = local.join(offsets, match, "inner")
    return (joined.withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
            .drop("_bucket", "_b", "_local", "_offset", *[f"_k_{k}" for k in keys]))
