"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for two prime moduli, the sums of code point times base power up to every position. From them
the hash of any span is one subtraction and one product, so two spans are compared without reading them, and
the longest common extension of two positions is found by binary search over span lengths.

A fingerprint is the whole text's hash and a sketch: the smallest hashes of all its spans of ``SPAN`` code
points. Likeness of two fingerprints is the share of equal hashes among the smallest of both sketches together,
an estimate of the Jaccard similarity of the span sets; it is exact while both sets fit their sketches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import mix, small_batches
from docweave.llm.registry import query

MODULI = (np.uint64(2147483647), np.uint64(2147483629))
BASES = (np.uint64(911382323), np.uint64(972663749))
SPAN = 12
SKETCH = 64

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, by doubling."""
    known = _powers.get(which)
    if known is None or len(known[0]) < count:
        modulus, made = MODULI[which], []
        for start in (int(BASES[which]), pow(int(BASES[which]), -1, int(modulus))):
            table, step = np.ones(1, dtype=np.uint64), start
            while len(table) < max(count, 4096):
                table = np.concatenate([table, table * np.uint64(step) % modulus])
                step = step * step % int(modulus)
            made.append(table)
        known = _powers[which] = tuple(made)
    return known[0][:count], known[1][:count]


class Prefix:
    """Modular prefix sums of the code points of one text."""

    def __init__(self, codes: np.ndarray):
        self.length = len(codes)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for which, modulus in enumerate(MODULI):
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(values * powers(which, len(codes))[0] % modulus, out=sums[1:])
            sums %= modulus
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        made = []
        for which, modulus in enumerate(MODULI):
            sums = self.sums[which]
            made.append((sums[ends] + modulus - sums[starts]) * powers(which, self.length + 1)[1][starts] % modulus)
        return (made[0] << np.uint64(31)) | made[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` code points, in order."""
        made = []
        for which, modulus in enumerate(MODULI):
            sums = self.sums[which]
            made.append((sums[width:] + modulus - sums[:-width]) * powers(which, self.length + 1)[1][:self.length - width + 1] % modulus)
        return (made[0] << np.uint64(31)) | made[1]


def spans_equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest span that starts at ``i`` in one text and at ``j`` in the other."""
    low, high = 0, min(a.length - i, b.length - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sketch(prefix: Prefix) -> tuple[int, np.ndarray]:
    """Whole-text hash and the smallest ``SKETCH`` distinct mixed span hashes, ascending. A text shorter than a
    span is one span; the empty text has none."""
    if not prefix.length:
        return 0, np.zeros(0, dtype=np.uint64)
    hashes = mix(prefix.windows(min(SPAN, prefix.length)))
    if len(hashes) > 8 * SKETCH:
        # Smallest distinct values: a low part that surely holds enough of them, unless spans repeat a lot.
        low = np.unique(np.partition(hashes, 4 * SKETCH)[:4 * SKETCH])
        hashes = low if len(low) >= SKETCH else np.unique(hashes)
    else:
        hashes = np.unique(hashes)
    return prefix.span(0, prefix.length), hashes[:SKETCH]


def fingerprint(length: int, made: tuple[int, np.ndarray]) -> str:
    """Length, whole hash, then the sketch, in hexadecimal."""
    return f"{length:x}.{made[0]:016x}." + made[1].astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity from two sketches; two empty ones are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    together = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        together = together[:SKETCH]
    return float(np.isin(together, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(together))


def fingerprint_likeness(a: str, b: str) -> float:
    """``likeness`` of two fingerprint strings."""
    return likeness(*(np.frombuffer(bytes.fromhex(x.rsplit(".", 1)[1]), dtype=">u8").astype(np.uint64) for x in (a, b)))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, common_start long")


def fingerprints(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document against its successor in descending doc_id, the last against the first.

    Documents are dealt to ranges of ids by split points and sorted there, so a successor is the next row. The
    one document that a range needs from its neighbour, its largest, is sent to both. A null text is empty.
    Rows with equal ids follow each other in the order of their texts; rows without an id come last. One single document
    is its own successor. No row, no result. Other columns are not kept.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("place"))
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())
    # Split points: bounded by the number of ranges, from a summary of the ids alone.
    points = ids.approxQuantile("place", [n / count for n in range(1, count)], 0.1 / count) if count > 1 else []
    points = sorted({int(p) for p in points})
    place = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    bucket = F.lit(0)
    if points:
        bucket = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= place)) if len(points) < 64 else F.expr(
            "size(filter(array(" + ",".join(f"{p}L" if p > -(1 << 63) else "-9223372036854775808" for p in points) + "), p -> p <= coalesce(doc_id, -9223372036854775807 - 1)))")
    filled = sorted(r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect())
    if not filled:
        return spark.createDataFrame([], SCHEMA)
    # What is largest in a range is the successor of the smallest in the range above; the largest of all succeeds the smallest of all.
    above = {low: high for low, high in zip(filled, filled[1:] + filled[:1])}
    tops = (rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.max(place).alias("top")))
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(tops), "bucket")
    upward = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    dealt = marked.select("doc_id", "text", F.explode(F.when(place == F.col("top"), F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(upward[F.col("bucket")].alias("bucket"), F.lit(True).alias("guest"))))
        .otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))).alias("to")).select("doc_id", "text", "to.bucket", "to.guest")
    ordered = (dealt.repartition(len(filled), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"))

    def made(pending, following):
        """Result of one document, given the next one: (doc_id, text, prefix, sketch)."""
        doc, text, prefix, own = pending
        half = len(text) // 2
        edited = text[:len(text) - half] + following[1][:half] if half else text
        edited_prefix = Prefix(codes_of(edited))
        edited_sketch = sketch(edited_prefix)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(len(text), own), fingerprint(len(edited), edited_sketch),
                likeness(own[1], edited_sketch[1]), likeness(own[1], following[3][1]), longest_common_extension(prefix, 0, edited_prefix, 0))

    def run(batches):
        pending, current, served = None, None, False
        out: list[tuple] = []

        def batch_of(results):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in results], type=t) for n, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"])

        for batch in batches:
            columns = [batch.column(n) for n in range(4)]
            for row in range(batch.num_rows):
                doc, text, bucket_of, guest = (c[row].as_py() for c in columns)
                if bucket_of != current:
                    pending, current, served = None, bucket_of, False
                if guest and served:  # only the first guest, the largest by id then text, is a successor
                    continue
                prefix = Prefix(codes_of(text))
                item = (doc, text, prefix, sketch(prefix))
                if pending is not None:
                    out.append(made(pending, item))
                    if len(out) >= 500:
                        yield batch_of(out)
                        out = []
                served = served or guest
                pending = item
        if out:
            yield batch_of(out)

    return small_batches(ordered).mapInArrow(run, SCHEMA)


@query("op10_fingerprints")
def op10_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
