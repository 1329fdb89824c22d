"""A streamed table may be one file or a folder of files."""

import shutil

import pytest

from docweave.plans import streams
from docweave.streaming import jobs


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_file_and_folder(spark, tmp_path, files):
    rows = spark.range(40).repartition(files)
    rows.write.parquet(str(tmp_path / "made"))
    parts = sorted((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "t").mkdir()
    if files == 1:
        shutil.copy(parts[0], tmp_path / "t" / "documents.parquet")
    else:
        shutil.copytree(tmp_path / "made", tmp_path / "t" / "documents.parquet")
    rows.write.parquet(str(tmp_path / "t" / "others.parquet"))
    found = jobs.run_to_table(streams._stream(spark, str(tmp_path / "t"), "documents"))
    assert sorted(r["id"] for r in found.collect()) == list(range(40))


def test_ingest_of_a_folder(spark, tmp_path):
    texts = [(n, f"line {n % 5} of a text\nand another", "en", "web", 30) for n in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(
        str(tmp_path / "documents.parquet"))
    assert {r["document_id"] for r in streams.stream_ingest(spark, str(tmp_path)).collect()} == set(range(5))
