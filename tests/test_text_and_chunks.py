"""Text functions, readers, units and chunking on small inputs."""

import math
import re

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunking, ingest, page_sets, units
from docweave.sources import html, logs, metadata, readers

SAMPLES = ["", "E84 日志里 P20 与 P200", "A\nTP_STATE ok", "通讯参数设置 3.5 与 v1.2-7 12", "load-port TP1 S1 , F13。", "x" * 900, "设备。" * 500]


def python_tokens(text):
    if not text:
        return 0
    cjk = len(re.findall("[一-鿿]", text))
    return max(1, math.ceil(cjk / 2) + math.ceil((len(text) - cjk) / 4))


def test_token_count(one):
    for text in SAMPLES:
        assert one(text, tx.token_count) == python_tokens(text) == chunking.count_tokens(text)


def test_clean_text(one):
    assert one("a \t b\r\n\r\n\r\n　c\x0cd  \n", tx.clean_text) == "a b\n\n c\nd"


def test_technical_terms(one):
    assert one("E84 与P20，P200 v1.2-x a_b", tx.technical_terms) == ["e84", "p20", "p200", "v1.2-x", "a_b"]
    assert "tp_state" in one("see T\nP_STATE", tx.technical_terms)


def hexed(prefix, text):
    return prefix + text.encode().hex()


def test_lexical_terms(one):
    assert one("设备A号 3.5 x7", tx.lexical_terms) == [
        hexed("z2", "设备"), hexed("z1", "设"), hexed("z1", "备"), hexed("z1", "号"), hexed("n", "3.5")]
    assert one("设备A号", lambda c: tx.lexical_terms(c, query=True)) == [hexed("z2", "设备"), hexed("z1", "号")]
    assert one("v1.2 3-4 +5", tx.lexical_terms) == [hexed("n", "+5")]


def test_expand_terms(one):
    terms = one("load-port TP1 S1 , F13 a-1", tx.body_terms)
    assert {"s1f13", "tp#timer", "load", "port", "load-port"} <= set(terms) and "a" not in terms


def test_filename_terms(one):
    assert set(one("LP_manual_v2.1.pdf", tx.filename_terms)) == {"lp_manual_v2.1", "v2.1"}


def test_text_quality(one):
    assert one("", lambda c: tx.text_quality(c).quality) == "insufficient"
    assert one("a" * 50, lambda c: tx.text_quality(c).quality) == "usable"
    assert one("a" * 50 + "�" * 5, lambda c: tx.text_quality(c).quality) == "suspect"


def test_read_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("设备".encode("utf-8-sig"))
    (tmp_path / "b.md").write_bytes("参数".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\x00\xd8")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.log").write_bytes(b"\xef\xbb\xbf")
    rows = {r["filename"]: r for r in readers.read_text_corpus(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "设备" and rows["b.md"]["text"] == "参数"
    assert rows["c.txt"]["error_code"] == "bad_encoding" and rows["d.bin"]["error_code"] == "unsupported_ext"
    assert rows["e.log"]["error_code"] == "empty_file"


def test_normalize_url(one):
    good = {"HTTP://Example.org:80/a b".replace(" ", "%20"): "http://example.org/a%20b", "https://例子.测试/路?q=值#f":
            "https://xn--fsqu00a.xn--0zwm56d/%E8%B7%AF?q=%E5%80%BC", "https://8.8.8.8": "https://8.8.8.8/"}
    for given, wanted in good.items():
        assert one(given, metadata.normalize_url) == wanted
    for bad in ("ftp://a.org", "http://u:p@a.org/", "http://a.org:8080/", "http://localhost/", "http://10.0.0.1/", "http://[::1]/", "http://nodot/", "http://a.org/ x"):
        assert one(bad, metadata.normalize_url) is None, bad


def python_windows(text, max_tokens, overlap):
    """Brute force: characters instead of find calls."""
    text = text.strip()
    if python_tokens(text) <= max_tokens:
        return [text]
    window, shared = max(16, max_tokens * 2), overlap * 2
    pieces, i = [], 0
    while i < len(text):
        j = min(len(text), i + window)
        ends = [k for k in range(i + 1, j + 1) if text[k - 1] in "。！？；.!?;\n"]
        if ends and ends[-1] - i >= max(shared + 1, window - shared):
            j = ends[-1]
        if text[i:j].strip():
            pieces.append(text[i:j].strip())
        if j >= len(text):
            break
        i = max(i + 1, j - shared)
    return pieces


def test_split_long_covers_the_text():
    for text in [s for s in SAMPLES if s] + ["a. " * 700, "句子很长" * 300 + "。"]:
        for max_tokens, overlap in ((50, 5), (20, 8), (400, 60)):
            pieces = chunking.split_long(text, max_tokens, overlap)
            assert [p[0] for p in pieces] == python_windows(text, max_tokens, overlap)
            assert all(p[0] in text for p in pieces)
            compact = "".join(text.split())
            assert "".join(pieces[0][0].split()) == compact[:len("".join(pieces[0][0].split()))]


def test_chunk_units_merges_per_page(spark):
    rows = [(1, 0, 1, 1, "a" * 40), (1, 1, 1, 2, "b" * 40), (1, 2, 2, 3, "c"), (1, 3, 2, 4, "文档表格《1》第 1 行：A1=x"), (1, 4, 2, 5, "d")]
    pieces, errors = chunking.chunk_units(spark.createDataFrame(rows, "document_id long, unit_no long, page long, paragraph long, text string"), 30, 3)
    got = [(r["page"], r["paragraph"], r["content"]) for r in pieces.orderBy("seq").collect()]
    assert got == [(1, 1, "a" * 40 + "\n" + "b" * 40), (2, 3, "c"), (2, 4, "文档表格《1》第 1 行：A1=x"), (2, 5, "d")] and errors.count() == 0


def test_oversized_documents_are_refused_before_grouping(spark):
    units_ = spark.range(20).selectExpr("1 AS document_id", "repeat('x', 10) AS text")
    assert ingest.unit_budget_errors(units_, max_units=10).first()["error_code"] == "too_many_units"


def test_chunks_of_documents_are_bounded_and_gapless(spark, sf_dir):
    from docweave.plans.frames import Frames
    pieces, errors = chunking.chunk_documents(Frames(spark, sf_dir).documents(), separator="\n", max_tokens=60, overlap=10)
    stats = pieces.groupBy("document_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.max("token_count").alias("top"))
    bad = stats.where("low <> 0 OR high <> n - 1 OR top > 60")
    assert bad.count() == 0 and errors.count() == 0


PAGE = """<html><head><title> T </title></head><body><nav>menu</nav><main><h1>A</h1><p>one <b>two</b></p><h2>B</h2>
<pre>x = 1\n  y</pre><ul><li>item</li></ul><table><tr><th>k</th><td rowspan="2">v</td></tr></table><a href="/n#f">next</a>
<p>见下图</p><p><img src="i.png"></p><figure><img src="f.png"><figcaption>图 2 x</figcaption></figure><p>如图2所示</p><div hidden>no</div></main></body></html>"""


def test_html_article(spark):
    parsed = html.articles(spark.createDataFrame([(1, "https://e.org/d/", PAGE)], "page_id long, url string, html string"))
    row = parsed.first()
    assert row["title"] == "T" and row["error_code"] is None and row["status"] == "partial"
    assert [(b["kind"], b["text"]) for b in row["blocks"]][:6] == [
        ("h1", "A"), ("p", "one two"), ("h2", "B"), ("pre", "x = 1\n  y"), ("li", "item"), ("table", "k\tv")]
    assert set(row["warnings"]) == {"image_text_not_extracted", "table_spans_not_expanded"}
    assert [r["url"] for r in html.page_links(parsed).collect()] == ["https://e.org/n#f"]
    found = {(r["text"], r["image_url"]) for r in html.figure_links(parsed).collect()}
    assert found == {("见下图", "https://e.org/d/i.png"), ("如图2所示", "https://e.org/d/f.png")}
    paths = {r["number"]: r["heading_path"] for r in units.explode_blocks(parsed.select("page_id", "blocks")).collect()}
    assert paths[2] == "A" and paths[3] == "A" and paths[4] == "A > B"
    chunks = chunking.chunk_blocks(parsed)[0].orderBy("seq").collect()
    assert chunks[3]["content"] == "A\nB\nx = 1\n  y" and [c["seq"] for c in chunks] == list(range(len(chunks)))


def test_html_rejects(spark):
    pages = [(1, "<title>t</title><article>a</article><article>b</article>"), (2, "<body>x</body>"), (3, "<title>t</title><body></body>"),
             (4, "<title>t</title><body><table><tr><td><table></table></td></tr></table></body>")]
    rows = spark.createDataFrame([(i, "https://e.org/", h) for i, h in pages], "page_id long, url string, html string")
    errors = {r["page_id"]: r["error_code"] for r in html.articles(rows).collect()}
    assert errors == {1: "no_single_body_or_title", 2: "no_single_body_or_title", 3: "no_text", 4: "nested_table"}


def test_log_records_and_chunks(spark):
    files = [(1, "\n\n2024-01-01 10:00:00 a\nmore\n[11:00:00.5] b\n"), (2, "x\n\ny\nz\n\n\nw"), (3, "a\x00b"), (4, "a\r\nb\rc\n")]
    read = logs.log_files(spark.createDataFrame(files, "file_id long, content string"))
    rows = logs.log_lines(read).orderBy("file_id", "line_no").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file_id"], []).append(r["record_no"])
    assert by_file[1] == [1, 1, 1, 1, 2] and by_file[2] == [1, 1, 2, 2, 2, 2, 3]
    kinds = {r["file_id"]: (r["newline"], r["error_code"]) for r in read.collect()}
    assert kinds[3][1] == "control_characters" and kinds[4][0] == "mixed"
    pieces, errors = chunking.chunk_log(read, max_tokens=4, overlap=1)
    texts = {}
    for r in pieces.orderBy("file_id", "seq").collect():
        texts.setdefault(r["file_id"], []).append((r["line_start"], r["line_end"], r["content"]))
        assert r["token_count"] <= 4
    assert texts[2][0][2].startswith("x") and texts[2][-1][1] == 7
    assert {r["file_id"] for r in errors.collect()} == {1, 3}


def test_merge_layer_text(one):
    merge = lambda layer: (lambda c: page_sets.merge_layer_text(F.lit(layer), c))
    assert one("Head 1\nbody", merge("Head1")) == "Head 1\nbody"
    assert one("body", merge("Other")) == "Other\nbody" and one("", merge("Other")) == "Other"


def test_parse_rows_joins_lines_and_voids_bad_rows(spark):
    text = "工作表《S》第 2 行：A2=x；B2=two\nlines；C2=z\n工作表《S》第 3 行：A4=bad\n工作表《S》第 5 行：A5=1；A5=2"
    rows = units.parse_rows(spark.createDataFrame([(1, text)], "chunk_id long, content string")).collect()
    assert [(r["row"], r["column"], r["value"]) for r in rows] == [(2, "A", "x"), (2, "B", "two\nlines"), (2, "C", "z")]


def test_column_letters(spark):
    got = [r["c"] for r in spark.createDataFrame([(1,), (26,), (27,), (702,), (703,)], "i long").select(units.column_letter(F.col("i")).alias("c")).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA"]


def test_write_chunks_overwrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = spark.range(100).selectExpr("id AS chunk_id", "id % 10 AS document_id", "'a' AS content")
    ingest.write_chunks(first, path, buckets=16)
    ingest.write_chunks(first.where("document_id = 3").withColumn("content", F.lit("b")).unionByName(
        first.where("document_id <> 3 AND pmod(xxhash64(document_id), 16) = (SELECT pmod(xxhash64(3L), 16))")), path, buckets=16)
    kept = spark.read.parquet(path)
    assert kept.count() == 100 and kept.where("content = 'b'").select("document_id").distinct().first()[0] == 3
