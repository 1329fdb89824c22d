"""Search, selection, completion, facts and state against brute force on small inputs."""

import math
import random

import pytest
from collections import deque

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import access, completion, conversations, facts, index, selection, vectors
from docweave.runtime import ranked
from docweave.streaming import admission, jobs

WORDS = "alpha beta gamma delta e84 tp log p20 mode load-port".split()


def corpus(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, i % 12, i // 12, f"Doc_{'e84_log' if i % 12 < 2 else 'guide'}_{i % 12}.pdf", " ".join(rng.choices(WORDS, k=rng.randint(2, 6)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id long, document_id long, seq long, filename string, content string")


def body_terms(text):
    terms = set(text.split())
    if "tp" in terms:
        terms.add("tp#timer")
    if "load-port" in terms:
        terms |= {"load", "port"}
    return terms


def bm25(rows):
    terms = {r[0]: body_terms(r[4]) for r in rows}
    n, average = len(rows), sum(map(len, terms.values())) / len(rows)

    def score(chunk, query):
        total = 0.0
        for term in query & terms[chunk]:
            df = sum(term in t for t in terms.values())
            idf = math.log((n - df + 0.5) / (df + 0.5))
            total += (idf if idf > 0 else 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(terms[chunk]) / average))
        return total
    return terms, score


def ranking(df, query_id):
    return [r["chunk_id"] for r in df.where(F.col("query_id") == query_id).orderBy("rank").collect()]


def test_bm25_and_identifier_search(spark):
    rows, chunks = corpus(spark)
    terms, score = bm25(rows)
    built = index.build_index(chunks)
    asked = {1: "alpha p20", 2: "beta zeta", 3: "gamma delta mode"}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    found = index.bm25_search(index.or_terms(questions, tx.technical_terms("text")), built, 7)
    both = index.identifier_search(index.identifier_terms(questions), built, 7)
    for query_id, text in asked.items():
        query = set(text.split())
        order = sorted((c for c in terms if terms[c] & query), key=lambda c: (-round(score(c, query), 9), c))[:7]
        assert ranking(found, query_id) == order
        live = {t for t in query if any(t in x for x in terms.values())}
        order = sorted((c for c in terms if live <= terms[c]), key=lambda c: (-round(score(c, live), 9), c))[:7]
        assert ranking(both, query_id) == order


def brute_title_search(rows, text, titles, k):
    terms, score = bm25(rows)
    query = list(dict.fromkeys(text.lower().split()))
    live = {t for t in query if any(t in x for x in terms.values())}
    if sum(live <= t for t in titles.values()) > 1 and live:
        broad, full = True, []
    else:
        broad = False
        full = sorted((c for c in terms if live and live <= terms[c]), key=lambda c: (-round(score(c, live), 9), c))[:k]
    only = {t for t in query if t not in live and any(t in x for x in titles.values())}
    if (not broad and not full and len(live) >= 2) or only:
        groups = {}
        for doc, title in titles.items():
            required = live - title
            if not only <= title or not required or (required == live and not only):
                continue
            groups[doc] = required
        doc_of = {r[0]: r[1] for r in rows}
        weak = sorted(((-len(groups[doc_of[c]]), -round(score(c, groups[doc_of[c]]), 9), c) for c in terms if doc_of[c] in groups and groups[doc_of[c]] <= terms[c]))
        if weak:
            strong = sorted((c for c in terms if doc_of[c] in groups and live <= terms[c]), key=lambda c: (-round(score(c, live), 9), c))
            full = list(dict.fromkeys(strong + [w[2] for w in weak]))[:k]
    return full


def test_title_fallback(spark):
    rows, chunks = corpus(spark, 72)
    names = {r[1]: f"{'plus' if r[1] % 3 else 'alpha'} {'beta' if r[1] % 4 == 0 else ''} kit{r[1]}" for r in rows}
    titles = {d: set(n.split()) for d, n in names.items()}
    frame = spark.createDataFrame([(d, t) for d, ts in titles.items() for t in ts], "document_id long, term string")
    asked = {1: "kit3 gamma", 2: "alpha beta gamma delta mode p20", 3: "kit4 beta", 4: "plus gamma", 5: "alpha gamma", 6: "kit1 kit2 gamma", 7: "beta kit8 gamma mode"}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    found = index.identifier_search(index.identifier_terms(questions), index.build_index(chunks), 9, None, frame)
    for query_id, text in asked.items():
        assert ranking(found, query_id) == brute_title_search(rows, text, titles, 9), text


def test_empty_scope_never_widens(spark):
    rows, chunks = corpus(spark)
    questions = spark.createDataFrame([(1, 1, "alpha"), (2, 1, "alpha"), (3, 9, "alpha"), (4, 77, "alpha")], "query_id long, user_id long, text string")
    users = spark.createDataFrame([(1, "user"), (9, "root")], "user_id long, role string")
    documents = spark.createDataFrame([(d, "shared" if d < 4 else "secret") for d in range(12)], "document_id long, visibility string")
    grants = spark.createDataFrame([(5, "user", 1), (6, "group", 7)], "document_id long, subject_type string, subject_id long")
    members = spark.createDataFrame([(7, 1)], "group_id long, user_id long")
    requested = spark.createDataFrame([(2, 99)], "query_id long, document_id long")
    scope = access.effective_scope(questions, users, documents, grants, members, requested)
    found = index.bm25_search(index.or_terms(questions, tx.technical_terms("text")), index.build_index(chunks), 200, scope)
    docs = lambda q: {r["document_id"] for r in found.where(F.col("query_id") == q).collect()}
    holding = {r[1] for r in rows if "alpha" in r[4].split()}
    assert docs(1) == holding & {0, 1, 2, 3, 5, 6} and docs(2) == set() and docs(3) == holding and docs(4) == set()


def test_filename_mentions(spark):
    cases = {"《A b.pdf》里的参数": ["a b.pdf"], "根据 x.xlsx 回答": ["x.xlsx"], "不要根据《x.pdf》": [], "文件名设为《out.txt》": [], "没有文件": [],
             "对照《a.md》和《b.md》": ["a.md", "b.md"], "《a.md》除外": []}
    rows = spark.createDataFrame(list(enumerate(cases)), "query_id long, text string").select("text", index.filename_mentions("text").alias("m")).collect()
    assert {r["text"]: r["m"] for r in rows} == cases


def test_rank_fusion_ignores_channel_order(spark):
    schema = "query_id long, chunk_id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], schema)
    first = [(r["chunk_id"], round(r["rrf"], 9)) for r in vectors.rrf_fuse(a, None, b, 5).orderBy("rank").collect()]
    second = [(r["chunk_id"], round(r["rrf"], 9)) for r in vectors.rrf_fuse(b, None, a, 5).orderBy("rank").collect()]
    assert first == second and first[0][0] == 10
    tied = vectors.rrf_fuse(a.where("chunk_id = 10"), b.where("chunk_id = 12"), None, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tied] == [12, 10]


def test_embedding_is_deterministic(spark):
    rows = vectors.embed(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"), make_encoder=lambda: vectors.HashEncoder(16)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(tuple(r["vector"]))
        assert abs(sum(x * x for x in r["vector"]) - 1) < 1e-5
    assert len(by_text["a"]) == 1 and by_text["a"] != by_text["b"]


def test_rerank_takes_the_best_window(spark):
    long = "填充 " * 900 + "目标 词语"
    rows = [(1, "目标 词语", 10, "f.txt", "无关 内容", 1), (1, "目标 词语", 11, "f.txt", long, 2), (1, "目标 词语", 12, "f.txt", " ", 3)]
    ranked_rows = vectors.rerank(spark.createDataFrame(rows, "query_id long, question string, chunk_id long, filename string, content string, position long"))
    assert [r["chunk_id"] for r in ranked_rows.orderBy("rerank_rank").collect()] == [11, 10, 12]
    scorer = vectors.model_scorer(lambda: (lambda questions, passages: [len(p) % 7 / 7 for p in passages]))
    assert vectors.rerank(spark.createDataFrame(rows, "query_id long, question string, chunk_id long, filename string, content string, position long"), scorer).count() == 3


SOURCE = "query_id long, question string, position long, chunk_id long, document_id long, seq long, filename string, page long, paragraph long, score double, content string"


def test_selection_rules(spark):
    overlap = "这一段重叠文字至少需要二十四个字符才算是真实的续段内容"
    rows = [(1, "设备通讯参数设置", 1, 1, 1, 0, "a.pdf", 1, None, .5, "其它内容"), (1, "设备通讯参数设置", 2, 2, 1, 5, "a.pdf", 1, None, .4, "设备通讯参数设置步骤 " + overlap),
            (1, "设备通讯参数设置", 3, 3, 1, 6, "a.pdf", 1, None, .3, overlap + "后面还有文字"), (1, "设备通讯参数设置", 4, 4, 2, 0, "b.pdf", 1, None, .2, "其它"),
            (1, "设备通讯参数设置", 5, 5, 1, 9, "a.pdf", 1, None, .1, "其它内容")]
    chosen = selection.select_sources(spark.createDataFrame(rows, SOURCE), 3)
    got = {r["chunk_id"]: (r["slot"], r["reason"]) for r in chosen.collect()}
    assert got[2] == (1, "rank_top_k") and got[3] == (2, "verified_continuation")
    assert got[5] == (None, "contained_same_document") and got[4][0] is None or got[1][0] == 3


def test_field_values(one):
    match = lambda q: (lambda c: selection.field_value_matches(F.lit(q), c, F.lit("m.pdf")))
    block = "STATE Format: U 1\n 1 = idle\n 2 = run\nWhere used: S1\nKIND Format: U 1\n 7 = x"
    assert one(block, match("state=2")) == ["state=2"] and one(block, match("state=7")) == [] and one("STATE 为 3", match("state=3")) == ["state=3"]
    assert one("STATE=30", match("state=3")) == []
    named = lambda c: selection.field_value_matches(F.lit("rev 3"), c, F.lit("rev_3.pdf"))
    assert one("rev 3", named) == []


def test_wordforms(spark):
    frame = spark.createDataFrame([(["load", "map"], ["loading", "map"], ["loading", "map"], []), (["stop"], ["stopping"], ["stopping"], [])],
                                  "a array<string>, w array<string>, p array<string>, t array<string>")
    assert [r["m"] for r in frame.select(selection.wordform_matches("a", "w", "p", "t").alias("m")).collect()] == [["load"], ["stop"]]


def test_continuations(spark):
    schema = "chunk_id long, document_id long, seq long, filename string, page long, paragraph long, content string"
    chunks = spark.createDataFrame([(1, 1, 0, "a.pdf", 1, None, "参数包括"), (2, 1, 1, "a.pdf", 2, None, "Byte 2: x\n第3章 新的\n尾"), (3, 2, 0, "b.docx", 1, None, "未完"),
                                    (4, 2, 1, "b.docx", 1, None, "续"), (5, 3, 0, "c.txt", None, 1, "完。"), (6, 3, 1, "c.txt", None, 2, "# 新章")], schema)
    sources = chunks.where("seq = 0").select(F.lit(1).alias("query_id"), F.col("document_id").alias("slot"), "*")
    rows = completion.attach_continuations(sources, chunks).collect()
    assert [(r["chunk_id"], r["content"], r["trimmed_at_section"], r["score"]) for r in rows] == [(2, "Byte 2: x", True, None)]


def test_question_literals(one):
    text = "报警 2 , 1 和 0x1F、S1F13、bit4 与 Input Monitor Time 以及 “门未关”"
    assert one(text, completion.question_literals) == ["2,1", "0x1F", "S1F13", "bit4", "Input Monitor Time", "门未关"]


def test_literal_boundaries(spark):
    chunks = spark.createDataFrame([(1, 1, "bit40"), (2, 1, "BIT4 ok"), (3, 1, "bit4 again"), (4, 1, "bit4 third"), (5, 2, "12,10"), (6, 2, "2,1")],
                                   "chunk_id long, document_id long, content string")
    asked = spark.createDataFrame([(1, 0, "bit4"), (1, 1, "2,1")], "query_id long, literal_no int, literal string")
    rows = completion.literal_candidates(asked, chunks).orderBy("literal_no", "chunk_id").collect()
    assert [(r["literal"], r["chunk_id"]) for r in rows] == [("bit4", 2), ("bit4", 3), ("2,1", 6)]
    used = spark.createDataFrame([(1, 2)], "query_id long, chunk_id long")
    extra = completion.attach_literals(used, completion.literal_candidates(asked, chunks)).orderBy("extra_no").collect()
    assert [r["chunk_id"] for r in extra] == [3, 6]


def test_definitions(spark):
    chunk = "Byte 1: Delay in ms (must be > 5; default 20)\nByte 2: not used\nResponse: ok"
    blocks = facts.byte_blocks(spark.createDataFrame([(1, chunk)], "chunk_id long, content string"))
    values = {r["byte"]: r for r in facts.parameter_values(blocks).collect()}
    assert (values[1]["limit_above"], values[1]["default_value"], values[1]["default_seconds"], values[1]["default_ms"]) == ("5", "20", "0.02", "20")
    assert values[2]["default_value"] is None
    vague = spark.createDataFrame([(2, 0, 3, "Delay in seconds (default 1 - 3)"), (2, 1, 4, "Delay in seconds (no default 5)")], "chunk_id long, position int, byte int, definition string")
    assert [r["default_value"] for r in facts.parameter_values(vague).orderBy("byte").collect()] == [None, None]


def test_table_lookup_reports_conflicts(spark):
    header = [(1, 1, "S", 1, c, v) for c, v in zip("ABC", ("Index", "Name", "Default Value"))]
    rows = [(1, 2, "S", 2, c, v) for c, v in zip("ABC", ("7", "Wait Time", "30"))] + [(1, 3, "S", 3, c, v) for c, v in zip("ABC", ("8", "Open Time", "40"))]
    cells = spark.createDataFrame(header + rows, "document_id long, chunk_id long, sheet string, row long, column string, value string")
    asked = spark.createDataFrame([(1, "Wait Time 的默认值"), (2, "Wait Time 和 Open Time"), (3, "P8 Wait Time"), (4, "P 8 默认值"), (5, "别的")], "query_id long, text string")
    found = facts.table_lookup(asked, cells).collect()
    status = {r["query_id"]: r["status"] for r in found}
    assert status == {1: "answer", 2: "clarification", 3: "clarification", 4: "answer"}
    assert [r["value"] for r in found if r["query_id"] == 4 and r["role"] == "default"] == ["40"]


def test_history_budget(spark):
    rows = [(i, 1, i, "ok", "q" * size, "a" * 900) for i, size in enumerate((900, 2100, 700, 600))] + [(9, 1, 9, "error", "x", "y")]
    turns = spark.createDataFrame(rows, "turn_id long, conversation_id long, turn long, status string, question string, answer string")
    got = conversations.history_context(turns, turns.where("false").select("turn_id")).orderBy("position").collect()
    assert [(len(r["question"]), len(r["answer"])) for r in got] == [(700, 0), (600, 700)]


def test_ranked_equals_a_plain_window(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 7) AS k", "id AS o")
    bad = ranked(rows, ["k"], F.floor(F.col("o") / 64), [F.col("o")], "n").join(
        rows.selectExpr("k", "o", "row_number() OVER (PARTITION BY k ORDER BY o) AS m"), ["k", "o"]).where("n <> m")
    assert bad.count() == 0


def brute_admission(events, limit, window_us):
    held, out = {}, {}
    for event_id, key, at in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        kept = held.setdefault(key, deque())
        while kept and kept[0] <= at - window_us:
            kept.popleft()
        out[event_id] = len(kept) < limit
        if out[event_id]:
            kept.append(at)
    return out


def test_admission_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(5)
    events = sorted(((i, 0 if rng.random() < .4 else rng.randint(1, 5), rng.randint(0, 4000) * 100_000) for i in range(1500)), key=lambda e: e[2])
    events = [(i, key, at) for i, (_, key, at) in enumerate(events)]
    frame = spark.createDataFrame(events, "event_id long, key long, at_us long")
    wanted = brute_admission(events, 3, 10_000_000)
    assert {r["event_id"]: r["admitted"] for r in admission.admission_batch(frame, 3, 10).collect()} == wanted
    for part in range(3):
        frame.where(F.floor(F.col("event_id") / 500) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["admitted"] for r in jobs.run_to_table(admission.admission_stream(stream, 3, 10)).collect()}
    assert got == wanted
    admitted = sorted((k, at) for i, k, at in events if wanted[i])
    assert all(not (a[0] == b[0] and b[1] - a[1] < 10_000_000) for a, b in zip(admitted, admitted[3:]))


@pytest.mark.parametrize("step, limit, window_s", [(40_000, 3, 1), (2_000_000, 1, 7)])
def test_dense_keys_decide_as_the_walk(spark, step, limit, window_s):
    """One key of 30,000 events without a gap in 15 chunks, and small keys beside it; ties included."""
    rng, at, events = random.Random(step), 0, []
    for n in range(30_000):
        at += rng.choice([0, rng.randint(1, step)])
        events.append((n, 0, at))
    events += [(40_000 + n, 1 + n % 50, rng.randint(0, 10 ** 9)) for n in range(500)]
    frame = spark.createDataFrame(events, "event_id long, key long, at_us long")
    got = {r["event_id"]: r["admitted"] for r in admission.admission_dense(frame, limit, window_s, 2000).collect()}
    assert got == brute_admission(events, limit, window_s * 1_000_000) and 0 < sum(got.values()) < len(got)


ADMISSION = "event_id long, key long, at_us long"


def test_event_time_admission_of_shuffled_arrival(spark, tmp_path):
    """Events up to 19 s late within a delay of 20 s, in five deliveries, decide as the batch; later ones are marked."""
    rng = random.Random(5)
    events = [(i, 0 if rng.random() < .4 else rng.randint(1, 5), rng.randint(0, 4000) * 100_000) for i in range(1500)]
    arrival = sorted(events, key=lambda e: e[2] + rng.randint(0, 19_000_000))
    late = [(9000, 0, 0), (9001, 3, 350_000_000)]
    parts = [arrival[n * 300:(n + 1) * 300] for n in range(5)] + [[(9998, -1, 10 ** 10)], [*late, (9999, -1, 10 ** 10 + 1)]]
    folder = str(tmp_path)
    for part in parts:
        spark.createDataFrame(part, ADMISSION).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ADMISSION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    job = (admission.admission_event_time(stream, 3, 10, 20).writeStream.format("parquet").option("path", f"{folder}/out")
           .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    job.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").where("key >= 0").collect()
    batch = {r["event_id"]: (r["admitted"], r["retry_after_s"]) for r in admission.admission_batch(spark.createDataFrame(events, ADMISSION), 3, 10).collect()}
    assert {r["event_id"]: (r["admitted"], r["retry_after_s"]) for r in rows if not r["late"]} == batch and len(rows) == 1502
    assert sorted((r["event_id"], r["admitted"]) for r in rows if r["late"]) == [(9000, False), (9001, False)]
    assert {r["event_id"]: a for r in rows if not r["late"] for a in [r["admitted"]]} == brute_admission(events, 3, 10_000_000)
    for name in ("waiting", "admitted"):
        state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name).load()
        assert state.where("key.key >= 0").count() == 0


def test_stream_ingest_replaces_and_deduplicates(spark, tmp_path):
    schema = "document_id long, filename string, size_bytes long, content_type string, text string"
    batches = [[(1, "a.txt", 3, "text/plain", "one"), (2, "b.txt", 3, "text/plain", "two"), (3, "c.exe", 3, "", "bad")],
               [(4, "d.txt", 3, "text/plain", "one"), (2, "b.txt", 5, "text/plain", "two!!")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_ingest(stream, target).awaitTermination()
    got = {(r["document_id"], r["content"]) for r in jobs.current_chunks(spark, target).collect()}
    assert got == {(1, "one"), (2, "two!!")}
    refused = {(r["document_id"], r["error_code"]) for r in spark.read.parquet(f"{target}/quarantine").collect()}
    assert refused == {(3, "unsupported_ext"), (4, "duplicate")}


def test_pages_are_as_long_as_asked_or_refused(spark):
    from docweave.operators import conversations as cv
    rows = spark.range(500).orderBy("id")
    assert cv.page_of(rows, 300, 50).count() == 300 and cv.page_of(rows, 1000).count() == 500
    assert [r["id"] for r in cv.newest(spark.range(500), "id", 250, most=250).limit(2).collect()] == [499, 498]
    for limit, offset, most in ((0, 0, None), (5, -1, None), (201, 0, 200)):
        with pytest.raises(ValueError):
            cv.page_of(rows, limit, offset, most)


def test_all_uncertain_lines_are_listed(spark):
    from docweave.operators import page_sets
    lines = spark.createDataFrame([(1, 1, 10 + n, f"line {n}", 0.1 if n % 2 else 0.9) for n in range(200)] + [(1, 2, 1, "x", None), (1, 2, 2, "y", 0.1)],
                                  "document_id long, page long, line_no long, text string, score double")
    expected = list(range(2, 201, 2))
    assert sorted(r["line"] for r in page_sets.uncertain_lines(lines).collect()) == expected
    whole, cut = (page_sets.page_quality(lines, most).where("page = 1").first()["uncertain_lines"] for most in (None, 50))
    assert whole == expected and cut == expected[:50]
